"""WARC derivative builder (operator 9): metadata and conversion records.

Each response record gives two derivatives that refer to it: a metadata record
(``application/warc-fields``: title, language, link and text counts, outlinks)
and a conversion record (``text/plain``: the page's visible text). Both carry the
response's target URI, date, warcinfo id and identified payload type, name it in
``WARC-Refers-To``, and have block digests of their own; the metadata keep the
response's other WARC headers, its HTTP status and all its HTTP headers. Identifiers are UUIDs derived from content, so a task
that runs again makes the same records.

One narrow pass; every record is built from its own row.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import emit

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
EPOCH = "1970-01-01T00:00:00Z"
_HIDDEN = {"script", "style", "template", "noscript"}
#: What may stand in a head; any other tag, or text, ends a head that isn't closed.
_HEAD = _HIDDEN | {"html", "head", "base", "basefont", "bgsound", "link", "meta", "noframes", "title"}
#: WARC headers of a response that its derivatives have as their own.
_OWN = {"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-warcinfo-id", "warc-identified-payload-type"}
#: What a packed body may unpack to at most; of one that is larger the rest is left out, and both derivatives say so.
MOST_BYTES = 1 << 26
#: Codecs that a page may name: those of text, none that is a transfer form or gives lone surrogates.
_CHARSETS = re.compile(r"ascii|utf-8(?:-sig)?|utf-16(?:-[bl]e)?|iso8859-\d+|cp\d+|koi8-[rtu]|mac-\w+|gb\w+|big5\w*|euc_\w+|shift_jis\w*|iso2022_\w+|johab|hz|tis-620|ptcp154|kz1048")
_BREAKS = set("address article aside blockquote br div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())


def digest(data: bytes) -> str:
    """Labelled digest as WARC writers give it: base32 of SHA-1."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC/1.1 record; headers without a value are left out."""
    clean = lambda v: re.sub(r"[\r\n]+", " ", v)
    lines = [b"WARC/1.1"] + [f"{k}: {clean(v)}".encode("utf-8", "replace") for k, v in headers if v is not None]
    lines.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


Headers = list[tuple[str, str]]


def _fields(lines: list[bytes]) -> Headers:
    """Named fields; a line that starts with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {text.strip()}"
        else:
            name, colon, value = text.partition(":")
            if not colon or not name.strip():
                raise ValueError(f"no header: {text[:40]!r}")
            out.append((name.strip(), value.strip()))
    return out


def lowered(headers: Headers) -> dict[str, str]:
    """Headers by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in headers:
        out.setdefault(name.lower(), value)
    return out


def records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record in ``data``, one at a time; a broken record raises ValueError.

    Names of headers are in any case, with or without a blank after the colon.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        first, *lines = data[at : max(end, at)].split(b"\r\n")
        if end < 0 or not first.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        headers = _fields(lines)
        length = lowered(headers).get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", length):
            raise ValueError(f"record at byte {at} has no length")
        n = int(length)
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, block
        at = end + 8 + n


def parse(data: bytes) -> list[tuple[Headers, bytes]]:
    """All records of ``data``; see :func:`records`."""
    return list(records(data))


def _dechunked(body: bytes) -> bytes:
    """A chunked body's data, as far as its chunks are whole."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = re.match(rb"\s*([0-9A-Fa-f]{1,8})\s*(?:;|$)", body[at:end])
        if not size or not int(size[1], 16):
            break
        n = int(size[1], 16)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def _inflated(body: bytes, coding: str, most: int) -> tuple[bytes, bool]:
    """A gzip or deflate body's data, as far as it is whole, ``most`` bytes at most; and if there was more."""
    for wbits in (31,) if "gzip" in coding else (15, -15):
        out, data, left = [], body, most
        try:
            while data and left > 0:
                member = zlib.decompressobj(wbits)
                out.append(member.decompress(data, left))
                left -= len(out[-1])
                data = member.unused_data if member.eof else member.unconsumed_tail
        except zlib.error:
            if not any(out):
                continue
        return b"".join(out), left <= 0 and bool(data)
    return b"", False


def payload(http: Headers, body: bytes, most: int = MOST_BYTES) -> tuple[bytes, bool]:
    """The body with its transfer and content codings undone; and if it was cut at ``most`` bytes.

    A body that ends early, or that isn't in the coding it names, gives what could
    be read of it; one in a coding other than chunked, gzip and deflate is empty.
    """
    own, shortened = lowered(http), False
    if "chunked" in own.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    for coding in reversed([x.strip() for x in own.get("content-encoding", "").lower().split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            body, more = _inflated(body, coding, most)
            shortened = shortened or more
        elif coding not in ("", "identity"):
            return b"", shortened
    return body, shortened


def decoded(body: bytes, charset: str) -> str:
    """A body's text. A charset that isn't known or isn't one of text counts as UTF-8; bad bytes are replaced."""
    if charset.lower() != "utf-8":
        try:
            name = codecs.lookup(charset).name
            if _CHARSETS.fullmatch(name):
                return re.sub("[\ud800-\udfff]", "\ufffd", body.decode(name, "replace"))
        except (LookupError, ValueError):
            pass
    return body.decode("utf-8", "replace")


class _Page(HTMLParser):
    """Visible text by line, title, language and links of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_title, self.in_head = 0, False, False
        self.title, self.text, self.links, self.lang = [], [], [], None

    def parse_marked_section(self, i, report=1):
        """``<![...]>`` of any kind is a comment up to the next ``>``, as browsers have it."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "html" and attrs.get("lang"):
            self.lang = attrs["lang"]
        if tag == "head":
            self.in_head = True
        elif tag == "body" or tag not in _HEAD and not self.hidden:
            self.in_head = False
        if tag == "title":
            self.in_title = True
        elif tag == "body":
            self.hidden = 0
        elif tag in _HIDDEN:
            self.hidden += 1
        if tag in _BREAKS:
            self.text.append("\n")
        if tag == "a" and attrs.get("href"):
            self.links.append(attrs["href"])

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag == "head":
            self.in_head = False
        elif tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in _BREAKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.in_head = self.in_head and not data.strip()
            if not self.in_head:
                self.text.append(data)


def visible(html: str) -> tuple[str, str, str | None, list[str]]:
    """Text (a line for each block, white space collapsed), title, language, links.

    Any text is a page: should the parser give up on its declarations, these are
    read as text.
    """
    page = _Page()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):
        page = _Page()
        page.feed(html.replace("<!", "&lt;!").replace("<?", "&lt;?"))
        page.close()
    lines = (" ".join(x.split()) for x in "".join(page.text).split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(page.title).split()), page.lang, page.links


def responses(pages: DataFrame, date: str = EPOCH, warcinfo: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, response_record`` (binary) of stored pages: WARC responses over HTTP.

    Null pages have an empty body; a null url an empty target. One row per input row.
    """
    schema = pa.schema([("page_id", pa.int64()), ("response_record", pa.binary())])
    warcinfo = warcinfo or record_id("warcinfo", date)

    def build(page_id, url, html):
        body = (html or "").encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
        block = head.encode() + body
        headers = [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(body))),
            ("WARC-Date", date),
            ("WARC-Target-URI", url or ""),
            ("WARC-Warcinfo-ID", warcinfo),
            ("WARC-Payload-Digest", digest(body)),
            ("WARC-Block-Digest", digest(block)),
            ("WARC-Identified-Payload-Type", "text/html"),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        return page_id, record(headers, block)

    def run(batches):
        rows = (build(*row) for b in batches for at in range(0, b.num_rows, 256) for row in zip(*(b.slice(at, 256).column(i).to_pylist() for i in range(3)), strict=True))
        yield from emit(rows, schema, lambda r: 64 + len(r[1]))

    own = pages.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string"))
    return own.toDF("page_id", "url", "html").mapInArrow(run, "page_id long, response_record binary")


def derive(response: bytes) -> dict | None:
    """The two derivatives of one response record; null if it isn't a whole response.

    Bodies are read with their transfer and content codings undone (:func:`payload`).
    """
    try:
        ((headers, block),) = parse(response)
    except ValueError:
        return None
    own = lowered(headers)
    if own.get("warc-type", "").lower() != "response" or not own.get("warc-record-id"):
        return None
    http, _, body = block.partition(b"\r\n\r\n")
    status, *lines = re.sub(r"\r\n[ \t]+", " ", http.decode("latin-1")).split("\r\n")
    body, shortened = payload([(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body)
    charset = re.search(rb"charset=[\"']?([\w-]+)", http, re.I)
    html = decoded(body, charset[1].decode() if charset else "utf-8")
    text, title, lang, links = visible(html)
    uri, source = own.get("warc-target-uri", ""), own["warc-record-id"]
    fields = [("title", title), ("languageHint", lang), ("textLength", str(len(text))), ("linkCount", str(len(links)))]
    fields += [("outlink", _join(uri, x)) for x in links]
    fields += [(f"source-{k.lower()}", v) for k, v in headers if k.lower() not in _OWN]
    fields += [("source-http-status", status), *(("source-http-header", x) for x in lines)]
    one = lambda v: re.sub(r"\s+", " ", v)
    meta_block = "".join(f"{k}: {one(v)}\r\n" for k, v in fields if v is not None).encode("utf-8", "replace")
    text_block = text.encode("utf-8", "replace")

    def headed(kind, block, mime):
        rid = record_id(kind, source, digest(block))
        return rid, [
            ("WARC-Type", kind),
            ("WARC-Record-ID", rid),
            ("WARC-Refers-To", source),
            ("WARC-Date", own.get("warc-date", EPOCH)),
            ("WARC-Target-URI", uri),
            ("WARC-Warcinfo-ID", own.get("warc-warcinfo-id")),
            ("WARC-Identified-Payload-Type", own.get("warc-identified-payload-type")),
            ("WARC-Truncated", "length" if shortened else None),
            ("WARC-Block-Digest", digest(block)),
            ("Content-Type", mime),
        ]

    text_id, text_head = headed("conversion", text_block, "text/plain; charset=utf-8")
    meta_id, meta_head = headed("metadata", meta_block, "application/warc-fields")
    meta_head.insert(3, ("WARC-Concurrent-To", text_id))
    return {
        "response_id": source,
        "target_uri": uri,
        "metadata_id": meta_id,
        "conversion_id": text_id,
        "refers_to": source,
        "response_digest": own.get("warc-payload-digest"),
        "conversion_digest": digest(text_block),
        "conversion_block": text_block,
        "metadata_record": record(meta_head, meta_block),
        "conversion_record": record(text_head, text_block),
    }


def _join(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


_FIELDS = [("response_id", "string"), ("target_uri", "string"), ("metadata_id", "string"), ("conversion_id", "string"), ("refers_to", "string"), ("response_digest", "string"), ("conversion_digest", "string"), ("conversion_block", "binary"), ("metadata_record", "binary"), ("conversion_record", "binary")]


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "response_record") -> DataFrame:
    """``page_id``, ids, digests and the two derivative records of each response.

    One row per input row. Null records, other kinds of record and broken ones
    give nulls; a page without text gives an empty conversion block. Whole pages
    are read, however long; a packed page of over ``MOST_BYTES`` is read so far, and
    ``WARC-Truncated`` says so. A charset that is none of text is taken for UTF-8, lone
    surrogates for U+FFFD. Repeated rows give equal records with equal ids. Extra
    columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("page_id", pa.int64())] + [(n, pa.string() if t == "string" else pa.binary()) for n, t in _FIELDS])

    def run(batches):
        def rows():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    for page_id, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        made = derive(data) if data else None
                        yield (page_id, *((made or {}).get(n) for n, _ in _FIELDS))

        yield from emit(rows(), schema, lambda r: 512 + sum(len(x) for x in r[8:] if x))

    own = records.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{record_col}`").alias("response_record"))
    return own.mapInArrow(run, ", ".join(["page_id long", *(f"{n} {t}" for n, t in _FIELDS)]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, response_record``: the response records of WARC files.

    Files are read by Spark, so any store will do, each as one value: of 2 GB at
    most. Records are taken one at a time, and so are the members of a ``.gz``
    file, one of which holds whole records. ``page_id`` is a hash of the record's
    id. Where a file is broken its reading ends with one row of nulls.
    """
    schema = pa.schema([("page_id", pa.int64()), ("response_record", pa.binary())])

    def members(data):
        if data[:2] != b"\x1f\x8b":
            yield data
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            yield member.decompress(data) + member.flush()
            if not member.eof:
                raise ValueError("a member is cut short")
            data = member.unused_data

    def found(content):
        try:
            for member in members(content):
                for headers, block in records(member):
                    own = lowered(headers)
                    if own.get("warc-type", "").lower() == "response":
                        key = hashlib.sha1(own.get("warc-record-id", "").encode()).digest()[:8]
                        kept = [(k, v) for k, v in headers if k.lower() != "content-length"]
                        yield int.from_bytes(key, "big", signed=True), record(kept, block)
        except (ValueError, zlib.error):
            yield None, None

    def run(batches):
        rows = (row for b in batches for at in range(b.num_rows) for row in found(b.column("content")[at].as_py()))
        yield from emit(rows, schema, lambda r: 64 + len(r[1] or b""))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id long, response_record binary")


def write_warc(made: DataFrame, path: str, compression: str | None = None) -> None:
    """Writes both derivatives of each row to WARC files, one a task; nulls are left out.

    A record ends in two line ends, which the text writer puts after each row.
    """
    both = made.select(F.explode(F.array("metadata_record", "conversion_record")).alias("record"))
    text = both.where(F.col("record").isNotNull()).select(F.expr("decode(substr(record, 1, length(record) - 4), 'UTF-8')").alias("value"))
    writer = text.write.mode("errorifexists").option("lineSep", "\r\n\r\n")
    (writer.option("compression", compression) if compression else writer).text(path)
