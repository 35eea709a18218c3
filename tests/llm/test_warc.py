"""WARC derivatives: links, digests, round trips."""

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pytest

from tarn.llm.warc import derivatives, derive, digest, parse, payload, read_warc, record, responses, visible, write_warc

HTML = '<html lang="en"><head><title>A  title</title><style>p{}</style></head><body><h1>One &amp; two</h1><script>var x="</p>";</script><p>Three<br>four</p><a href="/x">link</a></body></html>'


def test_visible_text():
    assert visible(HTML) == ("One & two\nThree\nfour\nlink", "A title", "en", ["/x"])
    assert visible("") == ("", "", None, [])
    assert visible("<p>open <b>never closed")[0] == "open never closed"


def test_records_round_trip():
    data = record([("WARC-Type", "resource"), ("X", None)], "é\r\n\r\nx".encode()) + record([("A", "b")], b"")
    (h1, b1), (h2, b2) = parse(data)
    assert dict(h1)["Content-Length"] == "7" and b1 == "é\r\n\r\nx".encode() and (h2[0], b2) == (("A", "b"), b"")
    with pytest.raises(ValueError):
        parse(data[:-6])


def test_derivatives(spark):
    rows = [(1, "http://a.example/d/", HTML), (2, None, None), (3, "http://b.example", ""), (1, "http://a.example/d/", HTML), (None, "u", "<p>x")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, response_id string")
    made = derivatives(responses(pages)).collect()
    assert len(made) == len(rows)
    for r in made:
        (meta, meta_block), (conv, conv_block) = parse(bytes(r["metadata_record"]))[0], parse(bytes(r["conversion_record"]))[0]
        meta, conv = dict(meta), dict(conv)
        assert meta["WARC-Type"] == "metadata" and conv["WARC-Type"] == "conversion"
        assert meta["WARC-Refers-To"] == conv["WARC-Refers-To"] == r["refers_to"] == r["response_id"]
        assert meta["WARC-Concurrent-To"] == conv["WARC-Record-ID"] == r["conversion_id"]
        assert meta["WARC-Target-URI"] == conv["WARC-Target-URI"] == r["target_uri"]
        assert conv["WARC-Block-Digest"] == digest(conv_block) and meta["WARC-Block-Digest"] == digest(meta_block)
        assert f"source-warc-payload-digest: {r['response_digest']}" in meta_block.decode()
    first = next(r for r in made if r["page_id"] == 1)
    assert first["response_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(HTML.encode()).digest()).decode()
    assert bytes(first["conversion_block"]).decode() == "One & two\nThree\nfour\nlink"
    assert "outlink: http://a.example/x" in bytes(first["metadata_record"]).decode()
    assert len({r["metadata_id"] for r in made}) == len(rows) - 1
    assert derivatives(responses(pages.limit(0))).collect() == []


def test_broken_records_give_nulls(spark):
    other = record([("WARC-Type", "request"), ("WARC-Record-ID", "<x>")], b"")
    df = spark.createDataFrame([(1, None), (2, b"junk"), (3, other)], "page_id long, response_record binary")
    assert all(r["metadata_record"] is None for r in derivatives(df).collect())
    assert derive(b"WARC/1.1\r\n\r\n") is None


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", f"<p>page {i} é") for i in range(5)], "page_id long, url string, html string")
    stored = b"".join(gzip.compress(bytes(r["response_record"])) for r in responses(pages).collect())
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(stored)
    made = derivatives(read_warc(spark, str(tmp_path / "in")))
    assert sorted(bytes(r["conversion_block"]).decode() for r in made.collect()) == [f"page {i} é" for i in range(5)]
    write_warc(made, str(tmp_path / "out"))
    parts = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in parse(p.read_bytes())]
    assert sorted(dict(h)["WARC-Type"] for h, _ in parts) == ["conversion"] * 5 + ["metadata"] * 5


def test_all_source_headers_are_kept():
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-Long: one\r\n  two\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n<p>x"
    source = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Identified-Payload-Type", "text/html"), ("WARC-IP-Address", "192.0.2.1"), ("WARC-Concurrent-To", "<urn:y>"), ("WARC-Concurrent-To", "<urn:z>"), ("Content-Type", "application/http; msgtype=response")]
    made = derive(record(source, block))
    ((meta, fields),), ((conv, _),) = parse(made["metadata_record"]), parse(made["conversion_record"])
    assert dict(meta)["WARC-Identified-Payload-Type"] == dict(conv)["WARC-Identified-Payload-Type"] == "text/html"
    lines = fields.decode().split("\r\n")
    for line in ("source-warc-ip-address: 192.0.2.1", "source-warc-concurrent-to: <urn:y>", "source-warc-concurrent-to: <urn:z>", "source-content-type: application/http; msgtype=response"):
        assert line in lines
    assert [x for x in lines if x.startswith("source-http")] == ["source-http-status: HTTP/1.1 404 Not Found", *(f"source-http-header: {x}" for x in ("Content-Type: text/html", "X-Long: one two", "Set-Cookie: a=1", "Set-Cookie: b=2"))]


def test_a_head_without_end_tag():
    assert visible("<html><head><title>T</title><meta charset=utf-8><style>p{}</style><noscript><img></noscript>\n<p>One<p>two")[:2] == ("One\ntwo", "T")
    assert visible("<head><title>T</title> bare text")[0] == "bare text"
    assert visible("<head><link rel=x></head>shown<body>also")[0] == "shownalso"


@pytest.mark.parametrize("html", ["<![foo[x]]>after", "<!x<![a[", "<![endif]-->shown", "<!DOCTYPE", "<?php <!--", "<!--", "<![", "&#xFFFFFFFFF;<![CDATA[x"])
def test_any_text_is_a_page(html):
    assert isinstance(visible(html)[0], str)
    assert visible("<p>before" + html)[0].startswith("before")


def _response(http: bytes, body: bytes, colon: bytes = b": ", kind: bytes = b"WARC-Type") -> bytes:
    block = http + b"\r\n\r\n" + body
    head = [b"WARC/1.0", kind + colon + b"response", b"warc-record-id" + colon + b"<urn:x>", b"CONTENT-LENGTH" + colon + str(len(block)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_header_names_in_any_case_and_codings_of_bodies():
    page = "<p>one é".encode()
    chunks = b"4\r\n<p>o\r\n" + f"{len(page) - 4:x};x=y\r\n".encode() + page[4:] + b"\r\n0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    bodies = {
        b"HTTP/1.1 200 OK": page,
        b"HTTP/1.1 200 OK\r\ntransfer-encoding:chunked": chunks,
        b"HTTP/1.1 200 OK\r\nContent-Encoding: GZIP": gzip.compress(page[:3]) + gzip.compress(page[3:]),
        b"HTTP/1.1 200 OK\r\nContent-Encoding:deflate": zlib.compress(page),
        b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate": raw.compress(page) + raw.flush(),
        b"HTTP/1.1 200 OK\r\nContent-Encoding: x-gzip\r\nTransfer-Encoding: gzip, chunked": f"{len(gzip.compress(page)):X}\r\n".encode() + gzip.compress(page) + b"\r\n0\r\n\r\n",
    }
    for http, body in bodies.items():
        for colon, kind in ((b": ", b"WARC-Type"), (b":", b"warc-type"), (b":  ", b"Warc-TYPE")):
            assert derive(_response(http, body, colon, kind))["conversion_block"].decode() == "one é"
    whole = gzip.compress(("<p>" + "long " * 5000).encode())
    cut = derive(_response(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip", whole[:-20]))["conversion_block"]
    assert 0 < len(cut) and set(cut.decode().split()) <= {"long", "lon", "lo", "l"}
    for broken in (b"HTTP/1.1 200 OK\r\nContent-Encoding: br", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip"):
        assert derive(_response(broken, b"junk"))["conversion_block"] == b""
    assert derive(_response(b"", b""))["conversion_block"] == b""


def test_broken_files_end_with_a_null_row(spark, tmp_path):
    whole = _response(b"HTTP/1.1 200 OK", b"<p>x")
    (tmp_path / "a.warc").write_bytes(whole + whole + whole[:-3])
    (tmp_path / "b.warc").write_bytes(gzip.compress(whole)[:-9])
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(b"WARC/1.0\r\nno header\r\n\r\n")
    rows = read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and sum(r["response_record"] is None for r in rows) == 3
    assert len(derivatives(read_warc(spark, str(tmp_path))).collect()) == 6


def test_query_against_records_built_by_hand(spark, sf):
    """Every column of op9 on the whole table, made here from the pages alone."""
    from tarn.llm.queries import op9_warc

    url_space, sha1 = uuid.NAMESPACE_URL, lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    urn = lambda *x: f"<urn:uuid:{uuid.uuid5(url_space, chr(0).join(x))}>"
    date = "1970-01-01T00:00:00Z"
    info = urn("warcinfo", date)
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    made = op9_warc(spark, sf).collect()
    assert sorted(r["page_id"] for r in made) == sorted(pages) and len(made) >= 50
    for r in made:
        page = pages[r["page_id"]]
        body = page["html"].encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
        source = urn("response", str(page["page_id"]), page["url"], sha1(body))
        text, title, lang, links = visible(page["html"])
        for line in text.split("\n"):  # every word shown is in the page, in order
            at = 0
            plain = re.sub(r"<[^>]*>", " ", page["html"]) if "&" not in page["html"] else None
            for word in line.split() if plain else ():
                at = plain.index(word, at) + len(word)
        data = text.encode()
        text_id = urn("conversion", source, sha1(data))

        def rec(kind, rid, content, mime, extra=""):
            return (
                f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Refers-To: {source}\r\n{extra}WARC-Date: {date}\r\n"
                f"WARC-Target-URI: {page['url']}\r\nWARC-Warcinfo-ID: {info}\r\nWARC-Identified-Payload-Type: text/html\r\n"
                f"WARC-Block-Digest: {sha1(content)}\r\nContent-Type: {mime}\r\nContent-Length: {len(content)}\r\n\r\n"
            ).encode() + content + b"\r\n\r\n"

        from urllib.parse import urljoin

        fields = [f"title: {title}", *([f"languageHint: {lang}"] if lang is not None else []), f"textLength: {len(text)}", f"linkCount: {len(links)}"]
        fields += [f"outlink: {urljoin(page['url'], x)}" for x in links]
        fields += [f"source-warc-payload-digest: {sha1(body)}", f"source-warc-block-digest: {sha1(block)}", "source-content-type: application/http; msgtype=response"]
        fields += [f"source-content-length: {len(block)}", "source-http-status: HTTP/1.1 200 OK"]
        fields += ["source-http-header: Content-Type: text/html; charset=utf-8", f"source-http-header: Content-Length: {len(body)}"]
        meta = "".join(f"{x}\r\n" for x in fields).encode()
        meta_id = urn("metadata", source, sha1(meta))
        assert (r["response_id"], r["refers_to"], r["target_uri"]) == (source, source, page["url"])
        assert (r["metadata_id"], r["conversion_id"], r["text_bytes"]) == (meta_id, text_id, len(data))
        assert (r["response_digest"], r["conversion_digest"]) == (sha1(body), sha1(data))
        assert r["conversion_sha256"] == hashlib.sha256(rec("conversion", text_id, data, "text/plain; charset=utf-8")).hexdigest()
        assert r["metadata_sha256"] == hashlib.sha256(rec("metadata", meta_id, meta, "application/warc-fields", f"WARC-Concurrent-To: {text_id}\r\n")).hexdigest()


def test_any_charset_beside_good_rows(spark):
    """A page's charset is the server's word: none of them ends the job, and good rows are as ever."""
    names = ["undefined", "idna", "punycode", "utf-7", "unicode_escape", "raw_unicode_escape", "rot13", "hex", "base64", "zip", "utf-32", "nonsense", "mbcs", "cp1252", "utf-16"]
    body = b"<p>plain \\ud800 +2AA- text</p>"
    rows = []
    for k, name in enumerate(names):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={name}\r\n\r\n".encode() + body
        rows.append((k, record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{k}>"), ("WARC-Target-URI", "http://a.example")], http)))
    good = derivatives(responses(spark.createDataFrame([(99, "http://a.example", HTML)], "page_id long, url string, html string"))).first()
    rows.append((99, bytes(responses(spark.createDataFrame([(99, "http://a.example", HTML)], "page_id long, url string, html string")).first()["response_record"])))
    made = {r["page_id"]: r for r in derivatives(spark.createDataFrame(rows, "page_id long, response_record binary")).collect()}
    assert made[99] == good and len(made) == len(rows)
    for k, name in enumerate(names):
        text = bytes(made[k]["conversion_block"]).decode()
        assert name == "utf-16" or text == "plain \\ud800 +2AA- text", name


def test_packed_bodies_have_a_bound():
    page = b"<p>" + b"x " * 50_000
    http = [("Content-Encoding", "gzip")]
    assert payload(http, gzip.compress(page)) == (page, False)
    assert payload(http, gzip.compress(page), most=1000) == (page[:1000], True)
    assert payload(http, gzip.compress(page), most=len(page)) == (page, False)
    assert payload(http, gzip.compress(page)[:-20])[1] is False
    assert payload([("Content-Encoding", "br")], b"x") == (b"", False)
