"""Line dedup (operator 6): two Bloom filters, then exact confirmation.

A first pass fills the filters with the hashes of each document's distinct line
keys. A second pass over the documents sends on only suspected repeats, as
128-bit digests with their document, pre-aggregated to the first and the last
document of each. Keys of more than one document are confirmed repeats; all
documents but the first lose their lines.

The lines go in a narrow third pass, without a shuffle of texts: the most
frequent repeats, a bounded number, are broadcast with their first documents.
Only documents that hold a rarer repeat are joined with a list of theirs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.bloom import MAX_BITS, PairFilter, bits_for, pair_filter, probes_for
from tarn.llm.common import carried, cut, document_columns, emit, pairs, slices

_SPACES = b" \t\n\x0b\x0c\r"
#: Repeats that are broadcast, the most frequent (32 bytes each).
COMMON = 1 << 16
_MADE = ("doc_id", "n_lines", "n_dropped", "text")


def line_key(line: bytes, least: int = 10) -> bytes | None:
    """Key of a line in UTF-8: stripped, A-Z lower-cased; null if under ``least`` code points."""
    key = line.strip(_SPACES)
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key.lower()


def _keys(text: str | None, least: int) -> list[bytes]:
    """Distinct keys of a text."""
    if not text:
        return []
    return list({k for line in text.encode().split(b"\n") if (k := line_key(line, least)) is not None})


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_filter(docs: DataFrame, least: int = 10, max_bits: int = MAX_BITS) -> PairFilter:
    """Filters of the keys that one document holds, and that two or more hold."""
    text = F.col("text")
    n_lines = F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    lines = int(docs.agg(n_lines).first()[0] or 0)
    bits = bits_for(lines, max_bits=max_bits)

    def hashes(batches):
        held, size = [], 0
        for batch in batches:
            for _, t in pairs(batch):
                held.append(_hashes(_keys(t, least)))
                size += len(held[-1])
                if size >= 200_000:
                    yield np.concatenate(held)
                    held, size = [], 0
        if held:
            yield np.concatenate(held)

    return pair_filter(docs, hashes, bits, probes_for(lines, bits))


def repeated_lines(docs: DataFrame, seen, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Suspects ``row_key, doc_id, digest`` and confirmed repeats ``digest, first, n``.

    ``docs``: columns ``row_key, doc_id, text``; ``seen``: broadcast filters. All rows
    without an id are one document, after all others.
    """
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary())])

    def suspects(batches):
        filters = seen.value

        def rows():
            for batch in batches:
                for part in slices([batch]):
                    for row_key, doc_id, t in zip(*(part.column(c).to_pylist() for c in ("row_key", "doc_id", "text")), strict=True):
                        keys = _keys(t, least)
                        if keys:
                            for i in np.flatnonzero(filters.seen_twice(_hashes(keys))):
                                yield row_key, doc_id, _digest(keys[i])

        yield from emit(rows(), schema)

    found = cut(docs.mapInArrow(suspects, "row_key long, doc_id long, digest binary"), narrow=True)
    no_id = F.max(F.col("doc_id").isNull().cast("int")) == 1
    ends = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), no_id.alias("no_id"), F.count("*").alias("n"))
    held = (F.col("first") < F.col("last")) | (F.col("first").isNotNull() & F.col("no_id"))
    return found, cut(ends.where(held).select("digest", "first", "n"))


class _Common:
    """Digests with their first documents, in order of the digests' first halves."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        pairs_ = np.frombuffer(b"".join(d for d, _ in rows), "<u8").reshape(-1, 2)
        order = np.argsort(pairs_[:, 0], kind="stable")
        self.a, self.b = pairs_[order, 0], pairs_[order, 1]
        self.first = np.array([f for _, f in rows], np.int64)[order]

    def lost(self, digests: list[bytes], doc_id: int | None) -> np.ndarray:
        """Which digests a smaller doc_id holds too."""
        own = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        at, out = np.searchsorted(self.a, own[:, 0]), np.zeros(len(own), bool)
        for i, k in enumerate(at):
            while k < len(self.a) and self.a[k] == own[i, 0]:
                if self.b[k] == own[i, 1]:
                    out[i] = doc_id is None or doc_id > self.first[k]
                k += 1
        return out


def line_dedup(
    docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), max_bits: int = MAX_BITS, common: int = COMMON
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` and ``carry``, one row per input row; text: the kept lines.

    Keys of at least ``least`` code points found in two documents or more lose
    all their lines but those of the smallest doc_id. Null and empty texts are
    one empty line and stay (as an empty text). Whole texts are read, however long.
    Rows of one doc_id are one document. Rows without an id count as one document
    after all others. Other columns are ignored, whatever their names; a carried
    column that has a name of the result is an error; an empty table stays empty.
    ``max_bits`` bounds a filter and ``common`` the repeats that are broadcast;
    they change no result.
    """
    own = document_columns(docs, id_col, text_col, carry)
    names, more = carried(own, carry, _MADE)
    spark = docs.sparkSession
    own = own.withColumn("row_key", F.xxhash64("doc_id", "text"))
    texts = own.select("row_key", "doc_id", "text")
    seen = spark.sparkContext.broadcast(line_filter(texts, least, max_bits))  # max_bits at most
    found, repeats = repeated_lines(texts, seen, least)
    total, least_n = repeats.count(), 0
    if total > common:  # those above a number that so few are above
        least_n = repeats.agg(F.approx_percentile("n", F.lit(1 - common / total), 10_000)).first()[0]
        while repeats.where(F.col("n") > least_n).count() > common:
            least_n *= 2
    first = repeats.where(F.col("n") > least_n).select("digest", "first").collect()  # ``common`` rows at most
    shared = spark.sparkContext.broadcast(_Common([(bytes(r["digest"]), r["first"]) for r in first]))
    held = ["doc_id", "text", *names]
    schema = "doc_id long, n_lines long, n_dropped long, text string" + more

    def kept(doc_id, text, drop):
        lines = (text or "").encode().split(b"\n")
        keys = [line_key(x, least) for x in lines]
        asked = list({k for k in keys if k is not None})
        gone = set()
        if asked:
            asked = [asked[i] for i in np.flatnonzero(seen.value.seen_twice(_hashes(asked)))]
        if asked:
            digests = [_digest(k) for k in asked]
            lost = shared.value.lost(digests, doc_id)
            gone = {k for k, d, x in zip(asked, digests, lost, strict=True) if x or (drop and d in drop)}
        left = [x for x, k in zip(lines, keys, strict=True) if k not in gone] if gone else lines
        return len(lines), len(lines) - len(left), b"\n".join(left).decode()

    def batch_of(part, drops):
        rows = [kept(*x) for x in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), drops, strict=True)]
        n_lines, n_dropped, texts = zip(*rows, strict=True)
        arrays = [part.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*arrays, *[part.column(c) for c in names]], names=[*_MADE, *carry])

    if total <= common:  # no rarer ones

        def keep(batches):
            for part in slices(batches):
                yield batch_of(part, [None] * part.num_rows)

        return own.select(*held).mapInArrow(keep, schema)

    lost = found.join(repeats.where(F.col("n") <= least_n).select("digest", "first"), "digest").where(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    lost = cut(lost.groupBy("row_key").agg(F.collect_set("digest").alias("drop")))
    keys_of = lambda batches: (b.column("row_key").to_numpy().view(np.uint64) for b in batches)
    some = spark.sparkContext.broadcast(pair_filter(lost.select("row_key"), keys_of, bits_for(lost.count(), max_bits=max_bits)))

    def asked(part):
        return some.value.seen_once(part.column("row_key").to_numpy().view(np.uint64))

    def others(batches):
        for part in slices(batches):
            rest = part.filter(pa.array(~asked(part)))
            if rest.num_rows:
                yield batch_of(rest, [None] * rest.num_rows)

    def chosen(batches):
        for part in slices(batches):
            yield part.filter(pa.array(asked(part)))

    def joined(batches):
        for part in slices(batches):
            yield batch_of(part, [d and set(d) for d in part.column("drop").to_pylist()])

    joint = own.mapInArrow(chosen, own.schema).join(lost, "row_key", "left").select(*held, "drop").mapInArrow(joined, schema)
    return own.mapInArrow(others, schema).unionByName(joint)
