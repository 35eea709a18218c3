"""Substring dedup (operator 7): fixed-block anchors.

A document is its words. Every document's non-overlapping reference blocks of
``(window + 1) // 2`` words are indexed; a window of ``window`` words always holds
a whole block of its own document. So if a window occurs twice, each occurrence
has a rolling block-long stretch that equals a reference block of the other. All
rolling stretches probe the index, two Bloom filters of the blocks: a stretch that
isn't a reference block itself must have been seen, one that is must have been
seen twice.

Hits are then extended to maximal exact repeats: all windows that hold a hit are
confirmed by 64-bit hashes of the window and of its least stretch (which also
says where a window is sent, so neighbours travel together). Both are made of
64-bit hashes of the words, so equal means equal in those. Windows that a
task holds twice are confirmed there and sent once, so a passage that
many documents share costs a few rows for each task, not for each pair or document.
Windows that lie half in such a passage share its least stretch, too; where more
runs than a task's share have one stretch, they are dealt by window instead.
Runs of confirmed windows are the maximal repeats.

Only documents that hold a repeat are joined with their spans; all others are
passed on where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.bloom import MAX_BITS, bits_for, mix, pair_filter, probes_for
from tarn.llm.bpe import Bounded
from tarn.llm.common import carried, cut, document_columns, emit, shuffle_width, slices

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_WORDS = 200_000


def _word_cache() -> Bounded:
    return Bounded(xxhash.xxh3_64_intdigest)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each stretch of ``size`` words, by its content alone."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers(_BASE, n), dtype=np.uint64)])
    return mix((sums[size:] - sums[:-size]) * powers(_INVERSE, n - size + 1))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each stretch of ``size`` values."""
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def _chunks(batches, columns, cache, least, most):
    """Other columns and word hashes of some documents at a time, about ``most`` words.

    Documents of under ``least`` words are left out.
    """
    rows, parts, size = [], [], 0
    for batch in batches:
        for part in slices([batch]):
            for text, *rest in zip(*(part.column(c).to_pylist() for c in ("text", *columns)), strict=True):
                words = text.encode().split() if text else []
                if len(words) < least:
                    continue
                rows.append(rest)
                parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
                size += len(words)
                if size >= most:
                    yield rows, parts
                    rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def repeated_spans(docs: DataFrame, window: int = 35, chunk_words: int = CHUNK_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``row_key, spans``: first word and number of repeated windows, as int32 pairs.

    ``docs``: columns ``row_key, text``.
    """
    block = (window + 1) // 2
    n_bytes = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_blocks = n_bytes // (6 * block) + 1
    bits = bits_for(n_blocks, max_bits=max_bits)

    def blocks(batches):
        cache = _word_cache()
        for _, parts in _chunks(batches, (), cache, block, chunk_words):
            yield np.concatenate([rolling(p, block)[::block] for p in parts])

    seen = docs.sparkSession.sparkContext.broadcast(pair_filter(docs.select("text"), blocks, bits, probes_for(n_blocks, bits)))  # max_bits at most

    def probe(batches):
        cache, filters, known = _word_cache(), seen.value, Confirmed()

        def rows():
            for ids, parts in _chunks(batches, ("row_key",), cache, window, chunk_words):
                found = _candidates(parts, filters, window, block)
                if found is not None:
                    yield from _runs(ids, known, *found)

        yield from emit(rows(), _RUNS, lambda r: 80 + len(r[3] or b"") + len(r[5] or b""))

    runs = cut(docs.mapInArrow(probe, _RUNS_DDL), narrow=True)
    spans = pa.schema([("row_key", pa.int64()), ("spans", pa.binary())])

    def confirm(batches):
        """Rows come sorted by key; a few keys are looked at together."""

        def checked(held):
            n = np.array([len(r[5]) for r in held])
            hashes = np.frombuffer(b"".join(r[3] for r in held), np.uint64)
            many = np.frombuffer(b"".join(r[5] for r in held), np.uint8) != 0
            twice = many | repeated(hashes, np.repeat(np.array([r[0] for r in held], np.int64), n))
            for row, at, m in zip(held, np.cumsum(n) - n, n, strict=True):
                on = twice[at : at + m]
                if on.any():
                    yield row[1], _spans(np.flatnonzero(on) + row[2])

        def rows():
            held, size = [], 0
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in _RUNS.names), strict=True):
                    if size > 200_000 and row[0] != held[-1][0]:
                        yield from checked(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5])
            if held:
                yield from checked(held)

        yield from emit(rows(), spans, lambda r: 64 + len(r[1]))

    sent = _dealt(runs.where(F.col("spans").isNull()))
    found = sent.repartition("key").sortWithinPartitions("key").mapInArrow(confirm, "row_key long, spans binary")
    return found.unionByName(runs.where(F.col("spans").isNotNull()).select("row_key", "spans"))


_RUNS = pa.schema([("key", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("hashes", pa.binary()), ("spans", pa.binary()), ("many", pa.binary())])
_RUNS_DDL = "key long, row_key long, start int, hashes binary, spans binary, many binary"


def _dealt(runs: DataFrame) -> DataFrame:
    """The runs, those of common keys as single windows, keyed by the window's hash.

    A key is common if it has more rows than a quarter of a task's share; there are
    no more such keys than four times the tasks. All runs of a key are treated alike.
    """
    spark, tasks = runs.sparkSession, shuffle_width(runs.sparkSession)
    total = runs.count()
    limit = max(256, total // (4 * tasks))
    common = runs.groupBy("key").count().where(F.col("count") > limit).select("key").collect()
    if not common:
        return runs
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["key"] for r in common], np.int64)))

    def deal(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            at = np.minimum(np.searchsorted(hot.value, keys), len(hot.value) - 1)
            on = hot.value[at] == keys
            if not on.all():
                yield batch.filter(pa.array(~on))
            rows = batch.filter(pa.array(on))
            if rows.num_rows:
                yield from emit(single(rows), _RUNS, lambda r: 96)

    def single(rows):
        for key, row_key, start, hashes, _, many in zip(*(rows.column(c).to_pylist() for c in _RUNS.names), strict=True):
            stretch = np.int64(key).tobytes()
            for k, (h, m) in enumerate(zip(np.frombuffer(hashes, np.int64).tolist(), many, strict=True)):
                yield h, row_key, start + k, stretch, None, bytes([m])

    return runs.mapInArrow(deal, _RUNS_DDL)


def repeated(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which (hash, key) pairs occur more than once."""
    order = np.lexsort((keys, hashes))
    h, k = hashes[order], keys[order]
    same = (h[1:] == h[:-1]) & (k[1:] == k[:-1])
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _spans(places: np.ndarray) -> bytes:
    """Runs of consecutive places as pairs (first, number)."""
    first = np.concatenate([[True], np.diff(places) != 1])
    at = np.flatnonzero(first)
    return np.column_stack([places[at], np.diff(np.append(at, len(places)))]).astype("<i4").tobytes()


def _candidates(parts, filters, window, block):
    """Document, place, hash and least stretch of each window that holds a hit."""
    docs, places, hashes, keys = [], [], [], []
    stretches = [rolling(p, block) for p in parts]
    every = np.concatenate(stretches)
    once = filters.seen_once(every)
    ends = np.cumsum([len(s) for s in stretches])
    for d, (words, s, end) in enumerate(zip(parts, stretches, ends, strict=True)):
        hit = once[end - len(s) : end].copy()
        aligned = np.flatnonzero(hit[::block]) * block
        if len(aligned):
            hit[aligned] = filters.seen_twice(s[aligned])
        if not hit.any():
            continue
        sums = np.concatenate([[0], np.cumsum(hit)])
        held = window - block + 1
        at = np.flatnonzero(sums[held:] > sums[:-held])
        docs.append(np.full(len(at), d))
        places.append(at)
        hashes.append(rolling(words, window)[at])
        keys.append(sliding_min(s, held)[at])
    if not docs:
        return None
    return tuple(map(np.concatenate, (docs, places, hashes, keys)))


class Confirmed:
    """Windows that a task has confirmed and sent, at most ``limit`` of them.

    They needn't be sent again; forgetting some costs rows, not results.
    """

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self.hashes, self.keys = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def has(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return (self.hashes[at] == hashes) & (self.keys[at] == keys)

    def add(self, hashes: np.ndarray, keys: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) <= self.limit:
            hashes, keys = np.concatenate([self.hashes, hashes]), np.concatenate([self.keys, keys])
        order = np.argsort(hashes, kind="stable")[: self.limit]
        self.hashes, self.keys = hashes[order], keys[order]


def _runs(ids, known, docs, places, hashes, keys):
    """Rows of a chunk: spans confirmed in it, then runs of windows to be confirmed."""
    order = np.lexsort((np.arange(len(hashes)), keys, hashes))
    h, k = hashes[order], keys[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
    n = np.diff(np.append(np.flatnonzero(new), len(h)))
    many = np.empty(len(h), bool)
    many[order] = np.repeat(n > 1, n)
    first = np.zeros(len(h), bool)
    first[order[new]] = True
    sent = known.has(hashes, keys)
    many |= sent
    first &= ~sent
    known.add(hashes[many & first], keys[many & first])

    at = np.flatnonzero(many)
    cuts = np.flatnonzero(np.diff(docs[at])) + 1
    for part in np.split(at, cuts) if len(at) else ():
        (row_key,) = ids[docs[part[0]]]
        yield None, row_key, None, None, _spans(places[part]), None

    at = np.flatnonzero(first)  # each window once
    d, p, key = docs[at], places[at], keys[at]
    cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(p) != 1) | (key[1:] != key[:-1])) + 1
    h, m, signed = hashes[at], many[at].astype(np.uint8), key.view(np.int64)
    for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.append(cuts, len(at)).tolist(), strict=True):
        if a < b:
            (row_key,) = ids[d[a]]
            yield int(signed[a]), row_key, int(p[a]), h[a:b].tobytes(), None, m[a:b].tobytes()


_MADE = ("doc_id", "n_words", "n_removed", "text", "spans")


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), chunk_words: int = CHUNK_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, n_words, n_removed, text, spans`` and ``carry``, one row per input row.

    Words (split at ASCII white space) that a window of ``window`` words covers
    whose words also start anywhere else, in the same text or another, are
    removed; windows are judged on the input. ``text``: kept words joined by one
    space; ``spans``: removed stretches as pairs (first word, words) of int32.
    Null and empty texts have no words; texts of under ``window`` words keep all,
    longer ones are read whole, however long; repeated rows repeat each other's
    windows. Other columns are ignored, whatever their names; a carried column that
    has a name of the result is an error; an empty table stays empty. A task looks
    at about ``chunk_words`` words at a time and ``max_bits`` bounds a filter;
    neither changes a result.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    own = document_columns(docs, id_col, text_col, carry)
    names, more = carried(own, carry, _MADE)
    spark = docs.sparkSession
    own = own.withColumn("row_key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(own.select("row_key", "text"), window, chunk_words, max_bits)
    spans = cut(spans.groupBy("row_key").agg(F.collect_set("spans").alias("found")))
    keys_of = lambda batches: (b.column("row_key").to_numpy().view(np.uint64) for b in batches)
    some = spark.sparkContext.broadcast(pair_filter(spans.select("row_key"), keys_of, bits_for(spans.count(), max_bits=max_bits)))
    held = ["doc_id", "text", *names]
    schema = "doc_id long, n_words long, n_removed long, text string, spans binary" + more

    def kept(text, found):
        words = text.encode().split() if text else []
        if not found:
            return len(words), 0, b" ".join(words).decode(), b""
        runs = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2)
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1] + window - 1, -1)
        gone = np.cumsum(edges[:-1]) > 0
        left = [words[i] for i in np.flatnonzero(~gone)]
        return len(words), int(gone.sum()), b" ".join(left).decode(), _spans(np.flatnonzero(gone))

    def batch_of(part, found):
        rows = [kept(*x) for x in zip(part.column("text").to_pylist(), found, strict=True)]
        n_words, n_removed, texts, runs = zip(*rows, strict=True)
        arrays = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string()), pa.array(runs, pa.binary())]
        return pa.RecordBatch.from_arrays([*arrays, *[part.column(c) for c in names]], names=[*_MADE, *carry])

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
            yield batch_of(part, part.column("found").to_pylist())

    joint = own.mapInArrow(chosen, own.schema).join(spans, "row_key", "left").select(*held, "found").mapInArrow(joined, schema)
    return own.mapInArrow(others, schema).unionByName(joint)
