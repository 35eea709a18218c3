"""Packing: plans, places, pieces."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarn.llm.packing import Capacity, pack, plan, token_pieces

WORD = public_tokenizers.path("word_bpe_49k.json")


def bins_of(places, counts):
    """Contents of each bin: (offset, length)."""
    bins = {}
    for n, count in counts.items():
        own = sorted(p[1:] for p in places if p[0] == n)
        for rank in range(count):
            first, q, b, offset = [p for p in own if p[0] <= rank][-1]
            bins.setdefault(b + (rank - first) // q, []).append((offset + (rank - first) % q * n, n))
    return bins


def check(bins, capacity):
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity.tokens and len(own) <= capacity.documents and sum(n * n for _, n in own) <= capacity.cost


def least_bins(counts, size=2048):
    """Bins that any packing needs: long pieces exclude each other (Martello and Toth's second bound)."""
    best = 0
    for k in [0, *(n for n in counts if n <= size // 2)]:
        long_ = sum(c for n, c in counts.items() if n > size - k)
        half = [(n, c) for n, c in counts.items() if size // 2 < n <= size - k]
        rest = sum(n * c for n, c in counts.items() if k <= n <= size // 2)
        room = sum((size - n) * c for n, c in half)
        best = max(best, long_ + sum(c for _, c in half) + max(0, math.ceil((rest - room) / size)))
    return best


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plans_keep_every_capacity(seed, rule):
    rng = random.Random(seed)
    capacity = Capacity(64, 5, 1500, rule=rule) if seed % 2 else Capacity(rule=rule)
    most, counts = min(capacity.tokens, math.isqrt(capacity.cost)), {}
    for _ in range(rng.randint(1, 200)):
        n = rng.randint(1, most)
        counts[n] = counts.get(n, 0) + rng.choice([1, 1, 9])
    bins = bins_of(plan(counts, capacity), counts)
    check(bins, capacity)
    assert sum(map(len, bins.values())) == sum(counts.values())
    if not seed % 2:
        assert len(bins) <= 11 / 9 * least_bins(counts) + 1


def test_plan_is_nearly_full_on_many_short_pieces():
    counts = {n: 400 for n in range(5, 900, 3)}
    places = plan(counts, Capacity())
    used = max(b + (counts[n] - r - 1) // q for n, r, q, b, _ in places) + 1
    assert used >= sum(n * c for n, c in counts.items()) / 2048
    assert len(bins_of(places, counts)) <= 1.002 * sum(n * c for n, c in counts.items()) / 2048 + 1


def test_too_long_or_bad():
    with pytest.raises(ValueError):
        plan({2049: 1}, Capacity())
    with pytest.raises(ValueError):
        Capacity(rule="best")
    assert plan({}, Capacity()) == []


def test_tables(spark):
    rows = [(i, 0, 1 + (i * 37) % 60) for i in range(300)] + [(400, 0, 7)] * 90 + [(500, 0, None), (501, 0, 0), (None, 0, 5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, piece int, length long, offset int")
    out = [r.asDict() for r in pack(df, Capacity(64, 6, 3700)).collect()]
    assert len(out) == len(rows)
    bins = {}
    for r in out:
        if not r["length"]:
            assert r["sequence_id"] is None and r["offset"] is None
        else:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    check(bins, Capacity(64, 6, 3700))
    assert pack(df.limit(0)).collect() == []


def test_pieces(spark):
    library = Tokenizer.from_file(WORD)
    rows = [(1, "some words " * 3000), (2, None), (3, ""), (3, ""), (None, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, piece int")
    got = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in token_pieces(docs, WORD).collect())
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), k // 2048, k, len(ids[k : k + 2048]), ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]
    assert got == sorted(want)
    assert token_pieces(docs.limit(0), WORD).collect() == []


def test_query(spark, sf):
    from tarn.llm.queries import QUERIES

    library = Tokenizer.from_file(WORD)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bins, n = {}, 0
    for r in QUERIES["op8_packing"](spark, sf).collect():
        ids = np.array([*library.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        n += r["length"]
    check(bins, Capacity())
    assert len(bins) <= math.ceil(n / 2048) + 1
