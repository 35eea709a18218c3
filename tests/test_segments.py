"""Index segments: ranks after edits, work in proportion to an edit, merges, blocks that are skipped, edges."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarn.operators import segments
from tarn.operators.bm25 import Bm25
from tarn.operators.segments import BLOCK, Segments, counted
from tarn.plans import retrieval
from tarn.plans.base import ORACLES
from tests.helpers import same


def frame(spark, docs):
    rows = [(str(i), s, f"{s}{t}", t.split(), len(t.split())) for i, (s, t) in docs.items()]
    return spark.createDataFrame(rows, "chunk_id string, source string, mark string, terms array<string>, length long")


def brute(docs, terms, k, source=None):
    n = len(docs)
    average = sum(len(t.split()) for _, t in docs.values()) / n
    out = []
    for i, (s, text) in docs.items():
        c, words = Counter(text.split()), text.split()
        parts = []
        for t in sorted(set(terms)):
            df = sum(t in x.split() for _, x in docs.values())
            if c[t]:
                parts.append(math.floor(math.log1p((n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (1 - 0.75 + 0.75 * len(words) / average)) * 1e12 + 0.5))
        if parts and source in (None, s):
            out.append((-sum(parts), str(i)))
    return [(r + 1, i, round(-x / 1e12, 9)) for r, (x, i) in enumerate(sorted(out)[:k])]


def ranks(df):
    return sorted((r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def made(rng, ids):
    return {i: (f"s{i % 3}", " ".join(rng.choice("abcdefgh") + rng.choice(["", "x", "yy"]) for _ in range(rng.randint(0, 30)))) for i in ids}


def test_edits_equal_a_full_build(spark, tmp_path):
    rng = random.Random(7)
    docs = made(rng, range(400))
    index, state, now = Segments(spark, str(tmp_path), fan=3), None, {}
    for step in range(5):
        gone = [i for i in now if rng.random() < 0.2]
        new = {i: docs[i] for i in range(step * 90, step * 90 + 40) if i in docs} | made(rng, gone[: len(gone) // 2])
        now = {i: t for i, t in now.items() if i not in gone} | new
        added, removed = index.difference(state, frame(spark, now))
        state = index.update(state, counted(frame(spark, now).join(added, "chunk_id", "left_semi")), removed)
        assert (state["n_docs"], state["total_terms"]) == (len(now), sum(len(t.split()) for _, t in now.values()))
        for source in (None, "s1"):
            assert ranks(index.top_k(state, {0: ["a", "bx", "cyy", "nothing"]}, 12, source)) == brute(now, ["a", "bx", "cyy"], 12, source), (step, source)
    assert max(s["level"] for s in state["segments"]) >= 1 and len(state["segments"]) < 5
    got = {(r["term"], r["chunk_id"]): (r["tf"], r["length"], r["source"]) for r in index.postings(state, ["a", "hx"]).collect()}
    assert got == {(t, str(i)): (n, len(x.split()), s) for i, (s, x) in now.items() for t, n in Counter(x.split()).items() if t in ("a", "hx")}
    before = set(index.files.folders("docs"))
    index.clean([state])
    assert {f"segment={s['segment']}" for s in state["segments"]} == set(index.files.folders("docs")) < before
    assert ranks(index.top_k(state, {0: ["a"]}, 5)) == brute(now, ["a"], 5)


def test_an_edit_writes_what_it_changes(spark, tmp_path):
    rng = random.Random(1)
    docs = {i: ("s", " ".join(f"w{rng.randint(0, 5000)}" for _ in range(120))) for i in range(1500)}
    index = Segments(spark, str(tmp_path))
    state = index.update(None, counted(frame(spark, docs)))
    whole = sum(index.files.size(k) for k in ("docs", "blocks", "gone"))
    docs |= {5: ("s", "changed words"), 2000: ("s", "new words")}
    del docs[7]
    added, removed = index.difference(state, frame(spark, docs))
    assert {r[0] for r in added.collect()} == {"5", "2000"} and {r[0] for r in removed.collect()} == {"5", "7"}
    later = index.update(state, counted(frame(spark, docs).join(added, "chunk_id", "left_semi")), removed)
    assert sum(index.files.size(k) for k in ("docs", "blocks", "gone")) - whole < whole / 10
    assert ranks(index.top_k(later, {0: ["words", "w7"]}, 4)) == brute(docs, ["words", "w7"], 4)
    assert index.top_k(state, {0: ["changed"]}, 4).count() == 0  # the older state is as it was


def test_blocks_are_skipped(spark, tmp_path):
    """Short texts that say a word often lie together: blocks elsewhere can't reach the kth score and stay packed."""
    docs = {i: ("s", "word " * 9 if 3000 <= i < 3050 else "word " + "filler " * 30) for i in range(1000, 9000)}
    index = Segments(spark, str(tmp_path))
    state = index.update(None, counted(frame(spark, docs)))
    rows = index.top_k(state, {0: ["word"]}, 10).collect()
    assert [r["chunk_id"] for r in rows] == [str(i) for i in range(3000, 3010)]
    first = next(r for r in rows if r["rank"] == 1)
    assert first["blocks"] == -(-8000 // BLOCK) and first["opened"] < first["blocks"] / 3


def test_edges(spark, tmp_path):
    index = Segments(spark, str(tmp_path))
    none = frame(spark, {1: ("s", "x")}).limit(0)
    state = index.update(None, counted(none))
    assert state["segments"] == [] and index.top_k(state, {0: ["x"]}, 3).count() == 0 and index.postings(state, ["x"]).count() == 0
    state = index.update(state, counted(frame(spark, {1: ("s", ""), 2: (None, "x x")})), frame(spark, {9: ("s", "")}).select("chunk_id"))
    assert ranks(index.top_k(state, {0: ["x", "x"], 1: []}, 3)) == brute({1: ("s", ""), 2: ("", "x x")}, ["x"], 3)
    assert index.top_k(state, {0: []}, 3).count() == 0
    gone = index.update(state, counted(none), frame(spark, {1: ("s", ""), 2: ("s", "")}).select("chunk_id"))
    assert gone["n_docs"] == 0 and index.top_k(gone, {0: ["x"]}, 3).count() == 0
    with pytest.raises(ValueError):
        index.top_k(state, {0: ["x"]}, 0)
    with pytest.raises(ValueError):
        Bm25(k1=0)


def test_a_shard_holds_few_documents_and_postings(spark, tmp_path, monkeypatch):
    """What a search holds at once doesn't grow with the table or with its texts; older states are read as they were written."""
    rng = random.Random(3)
    docs = made(rng, range(300))
    postings = sum(len(set(t.split())) for _, t in docs.values())
    monkeypatch.setattr(segments, "SHARD_POSTINGS", 500)
    for most, shards in ((1000, -(-postings // 500)), (20, 15)):
        monkeypatch.setattr(segments, "SHARD", most)
        index = Segments(spark, str(tmp_path / str(most)))
        state = index.update(None, counted(frame(spark, docs)))
        assert state["segments"][0]["shards"] == max(shards, -(-postings // 500)) > 1
        gone = list(range(0, 300, 7))
        state = index.update(state, counted(frame(spark, docs).limit(0)), frame(spark, {i: docs[i] for i in gone}).select("chunk_id"))
        left = {i: x for i, x in docs.items() if i not in gone}
        for source in (None, "s1"):
            assert ranks(index.top_k(state, {0: ["a", "bx", "cyy", "nothing"]}, 12, source)) == brute(left, ["a", "bx", "cyy"], 12, source)
    monkeypatch.setattr(segments, "SHARD_POSTINGS", 1 << 30)
    monkeypatch.setattr(segments, "SHARD", 1000)
    index = Segments(spark, str(tmp_path / "older"))
    older = index.update(None, counted(frame(spark, docs)))
    assert older["segments"][0].pop("shards") == 1
    monkeypatch.setattr(segments, "SHARD", 20)
    assert ranks(index.top_k(older, {0: ["a", "bx"]}, 12)) == brute(docs, ["a", "bx"], 12)
    later = index.update(older, counted(frame(spark, docs).limit(0)), frame(spark, {i: docs[i] for i in gone}).select("chunk_id"))
    assert ranks(index.top_k(later, {0: ["a", "bx"]}, 12)) == brute(left, ["a", "bx"], 12)


@pytest.mark.parametrize("name", ["bm25_blocks", "segments_edited"])
def test_equals_sql(name, spark, sf, duck):
    same(getattr(retrieval, name)(spark, sf), duck, ORACLES[name])


def test_counted(spark):
    rows = frame(spark, {1: ("s", "b a b b c a"), 2: ("s", "")}).withColumn("terms", F.when(F.col("chunk_id") == "2", F.array().cast("array<string>")).otherwise(F.col("terms")))
    got = {r["chunk_id"]: [(t["term"], t["tf"]) for t in r["terms"]] for r in counted(rows).collect()}
    assert got == {"1": [("a", 2), ("b", 3), ("c", 1)], "2": []}
