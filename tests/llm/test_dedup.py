"""Line, substring and near-duplicate removal against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm.bloom import PairFilter, bits_for, pair_filter, probes_for
from tarn.llm.common import words_of
from tarn.llm.components import connected_components, local_components
from tarn.llm.line_dedup import line_dedup
from tarn.llm.simhash import bands_of, fingerprint, links, near_duplicates
from tarn.llm.substring_dedup import Confirmed, rolling, sliding_min, substring_dedup

SPACES = " \t\n\x0b\x0c\r"


def texts(n, seed):
    """Short vocabularies, so that lines and passages repeat in many ways."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Ä", "ß", "日本"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 30))) for _ in range(8)]
    out = []
    for _ in range(n):
        lines = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 5))]
        out.append(rng.choice(["\n", " \n", "\n\t"]).join(lines))
    return [*out, None, "", "\n\n", " ", out[0], out[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 5, b"x") for i, t in rows], "doc_id long, text string, drop string, n_lines int, digest binary")


def brute_lines(rows, least=10):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACES))
    ids = [1 << 70 if i is None else i for i, _ in rows]
    holders = {}
    for i, (_, t) in zip(ids, rows, strict=True):
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, (own, t) in zip(ids, rows, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((own, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return [(i, *x[1:]) for (i, _), x in zip(rows, out, strict=True)]


def by_text(rows):
    return sorted(map(repr, rows))


def test_lines(spark):
    rows = list(enumerate(texts(120, 1))) + [(None, "w1 w2 w3 w4 w5 w6"), (7, "a second row of seven"), (500, "A SECOND ROW of seven  ")]
    got = [tuple(r) for r in line_dedup(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert by_text(got) == by_text(brute_lines(rows))
    assert any(r[2] for r in got)


def test_rarer_repeats_are_joined(spark):
    rows = list(enumerate(texts(120, 7))) + [(None, t) for t in texts(10, 7)] + [((1 << 63) - 1, "the greatest id there is"), (0, "the greatest id there is")]
    for common in (1, 5, 40):
        got = [tuple(r) for r in line_dedup(frame(spark, rows), common=common).select("doc_id", "n_lines", "n_dropped", "text").collect()]
        assert by_text(got) == by_text(brute_lines(rows)), common


def test_carried_columns_that_clash_are_an_error(spark):
    df = frame(spark, [(1, "x" * 10)])
    for bad in (("n_lines",), ("text",), ("DOC_ID",), ("drop", "drop")):
        with pytest.raises(ValueError, match="carry"):
            line_dedup(df, carry=bad)
    for bad in (("text",), ("Spans",)):
        with pytest.raises(ValueError, match="carry"):
            substring_dedup(df.withColumn("Spans", F.lit(1)), carry=bad)


def test_full_filters_change_no_result(spark):
    rows = list(enumerate(texts(60, 6)))
    got = [tuple(r) for r in line_dedup(frame(spark, rows), max_bits=64).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert by_text(got) == by_text(brute_lines(rows))
    got = [tuple(r) for r in substring_dedup(frame(spark, rows), 6, max_bits=64).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert by_text(got) == by_text(brute_substrings(rows, 6))


def test_lines_of_an_empty_table_and_carried_columns(spark):
    assert line_dedup(frame(spark, []).limit(0)).collect() == []
    out = line_dedup(frame(spark, [(1, "x" * 10), (2, "x" * 10)]), carry=("digest", "drop"))
    assert [(r["doc_id"], r["text"], bytes(r["digest"]), r["drop"]) for r in out.orderBy("doc_id").collect()] == [(1, "x" * 10, b"x", "k"), (2, "", b"x", "k")]


def brute_substrings(rows, window):
    words = [words_of(t) for _, t in rows]
    places = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + window))
    return [(i, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for (i, _), w, g in zip(rows, words, gone, strict=True)]


def test_substrings(spark):
    rows = list(enumerate(texts(150, 2))) + [(None, "w1 " * 40), (3, "w1 " * 40), (900, "one two three four five six seven eight")]
    for window, chunk in ((2, 500_000), (5, 60), (8, 200), (35, 90), (35, 500_000)):
        got = [tuple(r) for r in substring_dedup(frame(spark, rows), window, chunk_words=chunk).select("doc_id", "n_words", "n_removed", "text").collect()]
        assert by_text(got) == by_text(brute_substrings(rows, window)), window
    assert substring_dedup(frame(spark, []).limit(0)).collect() == []


def test_common_stretches_are_dealt_by_window(spark):
    passage = [f"p{i}" for i in range(30)]
    rng = random.Random(8)
    tails = [[f"t{k}_{i}" for i in range(20)] for k in range(40)]
    rows = [(k, " ".join([f"a{k}_{i}" for i in range(rng.randint(0, 30))] + passage + rng.choice(tails)[: rng.randint(2, 20)] + [f"b{k}"])) for k in range(900)]
    got = [tuple(r) for r in substring_dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert by_text(got) == by_text(brute_substrings(rows, 35))


def test_a_passage_found_at_any_offset(spark):
    passage = [f"p{i}" for i in range(36)]
    rows = [(k, " ".join([f"a{k}_{i}" for i in range(k)] + passage + [f"b{k}_{i}" for i in range(40)])) for k in range(0, 40)]
    assert {r["n_removed"] for r in substring_dedup(frame(spark, rows)).collect()} == {36}


def test_confirmed_windows_may_be_forgotten():
    known = Confirmed(limit=3)
    known.add(np.array([5, 1], np.uint64), np.array([50, 10], np.uint64))
    assert known.has(np.array([1, 5, 5, 7], np.uint64), np.array([10, 50, 51, 70], np.uint64)).tolist() == [True, True, False, False]
    known.add(np.array([9, 8, 7, 6], np.uint64), np.array([90, 80, 70, 60], np.uint64))
    assert len(known.hashes) == 3 and known.has(np.array([6], np.uint64), np.array([60], np.uint64)).all()


def test_rolling_depends_on_content_alone():
    a = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (rolling(a, 7)[20:] == rolling(a[20:], 7)).all() and len(rolling(a[:6], 7)) == 0
    x = np.array([5, 3, 8, 1, 9, 2, 7])
    for size in range(1, 8):
        assert sliding_min(x, size).tolist() == [min(x[i : i + size]) for i in range(8 - size)]


def test_filters_never_miss(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    twice, once = keys[:1000], keys[1000:]
    df = spark.createDataFrame([(int(k),) for k in [*keys, *twice]], "k long").repartition(7)
    whole = pair_filter(df, lambda batches: (b.column("k").to_numpy().astype(np.uint64) for b in batches), bits_for(6000))
    assert whole.seen_once(keys).all() and whole.seen_twice(twice).all()
    assert whole.seen_twice(once).mean() < 0.02
    assert [probes_for(10, 1 << b) for b in (0, 3, 4, 5, 6, 19)] == [1, 1, 1, 2, 4, 5]
    tight = pair_filter(df, lambda batches: (b.column("k").to_numpy().astype(np.uint64) for b in batches), 1 << 13, 1)
    assert tight.seen_once(keys).all() and tight.seen_twice(twice).all()
    own = PairFilter(1 << 19)
    own.add(np.array([1, 1, 2], np.uint64))
    own.add(np.array([2], np.uint64))
    assert own.seen_twice(np.array([1, 2, 3], np.uint64)).tolist() == [True, True, False]


def brute_fingerprint(text):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [*texts(40, 4), "ÀB Cd", "x", "x y", "A B C"]:
        assert fingerprint(text) == brute_fingerprint(text)


def brute_components(fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_links_span_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(8)} | {0, 1, 7, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for distance in (0, 1, 2, 3, 5):
        got = {r["node"]: r["root"] for r in connected_components(links(df, distance)).collect()}
        want = brute_components(fps, distance)
        groups = lambda names: sorted(sorted(i for i in range(len(fps)) if names[i] == n) for n in set(names))
        assert groups([got.get(s, s) for s in signed]) == groups(want), distance
    assert sum(b for _, b in bands_of(3)) == 64


def test_hot_cells_are_split(spark):
    """Fingerprints that share half their bits, so that one cell of a band holds them all."""
    rng = random.Random(6)
    half = 0x0123456789ABCDEF & ((1 << 32) - 1)
    base = [rng.getrandbits(32) for _ in range(60)]
    low = {(b ^ sum(1 << k for k in rng.sample(range(32), rng.randint(0, 3)))) << 32 | half ^ (1 << rng.randrange(32) if rng.random() < 0.3 else 0) for b in base for _ in range(12)}
    fps = sorted(low | {half << 32 | f >> 32 for f in low})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components(fps, 3)
    groups = lambda names: sorted(sorted(i for i in range(len(fps)) if names[i] == n) for n in set(names))
    for hot_cell in (5, 100, 20_000):
        got = {r["node"]: r["root"] for r in connected_components(links(df, 3, hot_cell)).collect()}
        assert groups([got.get(s, s) for s in signed]) == groups(want), hot_cell


def test_query_against_brute_force(spark, sf):
    """op10 on the whole table: fingerprints, links and smallest ids made here from the texts."""
    from tarn.llm.queries import op10_simhash

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    roots = brute_components(fps, 3)
    want = sorted((i, f"{f:016x}", docs[r][0]) for (i, _), f, r in zip(docs, fps, roots, strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in op10_simhash(spark, sf).collect()) == want


def test_near_duplicates(spark):
    rows = [(9, "the same words here"), (4, "The  same words HERE"), (6, "quite another text"), (None, None), (8, ""), (3, " \n"), (5, "quite another text"), (5, "quite another text")]
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect()))
    assert got == [(-1, 3), (3, 3), (4, 4), (5, 5), (5, 5), (6, 5), (8, 3), (9, 4)]
    assert near_duplicates(frame(spark, []).limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1100)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "u long, v long").repartition(6)
    for small in (0, 1_000_000):
        got = {r["node"]: r["root"] for r in connected_components(df, small=small).collect()}
        assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1100)}
    assert connected_components(df.limit(0)).collect() == []
    u, v = local_components(np.array([5, 9, 2]), np.array([9, 2, 7]))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {5: 2, 7: 2, 9: 2}
