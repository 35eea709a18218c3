"""Near copies against brute-force fingerprints and Jaccard similarity of five-word shingles."""

import random

import xxhash

import corpus_pipeline
from tarn.llm.common import words_of
from tarn.llm.near import near_copies


def five_words(text):
    words = words_of((text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_fingerprint(text):
    words = words_of((text or "").lower())
    runs = [" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_similar(texts, least=0.8, bits=3):
    """The first place of each text's component."""
    sets, root, fps = [five_words(t) for t in texts], list(range(len(texts))), [brute_fingerprint(t) for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b) or (fps[i] ^ fps[j]).bit_count() <= bits:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def edited(words, rng, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"e{rng.random()}"
    return " ".join(out)


def copies(seed=3):
    """Texts with copies of similarities on both sides of 0.8, chains of them, and edge cases."""
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        out += [" ".join(base), " ".join(base).upper(), *(edited(base, rng, max(1, len(base) * k // 1000)) for k in (8, 15, 20, 22, 25, 30, 60))]
    chain = [f"c{k}" for k in range(104)]
    out += [" ".join(chain[k : k + 90]) for k in range(0, 15, 3)]
    return [*out, None, "", " \n", "a b", "A  b", "a b c", "q q q q q", "q q q q q q q"]


def frame(spark, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    return out.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS long) AS n_chars")


def test_components_are_those_of_all_similar_pairs(spark):
    texts = copies()
    want = brute_similar(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 1 < len(set(want)) < len(texts)
    assert near_copies(frame(spark, []).limit(0)).collect() == []


def test_the_stage_keeps_one_of_each_similar_group(spark):
    texts = copies(4)
    kept = corpus_pipeline.near_dedup(spark, frame(spark, list(enumerate(texts))), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_similar(texts)))


def test_the_stage_decides_by_row(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    rows = [(None, x), (None, x), (None, x.upper()), (5, x), (None, y), (None, y), (7, z), (7, z), (9, z), (9, "a text of its own, like no other"), (9, "and one more of that id")]
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    want = [(5, x), (None, y), (7, z), (9, "a text of its own, like no other"), (9, "and one more of that id")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(want, key=str)
    assert all((r["lang"], r["source"], r["n_chars"]) == ("en", "s", len(r["text"])) for r in kept)
