"""The byte network: coverage, training, scores."""

import random
import zlib

import numpy as np

from tarn.llm.quality_cnn import CHUNK, HOP, Network, TrainingBound, _gradients, chunk_starts, fit, fold, score, train, training_rows


def sample(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.7
        out.append((" ".join(words if good else [w + rng.choice(["###", "$$$", "!!"]) for w in words]), int(good)))
    return out


def test_chunks_cover_every_block():
    for blocks in range(1, 60):
        starts = chunk_starts(blocks)
        assert set(range(blocks)) <= {s + k for s in starts for k in range(CHUNK)}
        assert (np.diff(starts) == HOP).all() and HOP < CHUNK


def test_maxima_see_the_whole_text():
    net = Network.fresh(1)
    text = bytes(random.Random(2).choice(b"abcdef ") for _ in range(9000))
    naive = np.array([sum(net.table[j][text[p + j]] for j in range(8)) for p in range(0, len(text) - 7, 2)])
    np.testing.assert_allclose(net.chunk_maxima(text).max(axis=0), naive.max(axis=0), rtol=1e-4, atol=1e-4)
    np.testing.assert_allclose(net.chunk_maxima(text, at_once=8), net.chunk_maxima(text), rtol=1e-4, atol=1e-4)


def test_held_out_accuracy():
    rows = sample(400, 3)
    net = train([t.encode() for t, _ in rows], [y for _, y in rows], TrainingBound(epochs=6))
    held = sample(200, 4)
    assert np.mean([(net.score(t.encode()) >= 0.5) == y for t, y in held]) > 0.95
    assert all(0 <= net.score(x) <= 1 for x in (b"", b"a", "é".encode() * 40_000))


def test_same_seed_same_network():
    rows = sample(60, 5)
    nets = [train([t.encode() for t, _ in rows], [y for _, y in rows], TrainingBound(epochs=2)) for _ in range(2)]
    assert all((a == b).all() for a, b in zip(nets[0].weights, nets[1].weights, strict=True))


def test_tables(spark):
    rows = [(1, "plain words"), (None, "no id"), (3, None), (4, ""), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(i, t, 0.5, "en") for i, t in rows], "doc_id long, text string, score double, lang string")
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (4, None)], "doc_id long, quality int")
    net = fit(docs, labels)
    got = score(docs, net, carry=("lang",)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["lang"] == "en" for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert score(docs.limit(0), net).collect() == []
    assert fit(docs.limit(0), labels).score(b"x") >= 0 and fit(docs, labels.limit(0)).score(b"x") >= 0


def test_fold_is_crc32(spark):
    got = spark.range(300).select("id", fold("id").alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_query_on_the_fixture(spark):
    from tarn.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op4_quality_cnn"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.85


def brute_score(net, text):
    """The network read off its weights: no pair tables, no blocks at a time."""
    data = text + b"\0" * (max(8, len(text) + len(text) % 2) - len(text))
    places = range(0, len(data) - 7, 2)
    response = np.array([np.sum([net.table[j][data[p + j]].astype(np.float64) for j in range(8)], axis=0) for p in places])
    blocks = [response[b : b + 32].max(axis=0) for b in range(0, len(response), 32)]
    starts = range(0, max(1, len(blocks) - 4 + 3), 3)
    chunks = np.maximum([np.max(blocks[s : s + 4], axis=0) + net.shift for s in starts], 0)
    hidden = np.maximum(np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)]) @ net.w1 + net.b1, 0)
    return float(1 / (1 + np.exp(-(hidden @ net.w2 + net.b2)[0])))


def test_query_against_a_plain_forward_pass(spark, sf):
    """Scores of op4 on the whole table, from the same weights by the definition."""
    from tarn.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    got = {r["doc_id"]: r for r in QUERIES["op4_quality_cnn"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert abs(r["score"] - brute_score(net, texts[i])) < 1e-3
        assert r["predicted"] == int(r["score"] >= 0.3)
    for text in (b"", b"a", b"ab" * 4, bytes(range(256)) * 9):
        assert abs(net.score(text) - brute_score(net, text)) < 1e-3


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (3, 70, 400, 900)]
    y = np.array([1, 0, 1, 0], np.float32)
    net = Network.fresh(3)

    def loss():
        p = np.array([brute_score(net, t) for t in texts])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for w, g in zip(net.weights, _gradients(net, texts, y), strict=True):
        for k in np.argsort(-np.abs(g.ravel()))[:3]:
            at, step = np.unravel_index(k, w.shape), 1e-2
            old = w[at]
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_an_id_labelled_both_ways_counts_as_zero(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (2, 7)], "doc_id long, quality int")
    usable = {i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5}
    for n in (1, 5):
        texts, y = training_rows(docs, labels.repartition(n))
        assert dict(zip(texts, y, strict=True)) == {t: v for i, t, v in ((1, b"a", 0), (2, b"b", 1)) if i in usable}
