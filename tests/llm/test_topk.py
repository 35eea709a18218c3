"""Exact top-k against brute force."""

import numpy as np
import pytest

from tarn.llm.topk import BallTree, inner, quantised, top_k


def brute(x, k):
    out = {}
    for q in x:
        best = sorted(((sum(a * b for a, b in zip(x[q], x[v], strict=True)), -v) for v in x if v != q and len(x[v]) == len(x[q])), reverse=True)[:k]
        out[q] = [(-i, s) for s, i in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_brute_force_with_many_shards_and_blocks(spark):
    rng = np.random.default_rng(1)
    x = {i: [int(v) for v in rng.integers(-9, 9, 6)] for i in range(300)}
    for i in range(100, 180):
        x[i] = x[0]  # a hot vector
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in x.items()], "vec_id long, vector array<double>")
    want = brute(x, 5)
    assert found(top_k(df, df, 5, shard_rows=40, block_rows=70)) == want
    assert found(top_k(df.where("vec_id % 50 = 0"), df, 5)) == {q: v for q, v in want.items() if q % 50 == 0}


def test_fewer_candidates_than_k_and_other_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 1.0]), (3, [9.0]), (3, [9.0])], "vec_id long, vector array<double>")
    assert found(top_k(df, df, 5)) == {1: [(2, 3)], 2: [(1, 3)]}
    assert top_k(df.limit(0), df, 5).collect() == [] and top_k(df, df.limit(0), 5).collect() == []


def test_quantised_leaves_out_what_has_no_place(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, None), (3, [0.1, None]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, []), (None, [1.0, 1.0]), (7, [-inf, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r[0], r[1]) for r in quantised(df).collect()] == [(1, [128.0, -1.0]), (6, [])]


def test_rows_of_one_id_and_empty_vectors(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [-1.0]), (2, [5.0]), (3, [7.0]), (4, []), (5, []), (None, [9.0]), (6, None)], "vec_id long, vector array<double>")
    rows = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, df, 5).collect() if r["query_id"] in (1, 4))
    assert rows == [(1, 1, 2, -5), (1, 1, 3, 7), (1, 2, 2, 5), (1, 2, 3, -7), (4, 1, 5, 0)]


def test_scores_beyond_doubles_are_ranked_exactly(spark):
    big = 2.0**30
    rows = [(i, [big + i % 3, big - i, float(i)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    x = {i: [int(v) for v in r] for i, r in rows}
    assert found(top_k(df.where("vec_id % 60 = 0"), df, 5, shard_rows=30)) == {q: v for q, v in brute(x, 5).items() if q % 60 == 0}


def test_nodes_are_taken_best_first():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 3, (200, 6)).round() for c in rng.normal(0, 300, (12, 6))])
    tree = BallTree.build(x, np.arange(len(x)), 32)
    q = x[:1]
    bound, seen, score = tree.bounds(q)[0], [], BallTree._score
    for i in range(1, len(bound)):
        assert bound[i] <= bound[(i - 1) // 2]
        a, b = tree.span[i]
        assert a == b or (q @ tree.x[a:b].T).max() <= bound[i]

    class Watched(BallTree):
        def _score(self, q, q_ids, rows, a, b, *more):
            seen.append(next(i for i in range(self.leaves - 1, len(self.span)) if tuple(self.span[i]) == (a, b)))
            score(self, q, q_ids, rows, a, b, *more)

    Watched(**tree.__dict__).search(q, np.array([0]), np.array([np.iinfo(np.int64).min]), 5)
    assert len(seen) < tree.leaves / 4 and all(bound[a] >= bound[b] for a, b in zip(seen, seen[1:], strict=False))


def test_tree_bounds_hold_everything():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (500, 8)).astype(float)
    tree = BallTree.build(x, np.arange(500), 16)
    q = rng.integers(-200, 200, (20, 8)).astype(float)
    best, ids = tree.search(q, np.full(20, -1), np.full(20, np.iinfo(np.int64).min), 5)
    scores = (q @ x.T).astype(int)
    for i in range(20):
        order = sorted(range(500), key=lambda j: (-scores[i, j], j))[:5]
        assert ids[i].tolist() == order and best[i].tolist() == scores[i, order].tolist()


def test_inner_is_exact_beyond_doubles():
    a = np.array([[2.0**40 + 1, 1.0]])
    assert inner(a, np.array([[2.0**20, 3.0]]))[0, 0] == (2**40 + 1) * 2**20 + 3
    with pytest.raises(OverflowError):
        inner(np.array([[2.0**60]]), np.array([[2.0**60]]))
