"""Matching, BM25, vectors, fusion: small inputs with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.functions.text import exact_terms, python_terms, terms
from tarn.operators import bm25, exact, fusion, vector
from tarn.plans.registry import QUERIES


def ranked(spark, texts, query, tokenizer=exact_terms, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, query)], "query_id long, text string")
    scored = bm25.scores(bm25.tokenised(docs, F.col("text"), tokenizer), bm25.query_terms(asked, F.col("text"), "query_id", tokenizer), **more)
    return [(r["doc_id"], r["score"]) for r in bm25.top_k(scored, 10).orderBy("rank").collect()]


def test_bm25_by_hand(spark):
    ((doc, score),) = ranked(spark, ["common common", "common rare", "common word"], "RARE")
    assert doc == 1 and score == pytest.approx(0.9808292530117263, abs=1e-6)


def test_bm25_frequency_and_length(spark):
    texts = ["ERR_RESET", "ERR_RESET ERR_RESET", "ERR_RESET " + "pad " * 30]
    assert [d for d, _ in ranked(spark, texts, "err_reset")] == [1, 0, 2]
    assert ranked(spark, texts, "err_reset err_reset") == ranked(spark, texts, "err_reset")


@pytest.mark.parametrize("held", [0, 1000])
def test_bm25_best_of_blocks(spark, monkeypatch, held):
    """Each task's best, summed in small blocks, are the best of all scores, ties by id; nulls and filters included."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(150)] + [None, "", "w1", "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = bm25.tokenised(docs, F.col("text"))
    asked = spark.createDataFrame([(q, " ".join(rng.sample(words, 3))) for q in range(9)] + [(9, "none of these"), (10, "!")], "query_id long, text string")
    asked = bm25.query_terms(asked, F.col("text"), "query_id")
    monkeypatch.setattr(bm25, "HELD_ROWS", held)
    monkeypatch.setattr(bm25, "CELLS", 40)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    for keep in (None, F.col("doc_id") % 3 == 1):
        found = bm25.best(tokens, asked, 7, keep=keep)
        assert rows(found) == rows(bm25.top_k(bm25.scores(tokens, asked, keep=keep), 7))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("MapInArrow" in plan and "Generate" not in plan) == bool(held)


def test_bm25_edges(spark):
    assert [d for d, _ in ranked(spark, ["Café", "tea"], "Café")] == [0]
    assert ranked(spark, ["a b", "c"], "!!!") == []
    assert [d for d, _ in ranked(spark, ["same x", "same y", "same z"], "same")] == [0, 1, 2]
    assert ranked(spark, [], "x") == []


def test_bm25_filter_leaves_statistics_alone(spark):
    texts = ["a b", "a c", "d"]
    whole = dict(ranked(spark, texts, "a"))
    assert dict(ranked(spark, texts, "a", keep=F.col("doc_id") == 1)) == {1: whole[1]}


def test_parameters():
    for bad in ({"k1": 0}, {"k1": math.inf}, {"b": 1.5}, {"b": -0.1}):
        with pytest.raises(ValueError):
            bm25.Bm25(**bad)


def test_terms_agree_where_they_should(spark):
    texts = ["Straße_1 naïve ÉTÉ", "x-y z_2", "", None, "日本 語"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", terms(F.col("t")).alias("a"), exact_terms("t").alias("b")).collect():
        assert list(r["a"]) == list(r["b"]) == python_terms(r["t"] or "")


def spans(df):
    return [(r["start_char"], r["end_char"]) for r in df.orderBy("ordinal").collect()]


def test_offsets(spark):
    one = lambda t: spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert spans(exact.literal_matches(one("éø foo foo"), "foo")) == [(3, 6), (7, 10)]
    assert spans(exact.pattern_matches(one("foo\nfoo"), "^")) == [(0, 0), (4, 4)]
    assert spans(exact.literal_matches(one("a+b aab"), "a+b")) == [(0, 3)]
    assert spans(exact.pattern_matches(one("a+b aab"), "a+b")) == [(4, 7)]
    assert spans(exact.literal_matches(one("😀x😀x"), "x")) == [(1, 2), (3, 4)]
    assert spans(exact.literal_matches(one("aaaa"), "aa")) == [(0, 2), (2, 4)]
    assert spans(exact.literal_matches(one("Ab aB"), "AB", ignore_case=True)) == [(0, 2), (3, 5)]
    assert spans(exact.literal_matches(one("q\\E.q"), "\\E.")) == [(1, 4)]
    assert spans(exact.literal_matches(one(None), "x")) == []
    assert spans(exact.literal_matches(one("é, " * 3000), ", ")) == [(3 * k + 1, 3 * k + 3) for k in range(3000)]


def test_offsets_need_no_shuffle(spark, sf):
    found = exact.literal_matches(spark.read.parquet(f"{sf}/documents.parquet"), "and ")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_by_whole_scores(spark):
    """At rank 100 neighbouring sums differ in the eighth digit."""
    lists = spark.range(1, 400).selectExpr("0L AS query_id", "'a' AS method", "CAST(1000 - id AS long) AS doc_id", "CAST(id AS int) AS rank")
    got = [r["doc_id"] for r in fusion.rrf(lists).orderBy("rank").collect()]
    assert got == [1000 - i for i in range(1, 400)]
    from fractions import Fraction

    both = [(0, m, d, r) for m, step in (("a", 7), ("b", 11)) for r, d in enumerate(((k * step) % 199 for k in range(199)), 1)]
    sums = {}
    for _, _, d, r in both:
        sums[d] = sums.get(d, Fraction(0)) + Fraction(1, 60 + r)
    df = spark.createDataFrame(both, "query_id long, method string, doc_id long, rank int")
    order = [r["doc_id"] for r in fusion.rrf(df).orderBy("rank").collect()]
    assert all(sums[a] > sums[b] or (sums[a] == sums[b]) for a, b in zip(order, order[1:], strict=False))


def test_hits_that_disagree_raise(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x")], "id string, content string")
    assert fusion.consistent(df, ["id"], ["content"]).count() == 3
    with pytest.raises(ValueError, match="disagree"):
        fusion.consistent(df.unionByName(df.limit(1).selectExpr("id", "'z' AS content")), ["id"], ["content"])


def test_bad_patterns_fail_on_an_empty_corpus(spark):
    import re

    with pytest.raises(re.error):
        exact.pattern_matches(spark.createDataFrame([], "doc_id long, text string"), "(")
    for bad in ("", "a\x00"):
        with pytest.raises(ValueError):
            exact.quoted(bad)


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [3.0, 0.0])], "query_id long, query_vector array<double>")
    got = [(r["vec_id"], r["score"]) for r in vector.cosine_top_k(q, v, 5).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (5, -1.0)]
    assert vector.cosine_top_k(q, v.limit(0), 5).collect() == []


def test_vector_problems(spark):
    rows = [(None,), ([1.0],), ([float("nan"), 0.0],), ([0.0, 0.0],), ([2.0, 0.0],), ([0.6, 0.8],)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert [r[0] for r in df.select(vector.validity(F.col("v"), 2)).collect()] == ["missing", "shape", "not_finite", "zero", "not_unit", None]


def fused(spark, rows, k):
    df = spark.createDataFrame(rows, "query_id long, method string, doc_id string, rank int")
    return [(r["doc_id"], r["score"]) for r in fusion.rrf(df, k).orderBy("rank").collect()]


def test_rrf(spark):
    rows = [(0, "lexical", "a", 1), (0, "lexical", "b", 2), (0, "semantic", "b", 1), (0, "semantic", "c", 2)]
    assert fused(spark, rows, 0) == [("b", 1.5), ("a", 1.0), ("c", 0.5)]
    twice = [(0, "x", "a", 1), (0, "x", "a", 2), (0, "x", "b", 3), (0, "y", "c", 1)]
    assert fused(spark, twice, 1) == [("a", 0.5), ("c", 0.5), ("b", 0.25)]
    with pytest.raises(ValueError):
        fusion.rrf(spark.createDataFrame(rows, "query_id long, method string, doc_id string, rank int"), -1)


def test_conflicts(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x"), ("b", "y")], "id string, content string")
    assert [r["id"] for r in fusion.conflicts(df, ["id"], ["content"]).collect()] == ["b"]


def test_rerank_and_its_ties(spark):
    df = spark.createDataFrame([(0, "b", 1, 9.0, 5.0), (0, "a", 2, 8.0, 5.0), (0, "c", 3, 7.0, 6.0)], "query_id long, doc_id string, rank int, score double, new double")
    order = lambda policy: [(r["doc_id"], r["input_rank"]) for r in fusion.rerank(df, F.col("new"), tie_policy=policy).orderBy("rank").collect()]
    assert order("identity") == [("c", 3), ("a", 2), ("b", 1)]
    assert order("input_rank") == [("c", 3), ("b", 1), ("a", 2)]


def test_scorer_must_be_finite(spark):
    df = spark.createDataFrame([("q", "t")], "q string, t string")
    assert df.select(fusion.scorer(lambda q, t: [2.5])("q", "t")).first()[0] == 2.5
    with pytest.raises(Exception, match="finite"):
        df.select(fusion.scorer(lambda q, t: [float("nan")])("q", "t")).collect()


def test_recall_asks_every_id_divisible_by_twenty(spark, sf):
    from tarn.plans.retrieval import ann_recall, cosine_topk

    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    for query in (ann_recall, cosine_topk):
        assert {r["query_id"] for r in query(spark, sf).collect()} == ids


def test_rrf_of_three_lists_is_exact(spark):
    """Scores are those of math.fsum for any three ranks, so that ties are ties."""
    rng = random.Random(6)
    rows = [(0, m, f"d{k}", rng.randint(1, 60)) for k in range(3000) for m in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "query_id long, method string, doc_id string, rank int")
    got = {r["doc_id"]: r["score"] for r in fusion.rrf(df).collect()}
    ranks = {}
    for _, _, d, r in rows:
        ranks.setdefault(d, []).append(r)
    assert got == {d: math.fsum(1 / (60 + r) for r in x) for d, x in ranks.items()}


def test_hybrid_refuses_hits_that_disagree(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query_id long, doc_id string, rank int, content string, index_id string")
    a, b = leg([(0, "x", 1, "one", "i"), (0, "y", 2, None, "i")]), leg([(0, "x", 1, "one", "i"), (0, "y", 2, "two", "i")])
    good = fusion.hybrid({"a": a, "b": b}, facts=("content",), index_col="index_id")
    assert [(r["doc_id"], r["rank"]) for r in good.orderBy("rank").collect()] == [("x", 1), ("y", 2)]
    with pytest.raises(Exception, match="disagree on content of x"):
        fusion.hybrid({"a": a, "b": leg([(0, "x", 3, "other", "i")])}, facts=("content",)).collect()
    with pytest.raises(Exception, match="several indexes"):
        fusion.hybrid({"a": a, "b": leg([(0, "x", 3, "one", "j")])}, index_col="index_id").collect()


def test_vectors_meet_queries_without_an_object_for_each(spark):
    """No product of partitions, which makes its left side many times, and no Python object for each vector."""
    df = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(60)], "vec_id long, embedding array<double>").repartition(3)
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = vector.cosine_top_k(asked, df, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "MapInPandas" not in plan


def test_lists_meet_queries_as_matrices(spark):
    """One hot list that all queries look into gives the exact hits, and no row for each pair."""
    df = spark.createDataFrame([(k, [float(k % 5), 1.0, float(k % 7)]) for k in range(300)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = vector.partitioned_top_k(asked, df, 10, cells=1)
    rows = lambda found: {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()}
    assert rows(near) == rows(vector.cosine_top_k(asked, df, 10))
    assert "zip_with(q#" not in near._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in near._jdf.queryExecution().optimizedPlan().toString()


def test_a_task_looks_up_a_bounded_number_of_terms(spark, monkeypatch):
    """Slices cover each batch once, in order, and hold ``TERMS`` terms at most, but for one document of more; null and empty lists are rows too."""
    import pyarrow as pa

    monkeypatch.setattr(bm25, "TERMS", 5)
    rows = [["a"] * 3, [], ["b"] * 2, ["c"], None, ["d"] * 9, ["e"] * 5, []]
    batch = pa.record_batch([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.string()))], ["doc_id", "terms"])
    pieces = list(bm25._pieces([batch, batch.slice(2, 3), batch.slice(0, 0)]))
    assert [p.column("doc_id").to_pylist() for p in pieces] == [[0, 1, 2], [3, 4], [5], [6, 7], [2, 3, 4]]
    docs = spark.createDataFrame([(i, [f"w{(i * j) % 11}" for j in range(i % 9)]) for i in range(60)], "doc_id long, terms array<string>").withColumn("length", F.size("terms").cast("long"))
    asked = spark.createDataFrame([(q, f"w{(q + j) % 11}") for q in range(6) for j in range(3)], "query_id long, term string")
    hits = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert hits(bm25.best(docs, asked, 4)) == hits(bm25.top_k(bm25.scores(docs, asked), 4))


@pytest.mark.parametrize("name", ["hybrid_topk", "evidence_merged", "rank_movement", "rerank_splice", "evidence_origins", "pack_budget", "rerank_input_ties", "rerank_overlap"])
def test_queries_rank_without_a_row_for_each_posting(spark, sf, name):
    """A query that needs few documents makes no row for each term of all: the memory of a task would grow with its documents."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow scored" in plan and "explode(terms" not in plan


def rows_from_python(df):
    """Rows that each Python stage of a query gave to Spark, once it is run."""
    df.collect()
    plans, found = [df._jdf.queryExecution().executedPlan()], []
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        elif name == "MapInArrowExec":
            found.append(plan.metrics().apply("pythonNumRowsReceived").value())
        plans += [plan.children().apply(n) for n in range(plan.children().size())]
    return found


@pytest.mark.parametrize("held", [1 << 20, 60, 0])
def test_a_task_passes_on_k_hits_a_query(spark, monkeypatch, held):
    """However many blocks of vectors a task has, what it passes on to be sorted is k rows a query; fewer held, more passed on, the same hits."""
    monkeypatch.setattr(vector, "HELD_HITS", held, raising=False)
    rng = random.Random(11)
    # four blocks of up to 4,096 vectors in one task, few distinct ones, so that most scores are ties
    rows = [(n, [float(rng.randint(-2, 2)) for _ in range(3)]) for n in rng.sample(range(50_000), 12_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(q, [1.0, float(q), -0.5]) for q in range(6)] + [(6, [0.0, 0.0, 0.0])], "query_id long, query_vector array<double>")
    found = vector.cosine_top_k(asked, df, 5)
    blocks, passed_on = sorted(rows_from_python(found))
    assert blocks == 4
    assert passed_on == 30 if held else passed_on >= 30
    q, x = F.col("query_vector"), F.col("embedding")
    pairs = df.crossJoin(asked).where((vector.norm(q) > 0) & (vector.norm(x) > 0)).select("query_id", "vec_id", F.round(vector.cosine(q, x), 12).alias("score"))
    hits = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    assert hits(found) == hits(bm25.top_k(pairs, 5, id_col="vec_id"))
