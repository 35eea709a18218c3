"""Reciprocal-rank fusion, reranking and what is measured between stages."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_sum(ranks: Column, k: int) -> Column:
    """Sum of 1 / (k + rank) of an array of ranks, as if it were added exactly and rounded once.

    What each addition loses is kept beside the sum, so the order of the lists is of no
    account and equal votes give equal scores.
    """
    first = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost"))

    def add(state: Column, rank: Column) -> Column:
        x = F.lit(1.0) / (k + rank)
        total = state["sum"] + x
        kept = total - state["sum"]
        lost = (state["sum"] - (total - kept)) + (x - kept)
        return F.struct(total.alias("sum"), (state["lost"] + lost).alias("lost"))

    return F.aggregate(F.sort_array(ranks, asc=False), first, add, lambda s: s["sum"] + s["lost"])


def rrf(lists: DataFrame, k: int = 60, query_id: str = "query_id", list_col: str = "method", id_col: str = "doc_id", facts: tuple[str, ...] = ()) -> DataFrame:
    """``<query_id>, <id>, score, votes, rank``: sum of 1 / (k + rank) over the lists.

    ``lists``: one row a hit with its list and 1-based rank. ``votes`` says which
    list gave which rank. Ranks are by the sum itself; ties go by identity. Hits of one
    identity that have two known values of a column in ``facts`` raise when they are read.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    first = lists.groupBy(query_id, list_col, id_col).agg(F.min("rank").alias("rank"), *[F.collect_set(c).alias(c) for c in facts])
    vote = F.struct(F.col(list_col), F.col("rank"))
    known = [F.size(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in facts]
    fused = first.groupBy(query_id, id_col).agg(F.sort_array(F.collect_list(vote)).alias("votes"), *known)
    score = reciprocal_sum(F.transform("votes", lambda v: v["rank"]), k)
    for c in facts:
        score = F.when(F.col(c) > 1, F.raise_error(F.concat(F.lit(f"hits disagree on {c} of "), F.col(id_col).cast("string")))).otherwise(score)
    fused = fused.withColumn("score", score).select(query_id, id_col, "score", "votes")
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return fused.withColumn("rank", F.row_number().over(order))


def conflicts(hits: DataFrame, identity: list[str], facts: list[str]) -> DataFrame:
    """Identities that have several known values of a fact; none may be fused. A null is unknown."""
    counts = [F.count_distinct(F.col(c)).alias(c) for c in facts]
    wrong = reduce(lambda a, b: a | b, [F.col(c) > 1 for c in facts])
    return hits.groupBy(*identity).agg(*counts).where(wrong)


def consistent(hits: DataFrame, identity: list[str], facts: list[str]) -> DataFrame:
    """The hits, once it is sure that no identity has two values of a fact; else it raises."""
    if odd := conflicts(hits, identity, facts).limit(1).collect():
        raise ValueError(f"hits disagree on {odd[0].asDict()}")
    return hits


def hybrid(legs: dict[str, DataFrame], candidates: int = 20, k: int = 60, top_k: int = 10, query_id: str = "query_id", id_col: str = "doc_id", facts: tuple[str, ...] = (), index_col: str | None = None) -> DataFrame:
    """Fuses the first ``candidates`` of each leg and keeps ``top_k``.

    With ``index_col`` every hit says which index it is from, and all must name one;
    ``facts`` as in :func:`rrf`. Either fault raises when the result is read.
    """
    if not 1 <= top_k <= candidates:
        raise ValueError("top_k must be from 1 to candidates")
    parts = [df.where(F.col("rank") <= candidates).select(query_id, F.lit(name).alias("method"), id_col, "rank", *facts, *([index_col] if index_col else [])) for name, df in sorted(legs.items())]
    hits = reduce(DataFrame.unionByName, parts)
    if index_col:
        own, every = F.col(index_col), Window.partitionBy(query_id)
        apart = own.isNull() | (F.min(index_col).over(every) != F.max(index_col).over(every))
        hits = hits.withColumn("rank", F.when(apart, F.raise_error(F.lit("hits come from several indexes")).cast("int")).otherwise(F.col("rank")))
    fused = rrf(hits, k, query_id, "method", id_col, facts)
    return fused.where(F.col("rank") <= top_k)


def depth_arms(lists: DataFrame, depths: list[int], pool: int = 20, k: int = 60, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """The same frozen lists fused at several depths; ``depth`` tells the arms apart."""
    spark = lists.sparkSession
    arms = F.broadcast(spark.createDataFrame([(d,) for d in depths], "depth int"))
    cut = lists.crossJoin(arms).where(F.col("rank") <= F.col("depth"))
    first = cut.groupBy("depth", query_id, "method", id_col).agg(F.min("rank").alias("rank"))
    fused = first.groupBy("depth", query_id, id_col).agg(reciprocal_sum(F.collect_list("rank"), k).alias("score"))
    order = Window.partitionBy("depth", query_id).orderBy(F.desc("score"), id_col)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)


def rerank(hits: DataFrame, score: Column, query_id: str = "query_id", id_col: str = "doc_id", tie_policy: str = "identity") -> DataFrame:
    """Frozen candidates in the order of a new score.

    Keeps ``input_rank, input_score``; adds ``score, rank`` and ``movement`` (places
    gained). Ties go by identity, or by ``input_rank`` under that policy.
    """
    if tie_policy not in ("identity", "input_rank"):
        raise ValueError(f"unknown tie policy: {tie_policy}")
    renamed = hits.withColumnsRenamed({"rank": "input_rank", "score": "input_score"})
    scored = renamed.withColumn("score", score)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col if tie_policy == "identity" else "input_rank")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("movement", F.col("input_rank") - F.col("rank"))


def overlap_score(query_terms: Column, doc_terms: Column) -> Column:
    """A deterministic scorer: share of the query's distinct terms in the document."""
    asked = F.array_distinct(query_terms)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, doc_terms)), F.size(asked)), F.lit(0.0))


def scorer(fn, return_type: str = "double"):
    """A scorer over (query, text) batches, such as a cross-encoder, as a column function.

    ``fn`` takes two pandas series and gives one finite number for each row.
    """

    @F.pandas_udf(return_type)
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        values = pd.Series(fn(query, text), index=query.index, dtype="float64")
        if len(values) != len(query) or not values.map(lambda v: v == v and abs(v) != float("inf")).all():
            raise ValueError("a scorer gives one finite score for each candidate")
        return values

    return score


def splice(reranked: DataFrame, fused: DataFrame, depth: int = 20, limit: int = 100, query_id: str = "query_id", id_col: str = "source") -> DataFrame:
    """The fused list's first ``depth`` as reranked, then its own order from there to ``limit``.

    ``reranked``: those first hits under a new order, ``input_rank`` their fused one.
    """
    head = reranked.where(F.col("input_rank") <= depth).select(query_id, id_col, "rank")
    tail = fused.where((F.col("rank") > depth) & (F.col("rank") <= limit)).select(query_id, id_col, "rank")
    return head.unionByName(tail)


def first_per_source(hits: DataFrame, source_col: str = "source", query_id: str = "query_id", limit: int | None = None) -> DataFrame:
    """Each source's first hit, ranked anew; at most ``limit`` a query."""
    own = Window.partitionBy(query_id, source_col).orderBy("rank")
    first = hits.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    order = Window.partitionBy(query_id).orderBy("hit_rank")
    ranked = first.withColumnRenamed("rank", "hit_rank").withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
