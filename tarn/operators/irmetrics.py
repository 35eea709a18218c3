"""Ranking metrics, in the three conventions that must not be mixed.

``exponential``: gain 2^g - 1, grades above 0 are relevant, reciprocal rank over
the whole list. ``judged``: relevant from a threshold on, reciprocal rank within
the cut-off, precision and assessed share over the cut-off, padded with zeros.
``linear``: gain g, several cut-offs, reciprocal rank within each.

An undefined value (nothing relevant) is null and is left out of means; defined
counts stand beside each mean.

``ranked``: ``query_id, doc_id, rank`` (1-based, no repeats); ``qrels``:
``query_id, doc_id, grade``. Every query of either table gives a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.stats import percentiles

_KEYS = ["query_id", "doc_id"]


def _discount(rank: Column) -> Column:
    return F.log2(rank + 1)


def _gain(grade: Column, exponential: bool) -> Column:
    return F.pow(F.lit(2.0), grade) - 1 if exponential else grade.cast("double")


def _judged_rows(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Both tables as one: ``rank`` null for what wasn't returned, ``grade`` for what wasn't judged."""
    return ranked.select(*_KEYS, "rank").join(qrels.select(*_KEYS, "grade"), _KEYS, "full")


def _ideal(qrels: DataFrame, cutoffs: list[int], exponential: bool) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    placed = qrels.where("grade > 0").withColumn("_i", F.row_number().over(order))
    value = _gain(F.col("grade"), exponential) / _discount(F.col("_i"))
    return placed.groupBy("query_id").agg(*[F.sum(F.when(F.col("_i") <= k, value)).alias(f"_ideal{k}") for k in cutoffs])


def _dcg(k: int, exponential: bool) -> Column:
    hit = (F.col("rank") <= k) & F.col("grade").isNotNull()
    return F.coalesce(F.sum(F.when(hit, _gain(F.col("grade"), exponential) / _discount(F.col("rank")))), F.lit(0.0))


def _share(n: Column, of: Column) -> Column:
    return F.try_divide(n.cast("double"), of.cast("double"))


def exponential(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, recall, mrr, ndcg``: recall and gain at ``k``, reciprocal rank of the whole list."""
    relevant = F.coalesce(F.col("grade"), F.lit(0)) > 0
    rows = _judged_rows(ranked, qrels)
    total = F.count_if(relevant)
    out = rows.groupBy("query_id").agg(
        total.alias("_total"),
        F.count_if(relevant & (F.col("rank") <= k)).alias("_found"),
        F.min(F.when(relevant, F.col("rank"))).alias("_first"),
        _dcg(k, True).alias("_dcg"),
    )
    out = out.join(_ideal(qrels, [k], True), "query_id", "left")
    defined = F.col("_total") > 0
    return out.select(
        "query_id",
        _share(F.col("_found"), F.col("_total")).alias("recall"),
        F.when(defined, F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        F.try_divide("_dcg", f"_ideal{k}").alias("ndcg"),
    )


def judged(ranked: DataFrame, qrels: DataFrame, k: int = 10, threshold: int = 2) -> DataFrame:
    """``query_id, recall, mrr, ndcg, precision, assessed, returned, unassessed`` at ``k``."""
    if not 1 <= threshold <= 3:
        raise ValueError("the threshold is from 1 to 3")
    relevant = F.coalesce(F.col("grade"), F.lit(0)) >= threshold
    top = F.col("rank") <= k
    rows = _judged_rows(ranked, qrels)
    out = rows.groupBy("query_id").agg(
        F.count_if(relevant).alias("_total"),
        F.count_if(relevant & top).alias("_found"),
        F.min(F.when(relevant & top, F.col("rank"))).alias("_first"),
        F.count_if(top).alias("returned"),
        F.count_if(top & F.col("grade").isNull()).alias("unassessed"),
        _dcg(k, True).alias("_dcg"),
    )
    out = out.join(_ideal(qrels, [k], True), "query_id", "left")
    defined = F.col("_total") > 0
    return out.select(
        "query_id",
        _share(F.col("_found"), F.col("_total")).alias("recall"),
        F.when(defined, F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        F.try_divide("_dcg", f"_ideal{k}").alias("ndcg"),
        F.when(defined, F.col("_found") / F.lit(float(k))).alias("precision"),
        ((F.col("returned") - F.col("unassessed")) / F.lit(float(k))).alias("assessed"),
        "returned",
        "unassessed",
    )


def linear(ranked: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (10, 100)) -> DataFrame:
    """``query_id`` and ``ndcg_k, recall_k, mrr_k`` for each cut-off, with linear gain."""
    relevant = F.coalesce(F.col("grade"), F.lit(0)) > 0
    rows = _judged_rows(ranked, qrels)
    found = [F.count_if(relevant).alias("_total")]
    for k in cutoffs:
        top = F.col("rank") <= k
        found += [
            F.count_if(relevant & top).alias(f"_found{k}"),
            F.min(F.when(relevant & top, F.col("rank"))).alias(f"_first{k}"),
            _dcg(k, False).alias(f"_dcg{k}"),
        ]
    out = rows.groupBy("query_id").agg(*found).join(_ideal(qrels, list(cutoffs), False), "query_id", "left")
    columns = []
    for k in cutoffs:
        columns += [
            F.try_divide(f"_dcg{k}", f"_ideal{k}").alias(f"ndcg_{k}"),
            _share(F.col(f"_found{k}"), F.col("_total")).alias(f"recall_{k}"),
            F.when(F.col("_total") > 0, F.coalesce(1.0 / F.col(f"_first{k}"), F.lit(0.0))).alias(f"mrr_{k}"),
        ]
    return out.select("query_id", *columns)


def aspects(ranked: DataFrame, supports: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """``query_id, alpha_ndcg, aspect_recall``.

    ``supports``: ``query_id, aspect_id, weight, doc_id``, each document under one
    aspect of a query. Another document of an aspect already seen gains
    (1 - alpha) times as much; weights are normalised within the query.
    """
    if not 0 <= alpha <= 1 or k < 1:
        raise ValueError("alpha is from 0 to 1, k positive")
    weights = supports.select("query_id", "aspect_id", "weight").distinct()
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id"))
    weights = weights.select("query_id", "aspect_id", share.alias("share"))
    rows = supports.select("query_id", "aspect_id", "doc_id").join(weights, ["query_id", "aspect_id"])

    def gain(order):
        nth = F.row_number().over(Window.partitionBy("query_id", "aspect_id").orderBy(order)) - 1
        return F.col("share") * F.pow(F.lit(1.0 - alpha), nth)

    hits = rows.join(ranked.where(F.col("rank") <= k).select(*_KEYS, "rank"), _KEYS)
    got = hits.withColumn("_g", gain("rank")).groupBy("query_id").agg(F.sum(F.col("_g") / _discount(F.col("rank"))).alias("_dcg"))
    recall = hits.select("query_id", "aspect_id", "share").distinct().groupBy("query_id").agg(F.sum("share").alias("_recall"))
    best = rows.withColumn("_g", gain("doc_id"))
    best = best.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_g"))))
    ideal = best.where(F.col("_i") <= k).groupBy("query_id").agg(F.sum(F.col("_g") / _discount(F.col("_i"))).alias("_ideal"))
    out = ideal.join(got, "query_id", "left").join(recall, "query_id", "left")
    zero = F.lit(0.0)
    return out.select(
        "query_id",
        F.try_divide(F.coalesce("_dcg", zero), F.col("_ideal")).alias("alpha_ndcg"),
        F.coalesce("_recall", zero).alias("aspect_recall"),
    )


def neighbour_recall(exact: DataFrame, approximate: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """``query_id, recall, same_order, max_delta`` of an approximate list against the exact one."""
    a = exact.where(F.col("rank") <= k).select("query_id", id_col, F.col("rank").alias("r"), F.col("score").alias("s"))
    b = approximate.where(F.col("rank") <= k).select("query_id", id_col, F.col("rank").alias("r2"), F.col("score").alias("s2"))
    both = a.join(b, ["query_id", id_col], "full")
    return both.groupBy("query_id").agg(
        F.try_divide(F.count_if(F.col("r").isNotNull() & F.col("r2").isNotNull()).cast("double"), F.count("r").cast("double")).alias("recall"),
        F.min(F.coalesce(F.col("r") == F.col("r2"), F.lit(False))).alias("same_order"),
        F.max(F.abs(F.col("s") - F.col("s2"))).alias("max_delta"),
    )


def macro(values: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of each metric over its defined rows (6 digits), and how many there are."""
    cells = [c for m in metrics for c in (F.round(F.avg(m), 6).alias(f"mean_{m}"), F.count(m).alias(f"defined_{m}"))]
    return values.groupBy(*(by or [])).agg(F.count("*").alias("cases"), *cells)


def latency(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Mean, linearly interpolated p50 and p95, and greatest value; exact, whatever a group's size."""
    own = by or []
    sums = values.groupBy(*own).agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.max(column).alias("most"))
    points = percentiles(values, column, [0.5, 0.95], own).select(*own, F.round("p0", 6).alias("p50"), F.round("p1", 6).alias("p95"))
    rows = sums.join(points, own, "left") if own else sums.crossJoin(points)
    return rows.select(*own, "n", "mean", "p50", "p95", "most")


def movement(before: DataFrame, after: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``query_id, <id>, before, after, gained`` of each hit of either list."""
    a = before.select("query_id", id_col, F.col("rank").alias("before"))
    b = after.select("query_id", id_col, F.col("rank").alias("after"))
    return a.join(b, ["query_id", id_col], "full").withColumn("gained", F.col("before") - F.col("after"))


def stage_attribution(stages: DataFrame, qrels: DataFrame) -> DataFrame:
    """``query_id, stage, recall``: share of relevant documents that each stage still has.

    ``stages``: ``query_id, stage, doc_id``. A query without relevant documents gives null.
    """
    relevant = qrels.where("grade > 0").select("query_id", "doc_id").distinct()
    total = relevant.groupBy("query_id").agg(F.count("*").alias("total"))
    held = stages.select("query_id", "stage", "doc_id").distinct()
    found = held.join(relevant, ["query_id", "doc_id"]).groupBy("query_id", "stage").agg(F.count("*").alias("found"))
    every = held.select("query_id", "stage").distinct()
    out = every.join(total, "query_id", "left").join(found, ["query_id", "stage"], "left")
    return out.select("query_id", "stage", F.try_divide(F.coalesce("found", F.when(F.col("total").isNotNull(), 0)).cast("double"), F.col("total").cast("double")).alias("recall"))


def stage_aspects(stages: DataFrame, supports: DataFrame) -> DataFrame:
    """``query_id, stage, coverage``: weighted share of a query's aspects that a stage still has a document of.

    ``stages``: ``query_id, stage, doc_id``; ``supports``: ``query_id, aspect_id,
    weight, doc_id``. A query without aspects gives null.
    """
    aspects = supports.select("query_id", "aspect_id", "weight").distinct()
    total = aspects.groupBy("query_id").agg(F.sum("weight").alias("total"))
    held = stages.select("query_id", "stage", "doc_id").distinct()
    covered = held.join(supports, ["query_id", "doc_id"]).select("query_id", "stage", "aspect_id", "weight").distinct()
    covered = covered.groupBy("query_id", "stage").agg(F.sum("weight").alias("got"))
    rows = held.select("query_id", "stage").distinct().join(total, "query_id", "left").join(covered, ["query_id", "stage"], "left")
    return rows.select("query_id", "stage", F.try_divide(F.coalesce("got", F.when(F.col("total").isNotNull(), 0.0)), F.col("total")).alias("coverage"))


def failure_tags(stages: DataFrame, qrels: DataFrame, order: list[str]) -> DataFrame:
    """``query_id, tags``: which steps lost relevant documents; several may apply.

    ``order``: stages from first to last. ``missed_<first>`` means that the first
    stage never had a relevant document, ``lost_at_<stage>`` that the stage
    dropped one, ``none`` that nothing was lost.
    """
    relevant = qrels.where("grade > 0").groupBy("query_id").agg(F.collect_set("doc_id").alias("_rel"))
    held = stages.groupBy("query_id").pivot("stage", order).agg(F.collect_set("doc_id"))
    rows = relevant.join(held, "query_id", "left")
    sets = {s: F.array_intersect(F.col("_rel"), F.coalesce(F.col(f"`{s}`"), F.slice(F.col("_rel"), F.lit(1), F.lit(0)))) for s in order}
    tags = [F.when(F.size(F.array_except(F.col("_rel"), sets[order[0]])) > 0, f"missed_{order[0]}")]
    for a, b in zip(order, order[1:], strict=False):
        tags.append(F.when(F.size(F.array_except(sets[a], sets[b])) > 0, f"lost_at_{b}"))
    found = F.array_compact(F.array(*tags))
    return rows.select("query_id", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none"))).alias("tags"))


def tag_counts(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
