"""Intervals of evidence: merging, coverage, facets.

Two rules of merging exist and stay apart: packing keeps spans that only touch
separate (:func:`merged` with ``touching=False``), counting evidence joins them.
Spans are end-exclusive code-point places.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(spans: DataFrame, keys: list[str], touching: bool) -> DataFrame:
    """Adds ``_island``: a running number of the merged span that a row belongs to."""
    order = Window.partitionBy(*keys).orderBy("start_char", "end_char", *([c for c in ("rank",) if c in spans.columns]))
    before = F.max("end_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start_char") > before if touching else F.col("start_char") >= before
    new = F.when(before.isNull() | apart, 1).otherwise(0)
    flagged = spans.withColumn("_new", new)
    return flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged(spans: DataFrame, keys: list[str], touching: bool) -> DataFrame:
    """``keys, start_char, end_char, parts`` and, where spans have one, the least ``rank``."""
    rank = [F.min("rank").alias("rank")] if "rank" in spans.columns else []
    joined = _islands(spans, keys, touching).groupBy(*keys, "_island")
    out = joined.agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.count("*").alias("parts"), *rank)
    return out.drop("_island")


def merged_evidence(hits: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`merged` without touching, with joined ``content``; what overlaps must agree.

    ``conflict`` marks a merged span whose parts disagree, in their texts or, where hits
    have one, in their ``title``; callers must refuse it. Where hits have a ``chunk_id``,
    ``origins`` lists those of all parts by place, so that what is cited leads back to them.
    """
    own = [c for c in ("chunk_id",) if c in hits.columns]
    titles = [(~F.min("title").eqNullSafe(F.max("title")) | (F.count("title") % F.count("*") != 0)).alias("_titles")] if "title" in hits.columns else []
    order = Window.partitionBy(*keys, "_island").orderBy("start_char", "end_char", "rank")
    before = F.max("end_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = _islands(hits, keys, touching=False).withColumn("_before", before)
    fresh = F.when(F.col("_before").isNull(), F.col("content")).otherwise(
        F.substring(F.col("content"), F.greatest(F.col("_before") - F.col("start_char"), F.lit(0)).cast("int") + 1, F.length("content"))
    )
    parts = F.sort_array(F.collect_list(F.struct("start_char", "end_char", "rank", fresh.alias("fresh"), F.col("content").alias("content"), *own)))
    joined = rows.groupBy(*keys, "_island").agg(
        F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.min("rank").alias("rank"), F.count("*").alias("parts"), parts.alias("_parts"), *titles
    )
    text = F.concat_ws("", F.transform("_parts", lambda p: p["fresh"]))
    out = joined.withColumn("content", text)
    first = F.col("start_char")
    agrees = F.forall(
        "_parts", lambda p: F.substring(F.col("content"), (p["start_char"] - first).cast("int") + 1, F.length(p["content"])) == p["content"]
    )
    if own:
        out = out.withColumn("origins", F.transform("_parts", lambda p: p["chunk_id"]))
    return out.withColumn("conflict", ~agrees | F.col("_titles") if titles else ~agrees).drop("_island", "_parts", "_titles")


#: Positions of a block: spans are cut at its borders, so a key with many spans is many groups.
WIDTH = 1 << 16


def _cut(spans: DataFrame, width: int) -> DataFrame:
    """Spans cut at the borders of blocks of ``width`` positions, with ``_block``; empty ones are left out."""
    block = F.explode(F.sequence(F.floor(F.col("start_char") / width), F.floor((F.col("end_char") - 1) / width)))
    pieces = spans.where("start_char < end_char").withColumn("_block", block)
    low = F.col("_block") * width
    return pieces.withColumns({"start_char": F.greatest("start_char", low), "end_char": F.least("end_char", low + width)})


def coverage(anchors: DataFrame, intervals: DataFrame, keys: list[str], anchor_id: str = "anchor_id", width: int = WIDTH) -> DataFrame:
    """``<anchor>, covered, coverage``: share of each anchor that the union of intervals covers.

    Both tables have ``keys, start_char, end_char``; keys are not null. A sweep: the union's length up to
    a place is known at each place once spans are in order, and an anchor's share is the
    difference between its ends. No pair of an anchor and an interval is formed, and a
    key with many spans is swept block by block. An anchor that is no span raises when
    it is read.
    """
    start, end = F.col("start_char"), F.col("end_char")
    sound = F.coalesce((start >= 0) & (start < end), F.lit(False))
    checked = F.when(sound, start).otherwise(F.raise_error(F.lit("an anchor needs 0 <= start < end")))
    own = anchors.select(anchor_id, *keys, checked.cast("long").alias("start_char"), end.cast("long").alias("end_char"))
    group = [*keys, "_block"]
    held = _cut(intervals.select(*keys, start.cast("long").alias("start_char"), end.cast("long").alias("end_char")).where(start >= 0).distinct(), width)
    union = merged(held, group, touching=True)
    before = F.coalesce(F.sum(end - start).over(Window.partitionBy(*group).orderBy("start_char").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = union.select(*group, start.alias("_at"), F.lit(0).alias("_kind"), F.struct(start.alias("a"), end.alias("b"), before.alias("before")).alias("_span"), F.lit(None).alias("_id"), F.lit(0).alias("_sign"))
    ends = _cut(own, width).select(*group, F.col(anchor_id).alias("_id"), F.explode(F.array(F.struct(start.alias("at"), F.lit(-1).alias("sign")), F.struct(end.alias("at"), F.lit(1).alias("sign")))).alias("e"))
    asked = ends.select(*group, F.col("e.at").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_span"), "_id", F.col("e.sign").alias("_sign"))
    order = Window.partitionBy(*group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_span", ignorenulls=True).over(order)
    swept = known.unionByName(asked).withColumn("_last", last).where("_kind = 1")
    upto = F.coalesce(F.col("_last.before") + F.least("_at", F.col("_last.b")) - F.col("_last.a"), F.lit(0))
    got = swept.groupBy(F.col("_id").alias(anchor_id)).agg(F.sum(upto * F.col("_sign")).cast("long").alias("covered"))
    out = own.join(got, anchor_id)
    return out.select(anchor_id, "covered", (F.col("covered") / (end - start)).alias("coverage"))


def accepted(observations: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds ``accepted`` and spans to observations.

    One counts only with the labelled revision and the exact text of its range;
    without a range, only if it is the whole body. ``observations``: ``source,
    document_revision, content, start_char, end_char``; ``bodies``: ``source,
    document_revision, body``.
    """
    b = bodies.select("source", F.col("document_revision").alias("_revision"), F.col("body").alias("_body"))
    rows = observations.join(b, "source", "left")
    whole = F.col("start_char").isNull() & F.col("end_char").isNull() & (F.col("content") == F.col("_body"))
    start = F.when(whole, 0).otherwise(F.col("start_char"))
    end = F.when(whole, F.length("_body")).otherwise(F.col("end_char"))
    rows = rows.withColumns({"start_char": start, "end_char": end})
    text = F.substring(F.col("_body"), F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int"))
    ok = (
        (F.col("document_revision") == F.col("_revision"))
        & (F.col("start_char") >= 0)
        & (F.col("start_char") < F.col("end_char"))
        & (F.col("end_char") <= F.length("_body"))
        & (F.col("content") == text)
    )
    return rows.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_revision", "_body")


def facets(requirements: DataFrame, covered: DataFrame) -> DataFrame:
    """``case_id, coverage, critical_covered``: weighted share of satisfied facets.

    ``requirements``: ``case_id, facet_id, weight, critical, alternative,
    span_id``; ``covered``: ``span_id, coverage``. A facet holds if all spans of
    one of its alternatives are covered whole.
    """
    rows = requirements.join(covered.select("span_id", "coverage"), "span_id", "left")
    whole = F.bool_and(F.coalesce(F.col("coverage") == 1.0, F.lit(False)))
    keys = ["case_id", "facet_id", "weight", "critical"]
    facet = rows.groupBy(*keys, "alternative").agg(whole.alias("ok")).groupBy(*keys).agg(F.bool_or("ok").alias("ok"))
    return facet.groupBy("case_id").agg(
        F.try_divide(F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("coverage"),
        F.bool_and(F.when(F.col("critical"), F.col("ok"))).alias("critical_covered"),
    )


def gold_context(requirements: DataFrame) -> DataFrame:
    """Spans of each facet's first alternative."""
    first = F.min("alternative").over(Window.partitionBy("case_id", "facet_id"))
    return requirements.withColumn("_first", first).where("alternative = _first").select("case_id", "span_id").distinct()


def group_recall(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """``case_id, recall``: share of source groups of which any source was found."""
    found = hits.select("case_id", "source").distinct().withColumn("_hit", F.lit(True))
    rows = groups.join(found, ["case_id", "source"], "left")
    ok = rows.groupBy("case_id", "group_id").agg(F.max(F.coalesce("_hit", F.lit(False))).alias("ok"))
    return ok.groupBy("case_id").agg((F.count_if("ok") / F.count("*")).alias("recall"))


def _full_ranks(found: pd.DataFrame, asked: pd.DataFrame) -> list[int | None]:
    """Of each span asked for the highest of its places' lowest ranks; none if a place has no hit.

    Places between neighbouring ends of hits are one stretch; the lowest rank over each
    comes from a heap of the hits that are open, and highest ones of runs of stretches from
    a table of doubling runs.
    """
    hits = found[(found["start_char"] < found["end_char"]) & found["rank"].notna()].sort_values("start_char")
    edges = np.unique(np.concatenate([hits["start_char"], hits["end_char"]]).astype(np.int64)) if len(hits) else np.zeros(0, np.int64)
    none = np.iinfo(np.int64).max
    low, heap, k = np.full(max(0, len(edges) - 1), none), [], 0
    rows = hits[["start_char", "end_char", "rank"]].to_numpy(np.int64)
    for i in range(len(low)):
        while k < len(rows) and rows[k, 0] <= edges[i]:
            heapq.heappush(heap, (rows[k, 2], rows[k, 1]))
            k += 1
        while heap and heap[0][1] <= edges[i]:
            heapq.heappop(heap)
        if heap:
            low[i] = heap[0][0]
    runs = [low]
    while len(runs[-1]) > 1 << (len(runs) - 1):
        step = 1 << (len(runs) - 1)
        runs.append(np.maximum(runs[-1][:-step], runs[-1][step:]))
    out: list[int | None] = []
    for a, b in zip(asked["start_char"], asked["end_char"], strict=True):
        i, j = int(np.searchsorted(edges, a, "right")) - 1, int(np.searchsorted(edges, b, "left"))
        if a >= b or i < 0 or j >= len(edges):
            out.append(None)
            continue
        level = (j - i).bit_length() - 1
        high = max(runs[level][i], runs[level][j - (1 << level)])
        out.append(None if high == none else int(high))
    return out


def first_full_rank(hits: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """``query_id, rank``: the first rank at which the hits so far cover every anchor; null if none.

    ``hits``: ``query_id, rank, keys, start_char, end_char``; ``anchors``:
    ``query_id, anchor_id, keys, start_char, end_char``. One sweep of a query's spans of a
    key: the lowest rank of the hits over each place, and of an anchor the highest of these.
    """
    both = [hits.select("query_id", *keys, "start_char", "end_char", "rank"), anchors.select("query_id", *keys, "start_char", "end_char")]
    own = ["query_id", *keys]
    schema = "query_id " + anchors.schema["query_id"].dataType.simpleString() + ", anchors long, full long, rank int"

    def sweep(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame([], columns=["query_id", "anchors", "full", "rank"])
        ranks = _full_ranks(found, asked)
        known = [r for r in ranks if r is not None]
        return pd.DataFrame({"query_id": [asked["query_id"].iloc[0]], "anchors": [len(ranks)], "full": [len(known)], "rank": [max(known, default=None)]})

    parts = both[0].groupBy(*own).cogroup(both[1].groupBy(*own)).applyInPandas(sweep, schema)
    done = parts.groupBy("query_id").agg(F.sum("anchors").alias("n"), F.sum("full").alias("full"), F.max("rank").alias("rank"))
    return done.select("query_id", F.when(F.col("n") == F.col("full"), F.col("rank")).alias("rank"))


def context_report(spans: DataFrame, kept: Column, keys: list[str]) -> DataFrame:
    """``keys, chars, union_chars, duplicate_fraction, retained``: overlap and what packing kept."""
    union = merged(spans.select(*keys, "start_char", "end_char"), keys, touching=True)
    union = union.groupBy(*keys).agg(F.sum(F.col("end_char") - F.col("start_char")).alias("union_chars"))
    size = F.col("end_char") - F.col("start_char")
    whole = spans.groupBy(*keys).agg(F.sum(size).alias("chars"), F.sum(F.when(kept, size).otherwise(0)).alias("_kept"))
    out = whole.join(union, keys)
    return out.select(
        *keys, "chars", "union_chars", (1 - F.try_divide("union_chars", "chars")).alias("duplicate_fraction"), F.try_divide("_kept", "chars").alias("retained")
    )


def unique_tokens(spans: DataFrame, bodies: DataFrame, keys: list[str], count, text_col: str = "text") -> DataFrame:
    """``keys, spans, tokens``: tokens of the text that spans cover, each place once.

    ``count`` gives the tokens of a text column; ``bodies`` have ``keys`` and a text.
    """
    held = merged(spans, keys, touching=True).join(bodies.select(*keys, F.col(text_col).alias("_t")), keys)
    part = F.substring(F.col("_t"), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    return held.groupBy(*keys).agg(F.count("*").alias("spans"), F.sum(count(part)).alias("tokens"))
