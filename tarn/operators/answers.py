"""Scores of answers and of agent runs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.lazy import pandas_udf
from tarn.operators.agent import KNOWLEDGE_TOOLS
from tarn.operators.stats import percentiles

#: ASCII punctuation, which answers are compared without.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalised(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    plain = F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(normalised(text), " "), lambda w: w != "")


def bag_f1(prediction: Column, gold: Column) -> Column:
    """F1 of two bags of words; two empty ones agree."""
    p, g = _words(prediction), _words(gold)
    count = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
    shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(count(p, w), count(g, w)))
    total = F.size(p) + F.size(g)
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / F.greatest(total, F.lit(1)))


def answer_scores(rows: DataFrame) -> DataFrame:
    """``id, f1, em``: the best over the aliases. ``rows``: ``id, prediction, aliases``."""
    each = rows.select("id", "prediction", F.explode("aliases").alias("alias"))
    same = (normalised(F.col("prediction")) == normalised(F.col("alias"))).cast("double")
    return each.groupBy("id").agg(F.max(bag_f1(F.col("prediction"), F.col("alias"))).alias("f1"), F.max(same).alias("em"))


def support_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two sets; two empty ones agree."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    total = F.size(p) + F.size(g)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(p, g)) / F.greatest(total, F.lit(1)))


def pair_joint(rows: DataFrame) -> DataFrame:
    """``id, answer, support``: of a pair of an answerable and an unanswerable variant.

    Zero unless both were judged rightly. ``rows``: ``id, answerable, correct, f1,
    support``. A group that isn't such a pair raises.
    """
    pairs = rows.groupBy("id").agg(
        F.count("*").alias("n"), F.count_if("answerable").alias("yes"), F.bool_and("correct").alias("good"),
        F.max(F.when(F.col("answerable"), F.col("f1"))).alias("f1"), F.max(F.when(F.col("answerable"), F.col("support"))).alias("support"),
    )
    if pairs.where("n <> 2 OR yes <> 1").limit(1).count():
        raise ValueError("incomplete pair")
    zero = F.lit(0.0)
    return pairs.select("id", F.when(F.col("good"), F.col("f1")).otherwise(zero).alias("answer"), F.when(F.col("good"), F.col("support")).otherwise(zero).alias("support"))


@pandas_udf("struct<answer:string, answerable:boolean, support:array<int>, error:string>")
def parsed_prediction(raw: pd.Series) -> pd.DataFrame:
    """Answer, answerability and supports of a prediction; one code fence is allowed.

    Anything else is an error with null fields, never a right refusal.
    """
    rows = []
    for text in raw:
        try:
            body = (text or "").strip()
            if body.startswith("```"):
                first, _, rest = body.partition("\n")
                if first.strip() not in ("```", "```json") or not rest.rstrip().endswith("```"):
                    raise ValueError("broken code fence")
                body = rest.rstrip()[:-3]
            value = json.loads(body)
            answer, able, support = value["predicted_answer"], value["predicted_answerable"], value["predicted_support_idxs"]
            if not isinstance(answer, str) or type(able) is not bool or any(type(i) is not int for i in support) or len(value) != 3:
                raise ValueError("wrong fields")
            rows.append((answer, able, support, None))
        except (ValueError, KeyError, TypeError) as error:
            rows.append((None, None, None, str(error) or type(error).__name__))
    return pd.DataFrame(rows, columns=["answer", "answerable", "support", "error"])


def hop_breakdown(rows: DataFrame) -> DataFrame:
    """``hops`` and means; answerability as a three-valued count (yes, no, undefined)."""
    said = F.coalesce(F.col("predicted_answerable").cast("string"), F.lit("undefined"))
    n = lambda v: F.count_if(said == v)
    return rows.groupBy("hops", "answerable").agg(
        F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"), n("true").alias("said_yes"), n("false").alias("said_no"), n("undefined").alias("undefined")
    )


def case_scores(cases: DataFrame, trials: DataFrame, calls: DataFrame) -> DataFrame:
    """Outcome of each trial with its failure reasons; unobserved behaviour stays null.

    ``cases``: ``case_id, task_type, expected_sources, allowed_tools,
    forbidden_tools, max_tool_calls, min_source_recall, min_read_sources``;
    ``trials``: ``trial_id, case_id, stop_reason`` (null: no trace); ``calls``:
    ``trial_id, seq, tool, sources`` (null sources: error or no result).
    """
    sources = lambda kept: F.array_distinct(F.flatten(F.collect_list(F.when(kept & F.col("sources").isNotNull(), F.col("sources")))))
    known = F.col("tool").isin(*KNOWLEDGE_TOOLS)
    seen = calls.groupBy("trial_id").agg(
        F.count("*").alias("tool_calls"), F.count_if(known).alias("_known"), F.collect_list("tool").alias("_tools"), sources(known).alias("_found"), sources(F.col("tool") == "read").alias("_read")
    )
    rows = trials.join(cases, "case_id").join(seen, "trial_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("_tools", "_found", "_read", "expected_sources", "forbidden_tools")})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tool_calls", "_known")})
    expected = F.col("expected_sources")
    recall = F.try_divide(F.size(F.array_intersect(expected, "_found")).cast("double"), F.size(expected).cast("double"))
    read = F.size(F.array_intersect(expected, "_read"))
    forbidden = F.exists("_tools", lambda t: F.array_contains(F.col("forbidden_tools"), t))
    disallowed = F.col("allowed_tools").isNotNull() & F.exists("_tools", lambda t: ~F.array_contains(F.col("allowed_tools"), t))
    over = F.coalesce(F.col("tool_calls") > F.col("max_tool_calls"), F.lit(False))
    needless = (F.col("task_type") == "no_retrieval") & (F.col("_known") > 0)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("stop_reason") != "final", "not_final"),
            F.when(forbidden, "forbidden_tool"),
            F.when(disallowed, "disallowed_tool"),
            F.when(over, "max_tool_calls_exceeded"),
            F.when(needless, "unnecessary_retrieval"),
            F.when((F.size(expected) > 0) & (recall < F.coalesce("min_source_recall", F.lit(1.0))), "source_recall_below_threshold"),
            F.when((F.col("task_type") == "direct_read") & (read < F.size(expected)), "target_not_read"),
            F.when(read < F.coalesce("min_read_sources", F.lit(0)), "insufficient_read_sources"),
        )
    )
    traced = F.col("stop_reason").isNotNull()
    rows = rows.withColumn("failure_reasons", F.when(traced, reasons).otherwise(F.array(F.lit("trace_unavailable"))))
    return rows.select(
        "trial_id",
        "case_id",
        "task_type",
        "stop_reason",
        "failure_reasons",
        (F.size("failure_reasons") == 0).alias("success"),
        F.when(traced, recall).alias("source_recall"),
        F.when(traced, F.col("tool_calls")).alias("tool_calls"),
        F.when(traced & (F.col("task_type") == "no_retrieval"), F.col("_known") > 0).alias("unnecessary_retrieval"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Overall and by task type: trials, successes, means over defined values."""
    return results.groupingSets([[], [F.col("task_type")]], F.col("task_type")).agg(
        F.count("*").alias("trials"), F.count_if("success").alias("successes"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
        F.round(F.avg("source_recall"), 6).alias("source_recall"), F.count("source_recall").alias("recall_defined"), F.round(F.avg("tool_calls"), 6).alias("tool_calls"),
    )


def stability(trials: DataFrame, expected: int, by: list[str] | None = None) -> DataFrame:
    """``case_id, trials, passes, stability``: always_pass, flaky, always_fail or incomplete."""
    out = trials.groupBy(*(by or []), "case_id").agg(F.count("*").alias("trials"), F.count_if("success").alias("passes"))
    kind = (
        F.when(F.col("trials") < expected, "incomplete")
        .when(F.col("passes") == F.col("trials"), "always_pass")
        .when(F.col("passes") == 0, "always_fail")
        .otherwise("flaky")
    )
    return out.withColumn("stability", kind)


def pass_at_one(trials: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``cases, pass_at_1``: mean over cases of the share of their trials that passed."""
    own = by or []
    cases = trials.groupBy(*own, "case_id").agg(F.avg(F.coalesce(F.col("success"), F.lit(False)).cast("double")).alias("rate"))
    return cases.groupBy(*own).agg(F.count("*").alias("cases"), F.avg("rate").alias("pass_at_1"))


def model_changes(rates: DataFrame) -> DataFrame:
    """Each case's pass rate against the model before it in size: ``win``, ``regression`` or ``same``.

    ``rates``: ``case_id, model, size, rate``.
    """
    before = F.lag("rate").over(Window.partitionBy("case_id").orderBy("size"))
    change = F.when(before.isNull(), F.lit(None)).when(F.col("rate") > before, "win").when(F.col("rate") < before, "regression").otherwise("same")
    return rates.withColumns({"before": before, "change": change})


def sufficiency(events: DataFrame, needed: DataFrame) -> DataFrame:
    """``run_id, sufficient_at, later_calls``: the first call by which all needed sources were seen.

    ``events``: ``run_id, seq, source``; ``needed``: ``run_id, source``. Null if never.
    """
    want = needed.groupBy("run_id").agg(F.count_distinct("source").alias("want"))
    first = events.join(needed, ["run_id", "source"], "left_semi").groupBy("run_id", "source").agg(F.min("seq").alias("at"))
    done = first.groupBy("run_id").agg(F.count("*").alias("got"), F.max("at").alias("at")).join(want, "run_id")
    done = done.select("run_id", F.when(F.col("got") == F.col("want"), F.col("at")).alias("sufficient_at"))
    calls = events.select("run_id", "seq").distinct().join(done, "run_id", "left")
    return calls.groupBy("run_id").agg(
        F.max("sufficient_at").alias("sufficient_at"), F.when(F.max("sufficient_at").isNotNull(), F.count_if(F.col("seq") > F.col("sufficient_at"))).alias("later_calls")
    )


def delivery(events: DataFrame) -> DataFrame:
    """``run_id``: sources returned, delivered to the conversation, submitted to the model."""
    n = lambda c: F.count_distinct(F.when(c, F.col("source")))
    return events.groupBy("run_id").agg(
        F.count_distinct("source").alias("returned"), n(F.col("delivered")).alias("delivered"), n(F.col("delivered") & F.col("submitted")).alias("submitted")
    )


def verdicts(rows: DataFrame) -> DataFrame:
    """``grounded, useful``: execution, evidence and review, unknown where any is unknown and none fails."""
    grounded = F.col("executed") & F.col("evidence_ok") & F.col("grounding_review")
    return rows.withColumns({"grounded": grounded, "useful": grounded & F.col("utility_review")})


def first_full_turn(tools: DataFrame, model_turns: DataFrame, needed: DataFrame) -> DataFrame:
    """``run_id, turn``: the first model turn before which all needed evidence was delivered.

    Tool results count for turns after their own.
    """
    want = needed.groupBy("run_id").agg(F.count_distinct("source").alias("want"))
    seen = tools.join(needed, ["run_id", "source"], "left_semi").groupBy("run_id", "source").agg(F.min("turn").alias("at"))
    whole = seen.groupBy("run_id").agg(F.count("*").alias("got"), F.max("at").alias("at")).join(want, "run_id").where("got = want")
    after = model_turns.join(whole, "run_id").where(F.col("at") < F.col("turn"))
    return after.groupBy("run_id").agg(F.min("turn").alias("turn"))


def costs(calls: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Total, mean, p50, p95 and most of a cost; rows without one are counted apart."""
    sums = calls.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(value).alias("known"), F.round(F.sum(value), 6).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("most")
    )
    points = percentiles(calls, value, [0.5, 0.95], by).select(*by, F.round("p0", 6).alias("p50"), F.round("p1", 6).alias("p95"))
    return sums.join(points, by, "left").select(*by, "n", "known", "total", "mean", "p50", "p95", "most")
