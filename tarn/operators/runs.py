"""Evaluation runs: cases by methods in rotating order, with inputs that may not drift."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.lifecycle import corpus_fingerprint


class Drift(RuntimeError):
    """The inputs of a run changed while it went on."""


@contextlib.contextmanager
def deadline(spark: SparkSession, seconds: float):
    """Cancels the Spark jobs of the block after ``seconds``; then TimeoutError is raised."""
    if seconds <= 0:
        raise ValueError("a deadline is a positive number of seconds")
    sc, late = spark.sparkContext, threading.Event()
    tag = f"deadline-{threading.get_ident()}-{time.monotonic_ns()}"

    def stop():
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"over {seconds:g} seconds") from error
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    if late.is_set():
        raise TimeoutError(f"over {seconds:g} seconds")


def run_cases(cases: list[dict], methods: dict[str, Callable[[dict], list[dict]]], inputs: DataFrame | None = None, columns: list[str] | None = None) -> list[dict]:
    """``case_id, method, rank, ..., elapsed_ms`` of every case with every method.

    The order of methods starts one further for each case, so none always goes
    first. A failed call is a row with ``error``; the others go on. ``inputs`` must
    have the same fingerprint after the run as before it.
    """
    mark = lambda: None if inputs is None else corpus_fingerprint(inputs, columns or inputs.columns).first()
    before, names, rows = mark(), sorted(methods), []
    for i, case in enumerate(cases):
        for name in names[i % len(names) :] + names[: i % len(names)]:
            began = time.perf_counter()
            try:
                hits, error = methods[name](case), None
            except Exception as problem:  # a method is outside code
                hits, error = [], f"{type(problem).__name__}: {problem}"
            took = (time.perf_counter() - began) * 1000
            base = {"case_id": case["case_id"], "method": name, "elapsed_ms": took, "error": error}
            rows += [{**base, **h} for h in hits] or [base]
    if mark() != before:
        raise Drift("the inputs changed during the run")
    return rows


def case_and_family_means(values: DataFrame, value: str) -> DataFrame:
    """One row: mean over cases and mean over families of case means; undefined values are left out."""
    families = values.groupBy("family_id").agg(F.avg(value).alias("m"))
    cases = values.agg(F.count("*").alias("cases"), F.count(value).alias("defined"), F.avg(value).alias("case_mean"))
    return cases.crossJoin(families.agg(F.count("m").alias("families"), F.avg("m").alias("family_mean")))


def shortfalls(rows: DataFrame, facets: DataFrame) -> DataFrame:
    """``case_id, method, status, coverage, missing_facets``: cases that failed, or whose evidence is not whole.

    ``rows``: ``case_id, method, status, coverage``; ``facets``: ``case_id, method, facet,
    satisfied``. A case whose coverage is undefined is no shortfall unless it failed.
    """
    missing = facets.where(~F.coalesce("satisfied", F.lit(False))).groupBy("case_id", "method").agg(F.sort_array(F.collect_set("facet")).alias("missing_facets"))
    short = rows.where(~F.col("status").eqNullSafe(F.lit("ok")) | (F.col("coverage") < 1))
    found = short.select("case_id", "method", "status", "coverage").join(missing, ["case_id", "method"], "left")
    return found.withColumn("missing_facets", F.coalesce("missing_facets", F.array().cast("array<string>")))


def comparable(values: DataFrame, value: str, arms: int) -> tuple[DataFrame, DataFrame]:
    """Cases with a defined value in every arm, and the others, to be listed.

    ``values``: ``case_id, arm`` and the value.
    """
    n = values.groupBy("case_id").agg(F.count(value).alias("n"))
    return values.join(n.where(F.col("n") == arms).select("case_id"), "case_id", "left_semi"), n.where(F.col("n") < arms).select("case_id")


def freshness(live: DataFrame, snapshot: DataFrame, key: str = "source", revision: str = "document_revision") -> DataFrame:
    """One row: how many live documents a snapshot has as they are, has outdated, or lacks."""
    rows = live.select(key, F.col(revision).alias("_a")).join(snapshot.select(key, F.col(revision).alias("_b")).distinct(), key, "left")
    return rows.agg(
        F.count_if(F.col("_a") == F.col("_b")).alias("fresh"), F.count_if(F.col("_a") != F.col("_b")).alias("stale"), F.count_if(F.col("_b").isNull()).alias("absent")
    )
