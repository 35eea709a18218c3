"""Streams that a few Parquet files feed to their end."""

from pyspark.sql import functions as F

from tarn.functions.text import title_and_body
from tarn.operators import bm25
from tarn.streaming import ingest


def events(spark, tmp_path, rows, schema="run_id long, ts timestamp, cost long"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def result(df, name, mode, spark):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_windows_and_budgets(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, at(1), 5), (1, at(2), 7), (1, at(7), 9), (2, at(1), 1)]
    stream = events(spark, tmp_path, rows)
    out = result(ingest.windowed_usage(stream, "cost", ["run_id"]), "usage", "complete", spark)
    assert sorted((r["run_id"], r["start"].minute, r["calls"], r["total"]) for r in out.collect()) == [(1, 0, 2, 12), (1, 5, 1, 9), (2, 0, 1, 1)]
    out = result(ingest.run_budgets(stream, 10), "budgets", "update", spark)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 12, 2, True), (2, 1, 1, False)]
    out = result(ingest.sessions(stream, ["run_id"], gap="3 minutes"), "runs", "complete", spark)
    assert sorted((r["run_id"], r["events"]) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_dedup(spark, tmp_path):
    import datetime as dt

    rows = [(1, dt.datetime(2024, 1, 1), 1), (1, dt.datetime(2024, 1, 1), 1), (2, dt.datetime(2024, 1, 1), 1)]
    out = result(ingest.deduplicated(events(spark, tmp_path, rows), ["run_id"]), "once", "append", spark)
    assert out.count() == 2


def test_index_stream(spark, tmp_path):
    schema = "source string, title string, content string"
    spark.createDataFrame([("a.md", "t", "cat dog"), ("b.md", "t", "cat")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def postings(df):
        return bm25.postings(bm25.tokenised(df, title_and_body(F.col("title"), F.col("content"))), "source")

    query = ingest.index_stream(stream, postings, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["term"], r["source"]): r["tf"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("cat", "a.md"): 1, ("dog", "a.md"): 1, ("t", "a.md"): 1, ("cat", "b.md"): 1, ("t", "b.md"): 1}


LIMITS = "run_id long, seq long, tool string, ts timestamp, took_ms long, tokens long"


def decided(spark, tmp_path, rows, **limits):
    from tarn.streaming.budgets import Limits, budgeted_calls, keyed_state

    for n, part in enumerate(rows):
        spark.createDataFrame(part, LIMITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(LIMITS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    out, name = budgeted_calls(stream, Limits(**limits), idle="10 minutes", delay="1 minute"), f"calls_{tmp_path.name}"
    with keyed_state(spark):
        query = out.writeStream.outputMode("append").format("memory").queryName(name.replace("-", "_")).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
    return [tuple(r)[:-1] for r in spark.table(name.replace("-", "_")).orderBy("run_id", "seq", "kind").collect()]


def test_withheld_results_stop_a_run(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        (1, 2, "read", at(1), 0, 3), (1, 1, "read", at(0), 0, 3), (1, 3, "search", at(2), 0, None),  # tokens: the second is made but withheld
        (2, 1, "read", at(0), 5000, 1), (2, 2, "read", at(9), 0, 1),  # its result is late
        (3, 1, "read", at(0), 0, 1), (3, 2, "search", at(1), 0, 1), (3, 3, "search", at(2), 0, 1), (3, 4, "read", at(2), 0, 1),  # queries do not spend reads
        (4, 1, None, at(0), None, None), (None, 1, "read", at(0), 0, 1),
    ]
    got = decided(spark, tmp_path, [rows], evidence_tokens=5, elapsed_ms=4000, query_calls=1, read_calls=2)
    assert got == [
        (1, 1, "call", True, True, None), (1, 2, "call", True, False, "evidence_tokens"), (1, 3, "call", False, False, "evidence_tokens"),
        (2, 1, "call", True, False, "elapsed_ms"), (2, 2, "call", False, False, "elapsed_ms"),
        (3, 1, "call", True, True, None), (3, 2, "call", True, True, None), (3, 3, "call", False, False, "query_calls"), (3, 4, "call", False, False, "query_calls"),
        (4, 1, "call", True, True, None),
    ]


def test_idle_runs_are_closed(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    parts = [[(1, 1, "read", at(0), 0, 3)], [(1, 2, "read", at(5), 0, 3)], [(2, 1, "read", at(40), 0, 1)], [(2, 2, "read", at(41), 0, 1)], [(1, 9, "read", at(45), 0, 1)]]
    got = decided(spark, tmp_path, parts, read_calls=1)
    assert (1, 2, "call", False, False, "read_calls") in got and (1, 2, "closed", False, False, "read_calls") in got
    assert (1, 9, "call", True, True, None) in got and not any(r[0] == 2 and r[2] == "closed" for r in got)


def test_limits_are_whole_numbers():
    import pytest

    from tarn.streaming.budgets import Limits

    for bad in (True, -1, 1.5):
        with pytest.raises(ValueError):
            Limits(query_calls=bad)
