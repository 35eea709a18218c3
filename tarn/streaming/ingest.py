"""Incremental indexing, deduplication and budgets over streams.

The batch engine's operators are kept; a stream feeds them. State is bounded by
watermarks where it is kept in the stream, and lies in tables where it is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.functions.text import identity


def deduplicated(events: DataFrame, keys: list[str], time_col: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark; later events than that are dropped."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_usage(events: DataFrame, value: str, by: list[str], time_col: str = "ts", window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Calls and their total by window; windows close when the watermark passes them."""
    frame = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    found = events.withWatermark(time_col, delay).groupBy(frame, *by).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "calls", "total")


def sessions(events: DataFrame, by: list[str], time_col: str = "ts", gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of events of a key with no gap longer than ``gap``."""
    found = events.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap), *by).agg(F.count("*").alias("events"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "events")


def run_budgets(events: DataFrame, cap: int, run_col: str = "run_id", cost_col: str = "cost") -> DataFrame:
    """``run_id, used, events, stopped`` of each batch: running use of a budget by run.

    What goes over is counted but stops the run; later events of it are withheld.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, n, stopped = state.get if state.exists else (0, 0, False)
        for pdf in frames:
            for cost in pdf[cost_col]:
                if stopped:
                    break
                used, n = used + int(cost), n + 1
                stopped = used > cap
        state.update((used, n, stopped))
        yield pd.DataFrame({run_col: [key[0]], "used": [used], "events": [n], "stopped": [stopped]})

    return events.groupBy(run_col).applyInPandasWithState(
        step, f"{run_col} long, used long, events long, stopped boolean", "used long, events long, stopped boolean", "update", GroupStateTimeout.NoTimeout
    )


def index_stream(notes: DataFrame, postings_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Adds the postings of new notes to a table; a replayed batch overwrites itself.

    Each batch is a partition of its own, named by its number, so exactly one copy
    of its rows stands, however often it ran.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = batch.dropDuplicates(["source"]).withColumn("document_revision", identity("revision", F.col("title"), F.col("content")))
        postings_of(own).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
