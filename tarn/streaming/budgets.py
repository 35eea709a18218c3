"""Budgets of tool-using runs, enforced on a stream of their calls.

Each run has one small state: what it has used, when it began, and why it stopped. A
timer of event time ends runs that are idle, so state doesn't outlive them.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``kind``: call, or closed for the row that ends an idle run; ``reason``: why the run had stopped by then.
CALLS = "run_id long, seq long, kind string, executed boolean, delivered boolean, reason string, delivered_tokens long"
_STATE = "started_ms long, last_ms long, seq long, calls long, queries long, reads long, tokens long, reason string"
_QUERIES = ("match", "search")


@dataclass(frozen=True)
class Limits:
    """What a run may use; None is no limit."""

    tool_calls: int | None = None
    query_calls: int | None = None
    read_calls: int | None = None
    evidence_tokens: int | None = None
    elapsed_ms: int | None = None

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
                raise ValueError(f"{f.name} is a whole number from 0 on, or None")


@dataclass
class _Use:
    started_ms: int
    last_ms: int
    seq: int | None = None
    calls: int = 0
    queries: int = 0
    reads: int = 0
    tokens: int = 0
    reason: str | None = None

    def admits(self, limits: Limits, tool: str, at_ms: int) -> bool:
        """Whether a call may begin; if not, the run stops."""
        over = lambda used, most: most is not None and used >= most
        if over(at_ms - self.started_ms, limits.elapsed_ms):
            self.reason = "elapsed_ms"
        elif over(self.calls, limits.tool_calls):
            self.reason = "tool_calls"
        elif tool in _QUERIES and over(self.queries, limits.query_calls):
            self.reason = "query_calls"
        elif tool == "read" and over(self.reads, limits.read_calls):
            self.reason = "read_calls"
        return self.reason is None

    def takes(self, limits: Limits, tool: str, end_ms: int, tokens: int) -> bool:
        """Counts a call that was made; whether its result is delivered. A withheld one stops the run."""
        self.calls, self.queries, self.reads = self.calls + 1, self.queries + (tool in _QUERIES), self.reads + (tool == "read")
        if limits.elapsed_ms is not None and end_ms - self.started_ms >= limits.elapsed_ms:
            self.reason = "elapsed_ms"
        elif limits.evidence_tokens is not None and self.tokens + tokens > limits.evidence_tokens:
            self.reason = "evidence_tokens"
        else:
            self.tokens += tokens
        return self.reason is None


class _Budgets(StatefulProcessor):
    def __init__(self, limits: Limits, idle_ms: int):
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.use = handle, handle.getValueState("use", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["seq", "at_ms"], kind="stable")  # one run's calls of one batch
        known = self.use.get() if self.use.exists() else None
        use = _Use(*known) if known is not None else _Use(int(calls["at_ms"].iloc[0]), int(calls["at_ms"].iloc[0]))
        before, out = use.last_ms, []
        for c in calls.itertuples(index=False):
            executed = use.reason is None and use.admits(self.limits, c.tool, int(c.at_ms))
            delivered = executed and use.takes(self.limits, c.tool, int(c.at_ms + c.took_ms), int(c.tokens))
            use.seq, use.last_ms = int(c.seq), max(use.last_ms, int(c.at_ms))
            out.append((key[0], int(c.seq), "call", executed, delivered, use.reason, use.tokens))
        self.use.update((use.started_ms, use.last_ms, use.seq, use.calls, use.queries, use.reads, use.tokens, use.reason))
        if known is None or use.last_ms != before:
            if known is not None:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(use.last_ms + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CALLS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        use = _Use(*self.use.get())
        self.use.clear()
        yield pd.DataFrame([(key[0], use.seq, "closed", False, False, use.reason, use.tokens)], columns=[c.split()[0] for c in CALLS.split(", ")])

    def close(self) -> None:
        pass


def budgeted_calls(calls: DataFrame, limits: Limits, idle: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """What becomes of each call of each run, in order (:data:`CALLS`).

    ``calls``: ``run_id, seq, tool, ts, took_ms, tokens``. A call that a limit forbids is
    not executed; a result that comes after the deadline, or that would go over the
    evidence tokens, is executed but withheld; either stops the run, and its later calls
    are not executed. A run begins with its first call and is closed, with a row of its
    own, when the watermark is ``idle`` past its last one; calls after that begin it anew.
    Calls of a run come in the order of ``seq``, save within a batch; calls later than
    ``delay`` are dropped. Null tools are of no kind; null times of no run; null tokens and
    durations are 0. One task holds a run's calls of one batch, so batches bound memory
    (``maxFilesPerTrigger``).
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    own = calls.where("run_id IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL").withWatermark("ts", delay)
    own = own.selectExpr("run_id", "seq", "coalesce(tool, '') AS tool", "ts", "unix_millis(cast(ts AS timestamp)) AS at_ms", "coalesce(took_ms, 0) AS took_ms", "coalesce(tokens, 0) AS tokens")
    return own.groupBy("run_id").transformWithStateInPandas(_Budgets(limits, idle_ms), CALLS, "append", "eventtime")


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """The state store that :func:`budgeted_calls` needs, for streams that start within; then the session's own."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
