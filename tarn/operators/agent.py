"""Traces of tool-using runs: pairing, stalls, budgets, totals, and the loop itself.

Traces are rows, ``run_id, seq, turn, ...``; what an observer keeps as state while
a run goes on is a running sum over its rows here.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNOWLEDGE_TOOLS = ("match", "read", "search")


def paired(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their observations: the nth result of a turn belongs to its nth call."""
    w = Window.partitionBy("run_id", "turn").orderBy("seq")
    a = calls.withColumn("_n", F.row_number().over(w))
    b = results.select("run_id", "turn", "result", F.row_number().over(w).alias("_n"))
    return a.join(b, ["run_id", "turn", "_n"], "left").drop("_n")


def stalled(hits: DataFrame, searches: DataFrame) -> DataFrame:
    """Adds ``stalled`` to searches: neither it nor the search before found anything new.

    ``searches``: ``run_id, seq``; ``hits``: ``run_id, seq, evidence_id``.
    """
    first = hits.groupBy("run_id", "evidence_id").agg(F.min("seq").alias("seq"))
    new = first.groupBy("run_id", "seq").agg(F.count("*").alias("_new"))
    rows = searches.join(new, ["run_id", "seq"], "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    before = F.lag("_new").over(Window.partitionBy("run_id").orderBy("seq"))
    return rows.withColumn("stalled", F.coalesce((F.col("_new") == 0) & (before == 0), F.lit(False))).withColumnRenamed("_new", "new_evidence")


def budgeted(events: DataFrame, caps: dict[str, int | float], cost: dict[str, Column]) -> DataFrame:
    """Adds ``used_<cap>``, ``over`` and ``delivered`` to events.

    ``caps``: limits by name; ``cost``: what an event adds to each. The event that
    goes over is kept but not delivered; the run stops there.
    """
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({f"used_{k}": F.sum(F.coalesce(cost[k], F.lit(0))).over(w) for k in caps})
    over = F.lit(False)
    for k, most in caps.items():
        over = over | (F.col(f"used_{k}") > most)
    rows = rows.withColumn("over", over)
    stopped = F.max(F.col("over").cast("int")).over(w)
    return rows.withColumn("delivered", stopped == 0)


def usage_totals(events: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``<c>_total``: only if every row has a value; ``<c>_known``: of those that have."""
    cells = []
    for c in columns:
        cells += [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(f"{c}_total"), F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_known")]
    return events.groupBy(*by).agg(F.count("*").alias("events"), *cells)


def unique_tokens(excerpts: DataFrame, keys: list[str]) -> DataFrame:
    """``run_id, tokens``: each excerpt once a run."""
    return excerpts.dropDuplicates(["run_id", *keys]).groupBy("run_id").agg(F.sum("tokens").alias("tokens"))


#: What a model is told about the tools.
TOOLS = [
    {"name": "match", "description": "Find a literal or a pattern in live documents.", "parameters": {"query": "string", "regex": "boolean", "ignore_case": "boolean", "source": "string", "top_k": "integer"}},
    {"name": "search", "description": "Rank chunks of the pinned snapshot.", "parameters": {"query": "string", "mode": ["bm25", "semantic", "hybrid"], "source": "string", "top_k": "integer"}},
    {"name": "read", "description": "Read a document, a section or a range.", "parameters": {"source": "string", "start_char": "integer", "end_char": "integer", "section_id": "string"}},
]


@dataclass
class Run:
    """A finished or stopped run."""

    stop_reason: str
    answer: str | None
    events: list[dict] = field(default_factory=list)
    error: str | None = None


def run_agent(
    question: str,
    chat: Callable[[list[dict]], dict],
    tools: dict[str, Callable[..., list[dict]]],
    max_turns: int = 8,
    caps: dict[str, int] | None = None,
    deadline_s: float | None = None,
) -> Run:
    """A bounded loop on the driver: the model asks, tools run DataFrame queries.

    ``chat`` gets the messages and returns ``content`` and ``tool_calls`` (name,
    arguments). Nothing is retried; an error ends the run with the events so far.
    ``caps``: most calls in all (``calls``) and by tool name. After two searches
    in a row without new evidence the model is reminded to change its query.
    """
    if max_turns < 1 or not question.strip():
        raise ValueError("a run needs a question and one turn at least")
    messages = [{"role": "user", "content": question}]
    events: list[dict] = []
    seen: set = set()
    dry, made, began = 0, {}, time.monotonic()
    for turn in range(1, max_turns + 1):
        if deadline_s is not None and time.monotonic() - began > deadline_s:
            return Run("error", None, events, "deadline")
        if dry >= 2:
            messages.append({"role": "system", "content": "The last two searches found nothing new; change the query or answer."})
            dry = 0
        try:
            reply = chat(messages)
        except Exception as error:  # the model is outside code
            return Run("error", None, events, f"{type(error).__name__}: {error}")
        calls = reply.get("tool_calls") or []
        messages.append({"role": "assistant", "content": reply.get("content"), "tool_calls": calls})
        if not calls:
            return Run("final", reply.get("content"), events)
        for call in calls:
            name = call["name"]
            made[name], made["calls"] = made.get(name, 0) + 1, made.get("calls", 0) + 1
            event = {"seq": len(events) + 1, "turn": turn, "tool": name, "arguments": call.get("arguments", {}), "result": None, "error": None}
            events.append(event)
            if any(made.get(k, 0) > most for k, most in (caps or {}).items()):
                event["error"] = "over budget"
                return Run("budget", None, events)
            try:
                event["result"] = tools[name](**event["arguments"])
            except KeyError:
                event["error"] = f"unknown tool: {name}"
            except (ValueError, TypeError) as error:
                event["error"] = str(error)
            if name == "search":
                found = {h.get("chunk_id") or h.get("doc_id") for h in event["result"] or []}
                dry = 0 if found - seen else dry + 1
                seen |= found
            messages.append({"role": "tool", "name": name, "content": event["result"] if event["error"] is None else {"error": event["error"]}})
    return Run("max_turns", None, events)
