"""Queries of traces: events as tool calls, conversations as messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import agent, answers, irmetrics, stats
from tarn.plans.base import query, scratch, table
from tarn.streaming import budgets


@query("""
WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant')
SELECT c.conv_id AS run_id, c.turn AS seq, length(c.text)::INT AS asked, length(r.text)::INT AS result FROM c LEFT JOIN r USING (conv_id, n)
""")
def trace_pairing(spark, sf):
    """Calls with their observations, by order."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.lit(1).alias("turn"), "role", F.length("text").alias("n"))
    calls = rows.where("role = 'user'").select("run_id", "seq", "turn", F.col("n").alias("asked"))
    results = rows.where("role = 'assistant'").select("run_id", "seq", "turn", F.col("n").alias("result"))
    return agent.paired(calls, results).select("run_id", "seq", "asked", "result")


EVENTS = "e AS (SELECT user_id AS run_id, event_id AS seq, event_type AS tool, value, event_id % 40 AS source FROM events)"


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), "value", (F.col("event_id") % 40).alias("source"))


@query(f"""WITH {EVENTS}, u AS (SELECT *, count(*) OVER w AS used_calls, sum(CASE WHEN tool = 'view' THEN 1 ELSE 0 END) OVER w AS used_reads FROM e WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
o AS (SELECT *, used_calls > 12 OR used_reads > 4 AS over FROM u)
SELECT run_id, seq, used_calls::BIGINT AS used_calls, used_reads::BIGINT AS used_reads, over, max(over::INT) OVER (PARTITION BY run_id ORDER BY seq) = 0 AS delivered FROM o""")
def budget_prefix(spark, sf):
    """Running use of two budgets; what goes over is kept but not delivered."""
    one = F.lit(1).cast("long")
    found = agent.budgeted(_events(spark, sf), {"calls": 12, "reads": 4}, {"calls": one, "reads": F.when(F.col("tool") == "view", one)})
    return found.select("run_id", "seq", "used_calls", "used_reads", "over", "delivered")


@query("""
WITH e AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'signup' THEN 'match' ELSE event_type END AS tool,
 epoch_ms(ts) AS at_ms, event_id % 5 * 3600000 AS took, event_id % 100 AS tokens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
u AS (SELECT *, at_ms - first_value(at_ms) OVER c AS age, count(*) OVER p AS calls, count(*) FILTER (WHERE tool IN ('search', 'match')) OVER p AS queries,
 count(*) FILTER (WHERE tool = 'read') OVER p AS reads, sum(tokens) OVER c AS used
 FROM e WINDOW c AS (PARTITION BY run_id ORDER BY seq), p AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN age >= 1728000000 THEN 'elapsed_ms' WHEN calls >= 45 THEN 'tool_calls' WHEN tool IN ('search', 'match') AND queries >= 20 THEN 'query_calls' WHEN tool = 'read' AND reads >= 25 THEN 'read_calls' END AS barred,
 CASE WHEN age + took >= 1728000000 THEN 'elapsed_ms' WHEN used > 2000 THEN 'evidence_tokens' END AS withheld FROM u),
s AS (SELECT *, min(seq) FILTER (WHERE coalesce(barred, withheld) IS NOT NULL) OVER r AS stop, arg_min(coalesce(barred, withheld), seq) FILTER (WHERE coalesce(barred, withheld) IS NOT NULL) OVER r AS why
 FROM v WINDOW r AS (PARTITION BY run_id))
SELECT run_id, seq, seq < coalesce(stop, seq + 1) OR (seq = stop AND barred IS NULL) AS executed, seq < coalesce(stop, seq + 1) AS delivered, CASE WHEN seq >= stop THEN why END AS reason,
 coalesce(sum(CASE WHEN seq < coalesce(stop, seq + 1) THEN tokens END) OVER (PARTITION BY run_id ORDER BY seq), 0)::BIGINT AS delivered_tokens FROM s
""")
def budget_stream(spark, sf):
    """The events replayed as a stream of calls: which were made, and whose results came in time and within the budgets."""
    seen = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(f"{sf}/events.parque[t]")  # a pattern, as a stream takes no single file
    tool = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "signup", "match").otherwise(F.col("event_type"))
    calls = seen.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), tool.alias("tool"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 5 * 3_600_000).alias("took_ms"), (F.col("event_id") % 100).alias("tokens"),
    )
    limits = budgets.Limits(tool_calls=45, query_calls=20, read_calls=25, evidence_tokens=2000, elapsed_ms=20 * 86_400_000)
    # a replay of history: nothing is late, no run is idle
    decided, place = budgets.budgeted_calls(calls, limits, idle="3650 days", delay="3650 days"), scratch(spark)
    with budgets.keyed_state(spark):
        replay = decided.writeStream.format("parquet").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start(f"{place}/calls")
        replay.awaitTermination()
    made = spark.read.schema(budgets.CALLS).parquet(f"{place}/calls").where("kind = 'call'")
    return made.select("run_id", "seq", "executed", "delivered", "reason", "delivered_tokens")


@query("""SELECT user_id AS run_id, count(*)::BIGINT AS events, CASE WHEN count(t) = count(*) THEN sum(t) END::BIGINT AS tokens_total, coalesce(sum(t), 0)::BIGINT AS tokens_known
FROM (SELECT user_id, CASE WHEN event_id % 13 <> 0 THEN event_id % 100 END AS t FROM events) GROUP BY user_id""")
def usage_totals(spark, sf):
    """A total only where every call has a value."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 100).alias("tokens"))
    return agent.usage_totals(rows, ["tokens"], ["run_id"])


@query("SELECT user_id, event_type, count(*)::BIGINT AS calls, count(DISTINCT props)::BIGINT AS arguments FROM events GROUP BY user_id, event_type")
def tool_usage_by_user(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.count_distinct("props").alias("arguments"))


@query(f"""WITH {EVENTS}, f AS (SELECT run_id, source, min(seq) AS seq FROM e GROUP BY run_id, source), n AS (SELECT run_id, seq, count(*) AS k FROM f GROUP BY run_id, seq),
s AS (SELECT run_id, seq, coalesce(k, 0) AS k, lag(coalesce(k, 0)) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM (SELECT run_id, seq FROM e WHERE tool IN ('view', 'click')) LEFT JOIN n USING (run_id, seq))
SELECT run_id, seq, k::BIGINT AS new_evidence, coalesce(k = 0 AND b = 0, false) AS stalled FROM s""")
def stall_detect(spark, sf):
    """Searches that, like the one before, found nothing new."""
    e = _events(spark, sf)
    hits = e.select("run_id", "seq", F.col("source").alias("evidence_id"))
    return agent.stalled(hits, e.where("tool IN ('view', 'click')").select("run_id", "seq")).select("run_id", "seq", "new_evidence", "stalled")


@query(f"WITH {EVENTS} SELECT run_id, sum(tokens)::BIGINT AS tokens FROM (SELECT run_id, source, any_value(source + 1) AS tokens FROM e GROUP BY run_id, source) GROUP BY run_id")
def unique_excerpt_tokens(spark, sf):
    rows = _events(spark, sf).select("run_id", "source", (F.col("source") + 1).alias("tokens"))
    return agent.unique_tokens(rows, ["source"])


NEED = "need AS (SELECT DISTINCT run_id, source FROM e WHERE source % 20 = 3)"


def _needed(spark, sf):
    return _events(spark, sf).where("source % 20 = 3").select("run_id", "source").distinct()


@query(f"""WITH {EVENTS}, {NEED}, f AS (SELECT run_id, source, min(seq) AS got_at FROM e JOIN need USING (run_id, source) GROUP BY run_id, source), d AS (SELECT run_id, max(got_at) AS got_at FROM f GROUP BY run_id)
SELECT e.run_id, any_value(got_at)::BIGINT AS sufficient_at, CASE WHEN any_value(got_at) IS NOT NULL THEN count(*) FILTER (WHERE seq > got_at) END::BIGINT AS later_calls FROM e LEFT JOIN d USING (run_id) GROUP BY e.run_id""")
def evidence_sufficient(spark, sf):
    """The call by which all needed sources were seen, and calls after it."""
    return answers.sufficiency(_events(spark, sf).select("run_id", "seq", "source"), _needed(spark, sf))


@query(f"""WITH {EVENTS}, {NEED}, f AS (SELECT run_id, source, min(seq) AS got_at FROM e JOIN need USING (run_id, source) GROUP BY run_id, source), d AS (SELECT run_id, max(got_at) AS got_at FROM f GROUP BY run_id)
SELECT d.run_id, min(seq)::BIGINT AS turn FROM d JOIN e USING (run_id) WHERE tool = 'click' AND got_at < seq GROUP BY d.run_id""")
def first_full_turn(spark, sf):
    """The first model turn with all needed evidence before it."""
    e = _events(spark, sf).select("run_id", F.col("seq").alias("turn"), "source", "tool")
    return answers.first_full_turn(e.drop("tool"), e.where("tool = 'click'").select("run_id", "turn"), _needed(spark, sf))


@query(f"""WITH {EVENTS} SELECT run_id, count(DISTINCT source)::BIGINT AS returned, count(DISTINCT source) FILTER (WHERE seq % 3 <> 0)::BIGINT AS delivered, count(DISTINCT source) FILTER (WHERE seq % 3 <> 0 AND seq % 2 = 0)::BIGINT AS submitted FROM e GROUP BY run_id""")
def delivery_coverage(spark, sf):
    rows = _events(spark, sf).select("run_id", "source", (F.col("seq") % 3 != 0).alias("delivered"), (F.col("seq") % 2 == 0).alias("submitted"))
    return answers.delivery(rows)


@query(f"""WITH {EVENTS}, {NEED}, s AS (SELECT run_id, source, true AS r, bool_or(seq % 3 <> 0) AS d, bool_or(seq % 3 <> 0 AND seq % 2 = 0) AS u FROM e GROUP BY run_id, source),
n AS (SELECT run_id, unnest(range(0, 40)) AS source FROM (SELECT DISTINCT run_id FROM e)), q AS (SELECT n.run_id, n.source, coalesce(r, false) AS r, coalesce(d, false) AS d, coalesce(u, false) AS u FROM n LEFT JOIN s USING (run_id, source) WHERE n.source % 20 = 3),
x AS (SELECT run_id, list_filter([CASE WHEN bool_or(NOT r) THEN 'missed_returned' END, CASE WHEN bool_or(r AND NOT d) THEN 'lost_at_delivered' END, CASE WHEN bool_or(d AND NOT u) THEN 'lost_at_submitted' END], lambda v: v IS NOT NULL) AS tags FROM q GROUP BY run_id),
y AS (SELECT unnest(CASE WHEN len(tags) = 0 THEN ['none'] ELSE tags END) AS tag FROM x)
SELECT tag, count(*)::BIGINT AS n FROM y GROUP BY tag""")
def delivery_failure_tags(spark, sf):
    """Where needed sources got lost on their way: not returned, not delivered, not submitted."""
    e = _events(spark, sf)
    needed = e.select("run_id").distinct().withColumn("source", F.explode(F.array(*[F.lit(n).cast("long") for n in (3, 23)])))
    qrels = needed.select(F.col("run_id").alias("query_id"), F.col("source").alias("doc_id"), F.lit(1).alias("grade"))
    one = lambda df, name: df.select(F.col("run_id").alias("query_id"), F.lit(name).alias("stage"), F.col("source").alias("doc_id"))
    stages = one(e, "returned").unionByName(one(e.where("seq % 3 <> 0"), "delivered")).unionByName(one(e.where("seq % 3 <> 0 AND seq % 2 = 0"), "submitted"))
    return irmetrics.tag_counts(irmetrics.failure_tags(stages, qrels, ["returned", "delivered", "submitted"]))


@query(f"WITH {EVENTS}, c AS (SELECT run_id, run_id % 3 AS task, count(*) AS calls FROM e GROUP BY run_id) SELECT task, count(*)::BIGINT AS runs, round(quantile_cont(calls, 0.5), 6) AS p50, round(quantile_cont(calls, 0.9), 6) AS p90, max(calls)::BIGINT AS most FROM c GROUP BY task")
def agent_distribution(spark, sf):
    """Distribution of calls a run, by kind of task."""
    calls = _events(spark, sf).groupBy("run_id").agg(F.count("*").alias("calls")).withColumn("task", F.col("run_id") % 3)
    points = stats.percentiles(calls, "calls", [0.5, 0.9], ["task"]).select("task", F.round("p0", 6).alias("p50"), F.round("p1", 6).alias("p90"))
    return calls.groupBy("task").agg(F.count("*").alias("runs"), F.max("calls").alias("most")).join(points, "task")


# Cases: users; what they should find and which tools they may use follow from their number.
CASES = f"""WITH {EVENTS}, c AS (SELECT run_id, [run_id % 40, (run_id + 1) % 40] AS expected, CASE run_id % 3 WHEN 0 THEN 'direct_read' WHEN 1 THEN 'no_retrieval' ELSE 'exact_lookup' END AS task,
 CASE WHEN run_id % 5 = 0 THEN 'max_turns' WHEN run_id % 7 = 0 THEN NULL ELSE 'final' END AS stop FROM (SELECT DISTINCT run_id FROM e)),
t AS (SELECT run_id, CASE tool WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'signup' THEN 'match' ELSE tool END AS tool, source FROM e),
k AS (SELECT c.*, count(t.tool) AS calls, count(*) FILTER (WHERE t.tool IN ('read', 'search', 'match')) AS known, bool_or(t.tool = 'error') AS bad,
 list_distinct(list(t.source) FILTER (WHERE t.tool IN ('read', 'search', 'match'))) AS found, list_distinct(list(t.source) FILTER (WHERE t.tool = 'read')) AS read
 FROM c LEFT JOIN t USING (run_id) GROUP BY ALL),
m AS (SELECT *, len(list_intersect(expected, coalesce(found, []))) / 2.0::DOUBLE AS recall, len(list_intersect(expected, coalesce(read, []))) AS nread FROM k),
r AS (SELECT run_id, task, stop, calls, known, recall, CASE WHEN stop IS NULL THEN ['trace_unavailable'] ELSE list_filter([CASE WHEN stop <> 'final' THEN 'not_final' END, CASE WHEN bad THEN 'forbidden_tool' END,
 CASE WHEN calls > 30 THEN 'max_tool_calls_exceeded' END, CASE WHEN task = 'no_retrieval' AND known > 0 THEN 'unnecessary_retrieval' END, CASE WHEN recall < 0.5 THEN 'source_recall_below_threshold' END,
 CASE WHEN task = 'direct_read' AND nread < 2 THEN 'target_not_read' END, CASE WHEN nread < 1 THEN 'insufficient_read_sources' END], lambda x: x IS NOT NULL) END AS reasons FROM m)
"""


def _scored(spark, sf):
    e = _events(spark, sf)
    run = F.col("run_id")
    tool = F.when(F.col("tool") == "view", "read").when(F.col("tool") == "click", "search").when(F.col("tool") == "signup", "match").otherwise(F.col("tool"))
    calls = e.select(run.alias("trial_id"), "seq", tool.alias("tool"), F.array(F.col("source").cast("string")).alias("sources"))
    runs = e.select("run_id").distinct()
    task = F.when(run % 3 == 0, "direct_read").when(run % 3 == 1, "no_retrieval").otherwise("exact_lookup")
    cases = runs.select(
        run.alias("case_id"), task.alias("task_type"), F.array((run % 40).cast("string"), ((run + 1) % 40).cast("string")).alias("expected_sources"),
        F.lit(None).cast("array<string>").alias("allowed_tools"), F.array(F.lit("error")).alias("forbidden_tools"), F.lit(30).alias("max_tool_calls"),
        F.lit(0.5).alias("min_source_recall"), F.lit(1).alias("min_read_sources"),
    )
    stop = F.when(run % 5 == 0, "max_turns").when(run % 7 == 0, F.lit(None)).otherwise("final")
    return answers.case_scores(cases, runs.select(run.alias("trial_id"), run.alias("case_id"), stop.alias("stop_reason")), calls)


@query(f"""{CASES} SELECT run_id AS trial_id, task AS task_type, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS success, CASE WHEN stop IS NOT NULL THEN round(recall, 6) END AS source_recall,
CASE WHEN stop IS NOT NULL THEN calls END::BIGINT AS tool_calls, CASE WHEN stop IS NOT NULL AND task = 'no_retrieval' THEN known > 0 END AS unnecessary_retrieval FROM r""")
def agent_case_scores(spark, sf):
    """Each run's outcome and failure reasons."""
    found = _scored(spark, sf)
    return found.select("trial_id", "task_type", F.concat_ws(",", "failure_reasons").alias("reasons"), "success", F.round("source_recall", 6).alias("source_recall"), "tool_calls", "unnecessary_retrieval")


@query(f"""{CASES} SELECT task AS task_type, count(*)::BIGINT AS trials, count(*) FILTER (WHERE len(reasons) = 0)::BIGINT AS successes, round(avg((len(reasons) = 0)::INT), 6) AS success_rate,
round(avg(CASE WHEN stop IS NOT NULL THEN recall END), 6) AS source_recall, count(stop)::BIGINT AS recall_defined, round(avg(CASE WHEN stop IS NOT NULL THEN calls END), 6) AS tool_calls FROM r GROUP BY GROUPING SETS ((), (task))""")
def agent_summary(spark, sf):
    """Overall and by task type."""
    return answers.run_summary(_scored(spark, sf))


@query("""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars > 200 END AS executed, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang <> 'de' END AS evidence_ok, quality = 1 AS grounding_review, toxic = 0 AS utility_review FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, executed AND evidence_ok AND grounding_review AS grounded, executed AND evidence_ok AND grounding_review AND utility_review AS useful FROM r
""")
def output_verdicts(spark, sf):
    """Three-valued: unknown if anything is unknown and nothing fails."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = d.select(
        "doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") > 200).alias("executed"), F.when(F.col("doc_id") % 5 != 0, F.col("lang") != "de").alias("evidence_ok"),
        (F.col("quality") == 1).alias("grounding_review"), (F.col("toxic") == 0).alias("utility_review"),
    )
    return answers.verdicts(rows).select("doc_id", "grounded", "useful")


@query(r"""
WITH p AS (SELECT item_id AS id, text AS prediction FROM benchmark), n AS (SELECT id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(prediction), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM p),
g AS (SELECT id, list_filter(w, lambda x, i: i % 2 = 1) AS g, w FROM n),
c AS (SELECT id, (SELECT coalesce(sum(least(len(list_filter(w, lambda x: x = t)), len(list_filter(g, lambda x: x = t)))), 0) FROM (SELECT unnest(list_distinct(w)) AS t)) AS shared, len(w) + len(g) + 1 AS total FROM g)
SELECT id, round(CASE WHEN id % 4 = 0 THEN 1 ELSE 2.0::DOUBLE * shared / total END, 6) AS f1, CASE WHEN id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS em FROM c
""")
def answer_f1(spark, sf):
    """The best bag F1 and exact match over gold answers: every other word and a foreign one, and for some items
    the same answer with an article and punctuation."""
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prediction"))
    words = F.filter(F.split(answers.normalised(F.col("prediction")), " "), lambda w: w != "")
    gold = F.concat_ws(" ", F.filter(words, lambda w, i: i % 2 == 0), F.lit("zyxwvu"))
    same = F.when(F.col("id") % 4 == 0, F.concat(F.lit("The "), "prediction", F.lit("!")))
    found = answers.answer_scores(rows.withColumn("aliases", F.array_compact(F.array(gold, same))))
    return found.select("id", F.round("f1", 6).alias("f1"), "em")


@query("""
WITH d AS (SELECT doc_id, doc_id // 2 AS id, doc_id % 2 = 0 AS answerable, n_chars > 500 AS correct, (doc_id % 10) / 10.0::DOUBLE AS f1 FROM documents),
g AS (SELECT id, bool_and(correct) AS good, max(f1) FILTER (WHERE answerable) AS f1 FROM d GROUP BY id HAVING count(*) = 2)
SELECT id, round(CASE WHEN good THEN f1 ELSE 0 END, 6) AS answer, round(CASE WHEN good THEN f1 / 2 ELSE 0 END, 6) AS support FROM g
""")
def pair_joint(spark, sf):
    """Pairs of answerable and unanswerable variants count only if both were judged rightly."""
    docs = table(spark, sf, "documents")
    rows = docs.select(
        F.floor(F.col("doc_id") / 2).alias("id"), (F.col("doc_id") % 2 == 0).alias("answerable"), (F.col("n_chars") > 500).alias("correct"), ((F.col("doc_id") % 10) / 10.0).alias("f1"),
        ((F.col("doc_id") % 10) / 20.0).alias("support"),
    )
    whole = rows.groupBy("id").agg(F.count("*").alias("n")).where("n = 2").select("id")
    return answers.pair_joint(rows.join(whole, "id", "left_semi")).select("id", F.round("answer", 6).alias("answer"), F.round("support", 6).alias("support"))


@query("""
WITH r AS (SELECT doc_id % 3 + 2 AS hops, quality = 1 AS answerable, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE toxic = 0 END AS said, (doc_id % 10) / 10.0::DOUBLE AS f1 FROM labels)
SELECT hops, answerable, count(*)::BIGINT AS n, round(avg(f1), 6) AS f1, count(*) FILTER (WHERE said)::BIGINT AS said_yes, count(*) FILTER (WHERE NOT said)::BIGINT AS said_no, count(*) FILTER (WHERE said IS NULL)::BIGINT AS undefined FROM r GROUP BY hops, answerable
""")
def hop_breakdown(spark, sf):
    """By number of hops; answerability has three values."""
    d = F.col("doc_id")
    rows = table(spark, sf, "labels").select(
        (d % 3 + 2).alias("hops"), (F.col("quality") == 1).alias("answerable"), F.when(d % 6 != 0, F.col("toxic") == 0).alias("predicted_answerable"), ((d % 10) / 10.0).alias("f1")
    )
    return answers.hop_breakdown(rows)


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'x' || doc_id WHEN 1 THEN 'x' || doc_id END AS answer, CASE WHEN doc_id % 6 < 2 THEN doc_id % 2 = 0 END AS answerable, CASE WHEN doc_id % 6 < 2 THEN 2 END::INT AS supports, doc_id % 6 > 1 AS broken FROM documents
""")
def predictions_parsed(spark, sf):
    """Predictions of multi-hop answers; one code fence is allowed, anything else is an error."""
    d = F.col("doc_id")
    good = F.concat(F.lit('{"predicted_answer":"x'), d, F.lit('","predicted_answerable":'), (d % 2 == 0).cast("string"), F.lit(',"predicted_support_idxs":[1,2]}'))
    raw = (
        F.when(d % 6 == 0, good)
        .when(d % 6 == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(d % 6 == 2, F.concat(F.lit("so: "), good))
        .when(d % 6 == 3, F.replace(good, F.lit("[1,2]"), F.lit('["1"]')))
        .when(d % 6 == 4, F.lit('{"predicted_answer":"x"}'))
    )
    p = table(spark, sf, "documents").select("doc_id", answers.parsed_prediction(raw).alias("p"))
    return p.select("doc_id", "p.answer", "p.answerable", F.when(F.col("p.support").isNotNull(), F.size("p.support")).alias("supports"), F.col("p.error").isNotNull().alias("broken"))


@query("SELECT r_regionkey AS run_id, CASE WHEN r_regionkey % 2 = 0 THEN 'final' ELSE 'max_turns' END AS stop_reason, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS answer, (r_regionkey % 3 + CASE WHEN r_regionkey % 2 = 0 THEN 0 ELSE 2 - r_regionkey % 3 END)::BIGINT AS calls FROM region")
def agent_loop(spark, sf):
    """Bounded runs of a scripted model over a tool that asks a table: one for each region."""
    nations = table(spark, sf, "nation")
    rows = []
    for region in table(spark, sf, "region").collect():  # 5 rows
        key, left = region["r_regionkey"], [region["r_regionkey"] % 3]

        def chat(messages, key=key, left=left, name=region["r_name"]):
            if key % 2 == 0 and not left[0]:
                return {"content": name}
            left[0] -= 1
            return {"tool_calls": [{"name": "search", "arguments": {"query": name}}]}

        def search(query, key=key):
            return [{"doc_id": r["n_nationkey"]} for r in nations.where(F.col("n_regionkey") == key).collect()]

        run = agent.run_agent("which region?", chat, {"search": search}, max_turns=3 if key % 2 == 0 else 2)
        rows.append((key, run.stop_reason, run.answer, len(run.events)))
    return spark.createDataFrame(rows, "run_id long, stop_reason string, answer string, calls long")
