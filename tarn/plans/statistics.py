"""Queries of statistics and experiment design over labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import answers, irmetrics, stats
from tarn.plans.base import query, table

Z = "1.959963984540054"


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _wilson(s, n):
    mid = f"({s}/{n}::DOUBLE + {Z}*{Z}/(2*{n}))/(1+{Z}*{Z}/{n})"
    half = f"{Z}*sqrt({s}/{n}::DOUBLE*(1-{s}/{n}::DOUBLE)/{n} + {Z}*{Z}/(4.0::DOUBLE*{n}*{n}))/(1+{Z}*{Z}/{n})"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0, {mid} - {half}), 6) END", f"CASE WHEN {n} > 0 THEN round(least(1, {mid} + {half}), 6) END"


_LOW, _HIGH = _wilson("s", "n")


@query(f"WITH g AS (SELECT source, count(*) FILTER (WHERE quality = 1)::DOUBLE AS s, count(quality)::DOUBLE AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) SELECT source, n::BIGINT AS n, {_LOW} AS low, {_HIGH} AS high FROM g")
def wilson(spark, sf):
    """Interval of the share of good documents, by source; null without labels."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    g = rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("s"), F.count("quality").alias("n"))
    low, high = stats.wilson(F.col("s"), F.col("n"))
    return g.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


# Two reviewers of a document: grades from its labels and from its id.
@query("""
WITH p AS (SELECT (quality * 2 + toxic)::INT AS a, ((quality * 2 + toxic + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END) % 4)::INT AS b FROM labels),
n AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS exact, avg(pow((a - b) / 3.0::DOUBLE, 2)) AS o FROM p),
e AS (SELECT sum(x * y * pow((a - b) / 3.0::DOUBLE, 2)) AS e FROM (SELECT a, count(*) AS x FROM p GROUP BY a), (SELECT b, count(*) AS y FROM p GROUP BY b))
SELECT n::BIGINT AS pairs, round(exact, 6) AS exact, round(1 - o / (e / (n * n)), 6) AS kappa FROM n, e
""")
def kappa(spark, sf):
    """Agreement of two reviewers with quadratic weights."""
    first = (F.col("quality") * 2 + F.col("toxic")).cast("int")
    pairs = table(spark, sf, "labels").select(first.alias("first"), ((first + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)) % 4).alias("second"))
    return _six(stats.weighted_kappa(pairs), "exact", "kappa")


# A judge that passes short documents, and knows nothing about some.
CALIBRATION = "c AS (SELECT quality = 1 AS human, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE n_chars < 3000 END AS judge, lang FROM documents JOIN labels USING (doc_id))"
_FLOW, _FHIGH = _wilson("fp", "(fp+tn)")


@query(f"""WITH {CALIBRATION}, m AS (SELECT lang, count(*) FILTER (WHERE judge AND human) AS tp, count(*) FILTER (WHERE judge AND NOT human) AS fp, count(*) FILTER (WHERE NOT judge AND NOT human) AS tn,
count(*) FILTER (WHERE NOT judge AND human) AS fn, count(*) FILTER (WHERE judge IS NULL) AS missing, count(*) AS cases FROM c GROUP BY lang)
SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, missing::BIGINT AS missing, cases::BIGINT AS cases, round((cases - missing) / cases::DOUBLE, 6) AS coverage,
round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS false_accept, {_FLOW} AS false_accept_low, {_FHIGH} AS false_accept_high, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM m""")
def confusion(spark, sf):
    """A judge against people, by language."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = rows.select("lang", (F.col("quality") == 1).alias("human"), F.when(F.col("doc_id") % 10 == 3, F.lit(None)).otherwise(F.col("n_chars") < 3000).alias("judge"))
    return _six(stats.confusion(rows, "human", "judge", ["lang"]), "coverage", "false_accept", "false_accept_low", "false_accept_high", "recall")


# Families: users; cases: hours; arms: views and clicks.
def _trials(spark, sf):
    e = table(spark, sf, "events").where("event_type IN ('view', 'click') AND value IS NOT NULL")
    arm = F.when(F.col("event_type") == "view", "left").otherwise("right")
    rows = e.select(F.col("user_id").alias("family_id"), (F.col("event_id") % 3).alias("case_id"), arm.alias("arm"), "value")
    whole = rows.groupBy("family_id", "case_id").agg(F.count_distinct("arm").alias("n")).where("n = 2")
    return rows.join(whole.select("family_id", "case_id"), ["family_id", "case_id"], "left_semi")


FAMILIES = """c AS (SELECT user_id AS family_id, event_id % 3 AS case_id, avg(value) FILTER (WHERE event_type = 'view') AS l, avg(value) FILTER (WHERE event_type = 'click') AS r
FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL GROUP BY ALL HAVING l IS NOT NULL AND r IS NOT NULL),
f AS (SELECT family_id, avg(l) AS left_mean, avg(r) AS right_mean FROM c GROUP BY family_id)"""


@query(f"WITH {FAMILIES} SELECT family_id, round(left_mean, 6) AS left_mean, round(right_mean, 6) AS right_mean, round(right_mean - left_mean, 6) AS delta FROM f")
def family_means(spark, sf):
    return _six(stats.family_means(_trials(spark, sf)), "left_mean", "right_mean", "delta")


@query(f"""WITH {FAMILIES} SELECT count(*)::BIGINT AS families, round(avg(left_mean), 6) AS left_mean, round(avg(right_mean), 6) AS right_mean, round(avg(right_mean - left_mean), 6) AS delta,
count(*) FILTER (WHERE right_mean > left_mean)::BIGINT AS wins, count(*) FILTER (WHERE right_mean = left_mean)::BIGINT AS ties, count(*) FILTER (WHERE right_mean < left_mean)::BIGINT AS losses FROM f""")
def paired_summary(spark, sf):
    return _six(stats.paired_summary(stats.family_means(_trials(spark, sf))), "left_mean", "right_mean", "delta")


@query(f"""WITH {FAMILIES}, n AS (SELECT row_number() OVER (ORDER BY family_id) - 1 AS family, right_mean - left_mean AS delta, count(*) OVER () AS n FROM f),
m AS (SELECT i, j, md5('0:' || i || ':' || j) AS h FROM (SELECT unnest(range(0, 10000)) AS i), (SELECT unnest(range(0, (SELECT (max(n) - 1) // 4 + 1 FROM n))) AS j)),
r AS (SELECT i, j * 4 + k AS place, ('0x' || substr(h, (8 * k + 1)::BIGINT, 8))::BIGINT AS bits FROM m, (SELECT unnest(range(0, 4)) AS k)),
s AS (SELECT i, avg(delta) AS mean FROM r JOIN n ON family = bits % n AND place < n GROUP BY i)
SELECT (SELECT count(*) FROM f)::BIGINT AS families, round((SELECT avg(delta) FROM n), 6) AS delta, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM s""")
def bootstrap_ci(spark, sf):
    """Percentile interval over 10,000 samples of families."""
    return _six(stats.bootstrap(stats.family_means(_trials(spark, sf)), resamples=10_000), "delta", "low", "high")


@query("""
WITH n AS (SELECT DISTINCT user_id % 200 AS n FROM events), k AS (SELECT n, unnest(range(0, n // 2 + 1)) AS k FROM n),
t AS (SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) OVER (PARTITION BY n ORDER BY k) AS tail FROM k)
SELECT n::BIGINT AS discordant, (count(*) FILTER (WHERE 2 * tail <= 0.05) - 1)::INT AS critical FROM t GROUP BY n
""")
def mcnemar_critical(spark, sf):
    """Largest minority of discordant pairs that the exact test rejects."""
    n = table(spark, sf, "events").select((F.col("user_id") % 200).alias("discordant")).distinct()
    return stats.critical_minorities(n)


@query("""
WITH s AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'left' ELSE 'right' END AS arm FROM labels UNION ALL SELECT doc_id, 'right' FROM labels WHERE toxic = 1),
e AS (SELECT DISTINCT doc_id, arm FROM documents, (SELECT unnest(['left', 'right']) AS arm))
SELECT arm, doc_id AS query_id, 'missing' AS problem FROM e WHERE (doc_id, arm) NOT IN (SELECT (doc_id, arm) FROM s)
UNION ALL SELECT DISTINCT arm, doc_id, 'extra' FROM s WHERE (doc_id, arm) NOT IN (SELECT (doc_id, arm) FROM e)
UNION ALL SELECT arm, doc_id, 'duplicate' FROM s GROUP BY ALL HAVING count(*) > 1
""")
def matrix_problems(spark, sf):
    """Which rows a comparison of two arms lacks or has twice."""
    labels = table(spark, sf, "labels")
    first = labels.select(F.when(F.col("quality") == 1, "left").otherwise("right").alias("arm"), F.col("doc_id").alias("query_id"))
    scores = first.unionByName(labels.where("toxic = 1").select(F.lit("right").alias("arm"), F.col("doc_id").alias("query_id")))
    return stats.matrix_problems(scores, table(spark, sf, "documents").select(F.col("doc_id").alias("query_id")), ["left", "right"])


# Leakage groups: sources of documents; their families: languages.
SPLIT_SQL = """WITH RECURSIVE g AS (SELECT source AS "group", count(DISTINCT lang)::BIGINT AS families, min(doc_id) % 5 = 0 AS seen FROM documents GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY seen DESC, CASE WHEN seen THEN 0 ELSE -families END, CASE WHEN NOT seen THEN sha256('3:' || "group") END, "group") AS n FROM g),
t AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS "group", NULL::BIGINT AS families, NULL::VARCHAR AS split, 30::BIGINT AS d, 20::BIGINT AS v, 20::BIGINT AS e
 UNION ALL SELECT n, "group", families, split, d - CASE WHEN split = 'dev' THEN families ELSE 0 END, v - CASE WHEN split = 'validation' THEN families ELSE 0 END, e - CASE WHEN split = 'test' THEN families ELSE 0 END FROM (
  SELECT o.n, o."group", o.families, t.d, t.v, t.e, CASE WHEN o.seen THEN 'dev' ELSE list_extract(list_reverse_sort(list_filter([
    CASE WHEN t.d >= o.families THEN {'share': t.d / 30.0::DOUBLE, 'room': t.d, 'name': 'dev'} END, CASE WHEN t.v >= o.families THEN {'share': t.v / 20.0::DOUBLE, 'room': t.v, 'name': 'validation'} END,
    CASE WHEN t.e >= o.families THEN {'share': t.e / 20.0::DOUBLE, 'room': t.e, 'name': 'test'} END], lambda x: x IS NOT NULL)), 1).name END AS split FROM t JOIN o ON o.n = t.n + 1))
SELECT "group", families, split FROM t WHERE n > 0"""


@query(SPLIT_SQL)
def split_plan(spark, sf):
    """Splits of leakage groups, each choice after those before it."""
    g = table(spark, sf, "documents").groupBy(F.col("source").alias("group")).agg(F.count_distinct("lang").alias("families"), (F.min("doc_id") % 5 == 0).alias("seen"))
    return stats.plan_splits(g, {"dev": 30, "validation": 20, "test": 20}, seed=3)


@query("""
WITH e AS (SELECT doc_id, 0 AS seq, '' AS previous, md5(text) AS payload FROM documents), f AS (SELECT *, sha256(previous || chr(10) || payload) AS sha FROM e),
s AS (SELECT doc_id, 1 AS seq, CASE WHEN doc_id % 7 = 0 THEN 'tampered' ELSE sha END AS previous, lang AS payload FROM f JOIN documents USING (doc_id))
SELECT doc_id AS ledger_id, 0::INT AS seq, doc_id % 11 = 0 AS broken FROM f UNION ALL SELECT doc_id, 1, doc_id % 7 = 0 OR doc_id % 11 = 0 FROM s
""")
def ledger_check(spark, sf):
    """Entries whose hash isn't that of the entry before and their own payload."""
    d = F.col("ledger_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ledger_id"), "lang", F.md5(F.col("text").cast("binary")).alias("payload"))
    sha = lambda a, b: F.sha2(F.concat_ws("\n", a, b), 256)
    first = docs.select("ledger_id", "lang", F.lit(0).alias("seq"), F.lit("").alias("previous"), "payload").withColumn("sha", sha(F.col("previous"), F.col("payload")))
    second = first.select("ledger_id", F.lit(1).alias("seq"), F.when(d % 7 == 0, "tampered").otherwise(F.col("sha")).alias("previous"), F.col("lang").alias("payload"))
    second = second.withColumn("sha", sha(F.col("previous"), F.col("payload")))
    first = first.drop("lang").withColumn("sha", F.when(d % 11 == 0, F.sha2("sha", 256)).otherwise(F.col("sha")))
    return stats.chained(first.unionByName(second)).select("ledger_id", "seq", "broken")


@query("""
WITH q AS (SELECT item_id AS query_id, (item_id % 30)::VARCHAR AS family_id, md5(text) AS fingerprint FROM benchmark), f AS (SELECT DISTINCT family_id, family_id::INT AS k FROM q WHERE family_id::INT % 10 <> 9),
n AS (SELECT fingerprint, CASE WHEN query_id % 4 = 0 THEN 'moved' ELSE family_id END AS family_id FROM q WHERE query_id % 3 = 0)
SELECT 'family_unregistered' AS blocker, family_id FROM q WHERE family_id NOT IN (SELECT family_id FROM f) GROUP BY family_id
UNION ALL SELECT 'review_not_independent', family_id FROM f WHERE k % 4 = 0 OR k % 4 = 1
UNION ALL SELECT 'leakage_group_pending', family_id FROM f WHERE k % 6 = 0
UNION ALL SELECT 'permission_pending', family_id FROM f WHERE k % 7 = 0
UNION ALL SELECT 'pool_audit_pending', family_id FROM f WHERE k % 8 = 0
UNION ALL SELECT DISTINCT 'known_query_moved', q.family_id FROM q JOIN n USING (fingerprint) WHERE q.family_id <> n.family_id
UNION ALL SELECT 'known_family_unseen', family_id FROM f WHERE family_id IN (SELECT family_id FROM n) AND k % 5 <> 0
UNION ALL SELECT 'too_few_families', NULL FROM (SELECT count(*) AS n FROM f) WHERE n < 100
UNION ALL SELECT 'too_few_documents', NULL FROM (SELECT count(*) AS n FROM documents) WHERE n < 50
""")
def core_readiness(spark, sf):
    """What a dataset lacks before it may be frozen."""
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 30).cast("string").alias("family_id"), F.md5(F.col("text").cast("binary")).alias("fingerprint"))
    k = F.col("family_id").try_cast("int")
    families = queries.select("family_id").distinct().where(k % 10 != 9).select(
        "family_id", F.when(k % 6 == 0, " ").otherwise("g").alias("leakage_group"), (k % 5 == 0).alias("seen"), F.lit("ann").alias("author"),
        F.when(k % 4 == 0, F.array(F.lit("ann"))).otherwise(F.array(F.lit("bo"))).alias("reviewers"), F.when(k % 4 == 1, "pending").otherwise("reviewed").alias("review_status"),
        F.when(k % 7 != 0, "confirmed").alias("permission"), F.when(k % 8 == 0, "pending").otherwise("reviewed").alias("pool_status"),
    )
    known = queries.where("query_id % 3 = 0").select("fingerprint", F.when(F.col("query_id") % 4 == 0, "moved").otherwise(F.col("family_id")).alias("family_id"))
    return stats.readiness(families, queries, table(spark, sf, "documents"), known, {"dev": 60, "validation": 20, "test": 20}, 50)


@query("""
WITH a AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN ['m'] ELSE ['m', 'n'] END AS methods, CASE WHEN doc_id % 5 = 0 THEN [] ELSE [source] END AS pooled,
 CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN [source] WHEN 2 THEN ['nowhere'] ELSE [lang] END AS outside FROM documents), c AS (SELECT DISTINCT source FROM documents UNION SELECT DISTINCT lang FROM documents),
l AS (SELECT query_id, unnest(list_distinct(pooled || outside)) AS source FROM a)
SELECT query_id, 'pool_too_narrow' AS problem FROM a WHERE len(methods) < 2 OR len(pooled) = 0 UNION ALL SELECT query_id, 'nothing_outside' FROM a WHERE len(outside) = 0
UNION ALL SELECT query_id, 'overlap' FROM a WHERE list_has_any(pooled, outside) UNION ALL SELECT DISTINCT query_id, 'unknown_source' FROM l WHERE source NOT IN (SELECT source FROM c)
UNION ALL SELECT DISTINCT query_id, 'unreviewed' FROM l JOIN documents ON doc_id = query_id WHERE l.source <> documents.source
""")
def pool_audit(spark, sf):
    """Pools of judged candidates that are too narrow, overlap, or hold what nobody judged."""
    d = table(spark, sf, "documents")
    i, none = F.col("doc_id"), F.array().cast("array<string>")
    audits = d.select(
        i.alias("query_id"), F.when(i % 3 == 0, F.array(F.lit("m"))).otherwise(F.array(F.lit("m"), F.lit("n"))).alias("methods"), F.when(i % 5 == 0, none).otherwise(F.array("source")).alias("pooled"),
        F.when(i % 4 == 0, none).when(i % 4 == 1, F.array("source")).when(i % 4 == 2, F.array(F.lit("nowhere"))).otherwise(F.array("lang")).alias("outside"),
    )
    corpus = d.select("source").unionByName(d.select(F.col("lang").alias("source"))).distinct()
    return stats.pool_problems(audits, d.select(i.alias("query_id"), "source"), corpus)


@query("SELECT 'r' || (doc_id % 3) AS reviewer, count(quality)::BIGINT AS judged, round(avg(CASE WHEN quality IS NOT NULL THEN doc_id + 1.0 END), 6) AS mean_ms FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def reviewer_progress(spark, sf):
    """What each reviewer has judged, and how long it took them."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = rows.select(F.concat(F.lit("r"), F.col("doc_id") % 3).alias("reviewer"), F.col("quality").alias("grade"), (F.col("doc_id") + 1).cast("double").alias("duration_ms"))
    return _six(stats.reviewer_progress(rows), "mean_ms")


@query("SELECT id FROM (SELECT DISTINCT doc_id AS id FROM documents) ORDER BY sha256('7:' || id) LIMIT 25")
def hash_sample(spark, sf):
    """A sample that doesn't depend on the order of rows."""
    return stats.sampled_ids(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 7, 25)


@query("WITH s AS (SELECT id, row_number() OVER (ORDER BY sha256('7:' || id)) AS n FROM (SELECT DISTINCT doc_id AS id FROM documents)) SELECT size::INT AS size, id FROM s, (SELECT unnest([10, 40, 160]) AS size) WHERE n <= size")
def nested_scale(spark, sf):
    """Samples of three sizes, each within the next."""
    return stats.nested_samples(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 7, [10, 40, 160])


@query("""SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf):
    return irmetrics.latency(table(spark, sf, "events"), "value", ["event_type"])


# Trials: a user's purchases; a trial passes if it is over 50.
TRIALS = "t AS (SELECT user_id AS case_id, value > 50 AS success, event_type AS model FROM events WHERE event_type IN ('view', 'click', 'purchase'))"
KIND = "CASE WHEN count(*) < 3 THEN 'incomplete' WHEN count(*) FILTER (WHERE success) = count(*) THEN 'always_pass' WHEN count(*) FILTER (WHERE success) = 0 THEN 'always_fail' ELSE 'flaky' END"


def _runs(spark, sf):
    e = table(spark, sf, "events").where("event_type IN ('view', 'click', 'purchase')")
    return e.select(F.col("user_id").alias("case_id"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("success"), F.col("event_type").alias("model"))


@query(f"WITH {TRIALS} SELECT model, case_id, count(*)::BIGINT AS trials, count(*) FILTER (WHERE success)::BIGINT AS passes, {KIND} AS stability FROM t GROUP BY model, case_id")
def case_stability(spark, sf):
    """Cases that always pass, never pass, or waver."""
    return answers.stability(_runs(spark, sf), 3, ["model"])


@query(f"WITH {TRIALS}, c AS (SELECT model, case_id, count(*) FILTER (WHERE success) / count(*)::DOUBLE AS rate FROM t GROUP BY ALL) SELECT model, count(*)::BIGINT AS cases, round(avg(rate), 6) AS pass_at_1 FROM c GROUP BY model")
def pass_at_one(spark, sf):
    """Mean over cases of the share of trials that passed."""
    return _six(answers.pass_at_one(_runs(spark, sf), ["model"]), "pass_at_1")


@query(f"""WITH {TRIALS}, r AS (SELECT case_id, model, CASE model WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS size, count(*) FILTER (WHERE success) / count(*)::DOUBLE AS rate FROM t GROUP BY ALL),
b AS (SELECT *, lag(rate) OVER (PARTITION BY case_id ORDER BY size) AS before FROM r)
SELECT model, count(*)::BIGINT AS cases, count(*) FILTER (WHERE rate > before)::BIGINT AS wins, count(*) FILTER (WHERE rate < before)::BIGINT AS regressions FROM b GROUP BY model""")
def model_changes(spark, sf):
    """Wins and regressions of each model against the one before it in size."""
    size = F.when(F.col("model") == "view", 1).when(F.col("model") == "click", 2).otherwise(3)
    rates = _runs(spark, sf).groupBy("case_id", "model").agg((F.count_if("success") / F.count("*")).alias("rate")).withColumn("size", size)
    found = answers.model_changes(rates)
    n = lambda v: F.count_if(F.col("change") == v)
    return found.groupBy("model").agg(F.count("*").alias("cases"), n("win").alias("wins"), n("regression").alias("regressions"))


@query("""
WITH e AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 2 = 0), f AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 9 = 0)
SELECT doc_id, 'missing' AS problem FROM e WHERE doc_id NOT IN (SELECT doc_id FROM f)
UNION ALL SELECT DISTINCT doc_id, 'extra' FROM f WHERE doc_id NOT IN (SELECT doc_id FROM e)
UNION ALL SELECT doc_id, 'duplicate' FROM f GROUP BY doc_id HAVING count(*) > 1
""")
def completion_gate(spark, sf):
    """Rows that a run lacks, has too many of, or has twice."""
    expected = table(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id").distinct()
    labels = table(spark, sf, "labels").select("doc_id")
    return stats.gate(expected, labels.unionByName(labels.where("doc_id % 9 = 0")), ["doc_id"])


@query("SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY lang, source")
def dataset_profile(spark, sf):
    return stats.profile(table(spark, sf, "documents"), ["lang", "source"])


@query(r"""SELECT fingerprint, doc_id, n FROM (SELECT sha256(regexp_replace(trim(replace(lower(text), 'ß', 'ss'), chr(32) || chr(10) || chr(13) || chr(9)), '\s+', ' ', 'g')) AS fingerprint, doc_id, count(*) OVER (PARTITION BY fingerprint)::BIGINT AS n FROM documents) WHERE n > 1""")
def query_dedup(spark, sf):
    """Texts that differ in case and white space only."""
    from tarn.functions.text import query_fingerprint

    return stats.duplicates(table(spark, sf, "documents"), query_fingerprint(F.col("text")), "doc_id")


@query("""
WITH j AS (SELECT doc_id, 'g' || (doc_id % 5) AS q FROM documents), l AS (SELECT doc_id, quality FROM labels)
SELECT count(*)::BIGINT AS expected, count(quality)::BIGINT AS judged, (count(*) - count(quality))::BIGINT AS pending, round(count(quality) / count(*)::DOUBLE, 6) AS coverage,
count(*) FILTER (WHERE quality IS NOT NULL AND doc_id % 2 = 0)::BIGINT AS timed, round(avg(CASE WHEN quality IS NOT NULL AND doc_id % 2 = 0 THEN doc_id + 1.0 END), 6) AS mean_ms FROM j LEFT JOIN l USING (doc_id)
""")
def review_progress(spark, sf):
    """How far a review has come."""
    key = F.concat(F.lit("g"), F.col("doc_id") % 5)
    expected = table(spark, sf, "documents").select(key.alias("query_id"), F.col("doc_id").alias("source"))
    done = table(spark, sf, "labels").where("quality IS NOT NULL").select(
        key.alias("query_id"), F.col("doc_id").alias("source"), F.col("quality").alias("grade"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") + 1).cast("double")).alias("duration_ms")
    )
    return _six(stats.review_progress(expected, done), "coverage", "mean_ms")


@query("SELECT doc_id, (doc_id % 4)::BIGINT AS method, ((doc_id % 4) + doc_id) % 4 AS place FROM documents")
def rotated_order(spark, sf):
    """Run order that starts one step later for each case."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", (d % 4).alias("method"), stats.rotated(d % 4, d, 4).alias("place"))


@query("""
WITH q AS (SELECT item_id AS query_id, (item_id % 7) AS family_id, CASE WHEN item_id % 5 = 0 THEN 'test' ELSE 'dev' END AS split, item_id AS span_id FROM benchmark),
e AS (SELECT doc_id AS span_id, source, lang FROM documents WHERE doc_id % 3 <> 0),
p AS (SELECT 'unknown_span' AS problem, span_id::VARCHAR AS key FROM q WHERE span_id NOT IN (SELECT span_id FROM e)
 UNION SELECT 'split_leak', family_id::VARCHAR FROM q GROUP BY family_id HAVING count(DISTINCT split) > 1
 UNION SELECT 'unknown_query', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT query_id FROM q)
 UNION SELECT 'wrong_revision', span_id::VARCHAR FROM e WHERE lang <> 'en')
SELECT problem, key FROM p
""")
def dataset_integrity(spark, sf):
    """Broken references, split leaks and wrong revisions of a dataset."""
    item = F.col("item_id")
    queries = table(spark, sf, "benchmark").select(
        item.alias("query_id"), (item % 7).alias("family_id"), F.when(item % 5 == 0, "test").otherwise("dev").alias("split"), F.array(item).alias("span_ids")
    )
    docs = table(spark, sf, "documents")
    spans = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("span_id"), "source", F.col("lang").alias("document_revision"))
    corpus = docs.select("source").distinct().withColumn("document_revision", F.lit("en"))
    qrels = table(spark, sf, "labels").select(F.col("doc_id").alias("query_id")).withColumn("source", F.lit("src1"))
    return stats.integrity(queries, spans, qrels, corpus)


@query("""
SELECT s.doc_id AS query_id, s.doc_id AS doc_id, 'two_aspects' AS problem FROM labels s WHERE quality = 1 AND toxic = 1
UNION ALL SELECT d.doc_id, d.doc_id, 'no_aspect' FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 2 = 0 AND coalesce(quality, 0) = 0 AND coalesce(toxic, 0) = 0
""")
def aspect_problems(spark, sf):
    """Relevant documents under no aspect, and any under two."""
    labels = table(spark, sf, "labels")
    one = lambda c: labels.where(F.col(c) == 1).select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(c).alias("aspect_id"))
    qrels = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("grade"))
    return stats.aspect_problems(one("quality").unionByName(one("toxic")), qrels)


@query("""SELECT event_type, count(*)::BIGINT AS n, count(v)::BIGINT AS known, round(sum(v), 6) AS total, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS most
FROM (SELECT event_type, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events) GROUP BY event_type""")
def cost_distribution(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("v"))
    return answers.costs(rows, "v", ["event_type"])
