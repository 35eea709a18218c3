"""Queries of ranking metrics and of evidence: labels, intervals, facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions.text import terms
from tarn.operators import evidence, fusion, irmetrics, runs
from tarn.plans.base import query, table
from tarn.plans.retrieval import BM25, COSINE, COSINE_RANKED, LEGS, RANKED, _bm25, _cosine, _lists, _tokens

# A ranking of vectors, judged by labels: 3 for the query's label, 1 for the next label.
JUDGED = f"""WITH {COSINE}, ranked AS (SELECT query_id, vec_id AS doc_id, rank FROM ({COSINE_RANKED}) WHERE rank <= 20),
qrels AS (SELECT q.query_id, v.vec_id AS doc_id, CASE WHEN v.label = q.q_label THEN 3 ELSE 1 END AS grade
          FROM q JOIN v ON v.vec_id <> q.query_id AND v.vec_id % 7 <> 0 AND (v.label = q.q_label OR v.label = q.q_label + 1)),
j AS (SELECT coalesce(r.query_id, g.query_id) AS query_id, rank, grade FROM ranked r FULL JOIN qrels g ON r.query_id = g.query_id AND r.doc_id = g.doc_id),
"""


def _judged(spark, sf):
    ranked = _cosine(spark, sf, 20).withColumnRenamed("vec_id", "doc_id")
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    near = v.where("vec_id % 7 <> 0").withColumn("q_label", F.explode(F.array("label", F.col("label") - 1)))
    qrels = near.join(q, "q_label").where("vec_id <> query_id")
    grade = F.when(F.col("label") == F.col("q_label"), 3).otherwise(1)
    return ranked, qrels.select("query_id", F.col("vec_id").alias("doc_id"), grade.alias("grade"))


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _ideal(k, gain):
    return f"ideal{k} AS (SELECT query_id, sum(({gain}) / log2(i + 1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM qrels WHERE grade > 0) WHERE i <= {k} GROUP BY query_id)"


EXP = "pow(2.0::DOUBLE, grade) - 1"


@query(f"""{JUDGED} {_ideal(10, EXP)}
SELECT query_id, round(count(*) FILTER (WHERE grade > 0 AND rank <= 10) / nullif(count(*) FILTER (WHERE grade > 0), 0)::DOUBLE, 6) AS recall,
  CASE WHEN count(*) FILTER (WHERE grade > 0) > 0 THEN round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE grade > 0), 0), 6) END AS mrr,
  round(coalesce(sum(({EXP}) / log2(rank + 1)) FILTER (WHERE rank <= 10 AND grade IS NOT NULL), 0) / any_value(ideal), 6) AS ndcg
FROM j LEFT JOIN ideal10 USING (query_id) GROUP BY query_id""")
def ndcg_exp(spark, sf):
    """First convention: exponential gain, reciprocal rank of the whole list."""
    return _six(irmetrics.exponential(*_judged(spark, sf), k=10), "recall", "mrr", "ndcg")


@query(f"""{JUDGED} {_ideal(10, EXP)}
SELECT query_id, round(count(*) FILTER (WHERE grade >= 2 AND rank <= 10) / nullif(count(*) FILTER (WHERE grade >= 2), 0)::DOUBLE, 6) AS recall,
  CASE WHEN count(*) FILTER (WHERE grade >= 2) > 0 THEN round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE grade >= 2 AND rank <= 10), 0), 6) END AS mrr,
  round(coalesce(sum(({EXP}) / log2(rank + 1)) FILTER (WHERE rank <= 10 AND grade IS NOT NULL), 0) / any_value(ideal), 6) AS ndcg,
  CASE WHEN count(*) FILTER (WHERE grade >= 2) > 0 THEN round(count(*) FILTER (WHERE grade >= 2 AND rank <= 10) / 10.0::DOUBLE, 6) END AS precision,
  round(count(*) FILTER (WHERE rank <= 10 AND grade IS NOT NULL) / 10.0::DOUBLE, 6) AS assessed,
  (count(*) FILTER (WHERE rank <= 10))::BIGINT AS returned, (count(*) FILTER (WHERE rank <= 10 AND grade IS NULL))::BIGINT AS unassessed
FROM j LEFT JOIN ideal10 USING (query_id) GROUP BY query_id""")
def precision_assessed(spark, sf):
    """Second convention: a threshold, everything within the cut-off."""
    return _six(irmetrics.judged(*_judged(spark, sf), k=10), "recall", "mrr", "ndcg", "precision", "assessed")


@query(f"""{JUDGED} {_ideal(5, "grade")}, {_ideal(20, "grade")}
SELECT query_id,
  round(coalesce(sum(grade / log2(rank + 1)) FILTER (WHERE rank <= 5 AND grade IS NOT NULL), 0) / any_value(a.ideal), 6) AS ndcg_5,
  round(count(*) FILTER (WHERE grade > 0 AND rank <= 5) / nullif(count(*) FILTER (WHERE grade > 0), 0)::DOUBLE, 6) AS recall_5,
  CASE WHEN count(*) FILTER (WHERE grade > 0) > 0 THEN round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE grade > 0 AND rank <= 5), 0), 6) END AS mrr_5,
  round(coalesce(sum(grade / log2(rank + 1)) FILTER (WHERE rank <= 20 AND grade IS NOT NULL), 0) / any_value(b.ideal), 6) AS ndcg_20,
  round(count(*) FILTER (WHERE grade > 0 AND rank <= 20) / nullif(count(*) FILTER (WHERE grade > 0), 0)::DOUBLE, 6) AS recall_20,
  CASE WHEN count(*) FILTER (WHERE grade > 0) > 0 THEN round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE grade > 0 AND rank <= 20), 0), 6) END AS mrr_20
FROM j LEFT JOIN ideal5 a USING (query_id) LEFT JOIN ideal20 b USING (query_id) GROUP BY query_id""")
def ndcg_linear(spark, sf):
    """Third convention: linear gain at several cut-offs."""
    found = irmetrics.linear(*_judged(spark, sf), cutoffs=(5, 20))
    return _six(found, *found.columns[1:])


@query(f"""{JUDGED} m AS (SELECT query_id, CASE WHEN count(*) FILTER (WHERE grade >= 2) > 0 THEN coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE grade >= 2 AND rank <= 3), 0) END AS mrr,
  count(*) FILTER (WHERE grade >= 2 AND rank <= 3) / nullif(count(*) FILTER (WHERE grade >= 2), 0)::DOUBLE AS recall FROM j GROUP BY query_id)
SELECT q_label, count(*)::BIGINT AS cases, round(avg(mrr), 6) AS mean_mrr, count(mrr)::BIGINT AS defined_mrr, round(avg(recall), 6) AS mean_recall, count(recall)::BIGINT AS defined_recall
FROM m JOIN q USING (query_id) GROUP BY q_label""")
def metrics_by_group(spark, sf):
    """Macro means over defined cases, by the query's label."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    found = irmetrics.judged(*_judged(spark, sf), k=3).join(v, "query_id")
    return irmetrics.macro(found, ["mrr", "recall"], ["q_label"])


# Supports: documents of the next labels, by label as aspect, with weights.
@query(f"""WITH {COSINE}, ranked AS (SELECT query_id, vec_id AS doc_id, rank FROM ({COSINE_RANKED}) WHERE rank <= 20),
sup AS (SELECT q.query_id, v.label AS aspect_id, (1 + v.label % 3)::DOUBLE AS weight, v.vec_id AS doc_id FROM q JOIN v ON v.vec_id <> q.query_id AND v.vec_id % 3 = 0 AND v.label IN (q.q_label, (q.q_label + 1) % 10, (q.q_label + 2) % 10)),
w AS (SELECT query_id, aspect_id, weight / sum(weight) OVER (PARTITION BY query_id) AS share FROM (SELECT DISTINCT query_id, aspect_id, weight FROM sup)),
rows_ AS (SELECT sup.query_id, sup.aspect_id, doc_id, share FROM sup JOIN w USING (query_id, aspect_id)),
h AS (SELECT query_id, aspect_id, share, rank, share * pow(0.5::DOUBLE, row_number() OVER (PARTITION BY query_id, aspect_id ORDER BY rank) - 1) AS g FROM rows_ JOIN ranked USING (query_id, doc_id) WHERE rank <= 10),
d AS (SELECT query_id, sum(g / log2(rank + 1)) AS dcg FROM h GROUP BY query_id),
ar AS (SELECT query_id, sum(share) AS r FROM (SELECT DISTINCT query_id, aspect_id, share FROM h) GROUP BY query_id),
b AS (SELECT query_id, g, row_number() OVER (PARTITION BY query_id ORDER BY g DESC) AS i FROM (SELECT query_id, share * pow(0.5::DOUBLE, row_number() OVER (PARTITION BY query_id, aspect_id ORDER BY doc_id) - 1) AS g FROM rows_)),
id AS (SELECT query_id, sum(g / log2(i + 1)) AS ideal FROM b WHERE i <= 10 GROUP BY query_id)
SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS alpha_ndcg, round(coalesce(r, 0), 6) AS aspect_recall FROM id LEFT JOIN d USING (query_id) LEFT JOIN ar USING (query_id)""")
def alpha_ndcg(spark, sf):
    """Diversity: repeated aspects gain less."""
    ranked = _cosine(spark, sf, 20).withColumnRenamed("vec_id", "doc_id")
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    wide = q.withColumn("aspect_id", F.explode(F.array("q_label", (F.col("q_label") + 1) % 10, (F.col("q_label") + 2) % 10)))
    own = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("aspect_id"))
    supports = wide.join(own, "aspect_id").where("doc_id <> query_id").withColumn("weight", (1 + F.col("aspect_id") % 3).cast("double"))
    return _six(irmetrics.aspects(ranked, supports.select("query_id", "aspect_id", "weight", "doc_id"), k=10), "alpha_ndcg", "aspect_recall")


@query(f"""{LEGS}, rel AS (SELECT query_id, doc_id FROM lex WHERE rank <= 5 UNION SELECT query_id, doc_id FROM sem WHERE rank <= 5),
st_ AS (SELECT query_id, method AS stage, doc_id FROM legs UNION ALL SELECT query_id, 'top3', doc_id FROM legs WHERE rank <= 3)
SELECT query_id, stage, round(count(DISTINCT r.doc_id) / any_value(n)::DOUBLE, 6) AS recall
FROM st_ LEFT JOIN rel r USING (query_id, doc_id) JOIN (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id) t USING (query_id) GROUP BY query_id, stage""")
def stage_attribution(spark, sf):
    """Which stage still holds the relevant documents (first five of either leg)."""
    lists = _lists(spark, sf)
    qrels = lists.where("rank <= 5").select("query_id", "doc_id", F.lit(1).alias("grade"))
    stages = lists.select("query_id", F.col("method").alias("stage"), "doc_id")
    stages = stages.unionByName(lists.where("rank <= 3").select("query_id", F.lit("top3").alias("stage"), "doc_id"))
    return _six(irmetrics.stage_attribution(stages, qrels), "recall")


@query(f"""WITH {BM25}, r AS (SELECT query_id, doc_id, rank FROM ({RANKED}) WHERE rank <= 20),
g AS (SELECT query_id, doc_id FROM r JOIN labels USING (doc_id) WHERE quality = 1),
n AS (SELECT g.query_id, count(*) AS total, count(*) FILTER (WHERE rank <= 10) AS ten, count(*) FILTER (WHERE rank <= 5) AS five FROM g JOIN r USING (query_id, doc_id) GROUP BY g.query_id),
t AS (SELECT CASE WHEN ten < total THEN 'missed_ten' END AS a, CASE WHEN five < ten THEN 'lost_at_five' END AS b FROM n),
x AS (SELECT unnest(CASE WHEN a IS NULL AND b IS NULL THEN ['none'] ELSE list_filter([a, b], lambda v: v IS NOT NULL) END) AS tag FROM t)
SELECT tag, count(*)::BIGINT AS n FROM x GROUP BY tag""")
def failure_tags(spark, sf):
    """Overlapping reasons for lost documents, counted."""
    ranked = _bm25(spark, sf, 20).persist()  # twenty rows a query, read by each stage
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    qrels = F.broadcast(ranked).join(good, "doc_id").select("query_id", "doc_id", F.lit(1).alias("grade"))
    cut = lambda k, name: ranked.where(F.col("rank") <= k).select("query_id", F.lit(name).alias("stage"), "doc_id")
    return irmetrics.tag_counts(irmetrics.failure_tags(cut(10, "ten").unionByName(cut(5, "five")), qrels, ["ten", "five"]))


# Spans: two windows of each document that overlap, touch or lie apart, by its id.
SPANS = """spans AS (SELECT doc_id, k AS span, (k * (8 + doc_id % 5))::BIGINT AS start_char, (k * (8 + doc_id % 5) + 8 + doc_id % 3 + k % 3)::BIGINT AS end_char
FROM documents, (SELECT unnest(range(0, 6)) AS k))"""


def _spans(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    rows = docs.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    start = F.col("span") * (8 + F.col("doc_id") % 5)
    return rows.withColumns({"start_char": start, "end_char": start + 8 + F.col("doc_id") % 3 + F.col("span") % 3})


def _merge_sql(apart):
    return f"""WITH {SPANS}, p AS (SELECT *, max(end_char) OVER (PARTITION BY doc_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_char {apart} before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_char, end_char) AS island FROM p)
SELECT doc_id, min(start_char)::BIGINT AS start_char, max(end_char)::BIGINT AS end_char, count(*)::BIGINT AS parts FROM i GROUP BY doc_id, island"""


@query(_merge_sql(">="))
def interval_merge_strict(spark, sf):
    """Packing's rule: spans that touch stay apart."""
    return evidence.merged(_spans(spark, sf), ["doc_id"], touching=False)


@query(_merge_sql(">"))
def interval_merge_touching(spark, sf):
    """Counting's rule: spans that touch are one."""
    return evidence.merged(_spans(spark, sf), ["doc_id"], touching=True)


ANCHORS = "anchors AS (SELECT doc_id, 5::BIGINT AS a, (35 + doc_id % 11)::BIGINT AS b FROM documents)"
COVERED = f"""{SPANS}, {ANCHORS},
cl AS (SELECT s.doc_id, greatest(start_char, a) AS l, least(end_char, b) AS r FROM spans s JOIN anchors USING (doc_id) WHERE start_char < b AND end_char > a AND span <> 2),
pm AS (SELECT *, max(r) OVER (PARTITION BY doc_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cl),
cv AS (SELECT doc_id, sum(greatest(0, r - greatest(l, coalesce(before, l))))::BIGINT AS covered FROM pm GROUP BY doc_id)"""


def _coverage(spark, sf):
    spans = _spans(spark, sf).where("span <> 2")
    anchors = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("anchor_id"), F.lit(5).cast("long").alias("start_char"), (35 + F.col("doc_id") % 11).alias("end_char"))
    return evidence.coverage(anchors, spans, ["doc_id"])


@query(f"WITH {COVERED} SELECT doc_id AS anchor_id, coalesce(covered, 0)::BIGINT AS covered, round(coalesce(covered, 0) / (b - a)::DOUBLE, 6) AS coverage FROM anchors LEFT JOIN cv USING (doc_id)")
def span_coverage(spark, sf):
    """Share of a labelled span that the union of returned spans covers."""
    return _six(_coverage(spark, sf), "coverage")


@query(f"""WITH {COVERED}, c AS (SELECT doc_id AS span_id, coalesce(covered, 0) / (b - a)::DOUBLE AS coverage FROM anchors LEFT JOIN cv USING (doc_id)),
req AS (SELECT doc_id // 6 AS case_id, (doc_id // 3) % 2 AS facet_id, doc_id % 2 AS alternative, doc_id AS span_id, (1 + (doc_id // 3) % 2)::DOUBLE AS weight, (doc_id // 3) % 2 = 0 AS critical FROM documents),
alt AS (SELECT case_id, facet_id, weight, critical, alternative, bool_and(coverage >= 0.9) AS ok FROM (SELECT req.*, CASE WHEN coverage > 0.9 THEN 1.0 ELSE coverage END AS coverage FROM req LEFT JOIN c USING (span_id)) GROUP BY ALL),
f AS (SELECT case_id, facet_id, weight, critical, bool_or(ok) AS ok FROM alt GROUP BY ALL)
SELECT case_id, round(sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight), 6) AS coverage, bool_and(ok) FILTER (WHERE critical) AS critical_covered FROM f GROUP BY case_id""")
def facet_score(spark, sf):
    """Alternatives (or) of spans (and), weighted by facet."""
    found = _coverage(spark, sf).withColumn("coverage", F.when(F.col("coverage") > 0.9, 1.0).otherwise(F.col("coverage")))
    facet = F.floor(F.col("doc_id") / 3) % 2
    required = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 6).alias("case_id"), facet.alias("facet_id"), (F.col("doc_id") % 2).alias("alternative"),
        F.col("doc_id").alias("span_id"), (1 + facet).cast("double").alias("weight"), (facet == 0).alias("critical"),
    )
    return _six(evidence.facets(required, found.withColumnRenamed("anchor_id", "span_id")), "coverage")


@query(f"""WITH {SPANS}, e AS (SELECT DISTINCT doc_id, start_char, end_char FROM (SELECT doc_id, start_char - start_char % 16 AS start_char, start_char - start_char % 16 + 16 AS end_char FROM spans))
SELECT doc_id, count(*)::BIGINT AS excerpts, sum(end_char - start_char)::BIGINT AS chars FROM e GROUP BY doc_id""")
def dedup_evidence(spark, sf):
    """Excerpts counted once each."""
    start = F.col("start_char") - F.col("start_char") % 16
    rows = _spans(spark, sf).select("doc_id", start.alias("start_char"), (start + 16).alias("end_char")).dropDuplicates()
    return rows.groupBy("doc_id").agg(F.count("*").alias("excerpts"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))


@query(f"""WITH {SPANS}, o AS (SELECT s.*, text, substr(text, start_char + 1, end_char - start_char) AS cut FROM spans s JOIN documents USING (doc_id))
SELECT doc_id, count(*) FILTER (WHERE end_char <= length(text) AND span <> 3)::BIGINT AS accepted, count(*) FILTER (WHERE NOT (end_char <= length(text) AND span <> 3))::BIGINT AS rejected FROM o GROUP BY doc_id""")
def evidence_acceptance(spark, sf):
    """Only verbatim slices of the right revision count; span 3 has a wrong one."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source"), F.lit("r1").alias("document_revision"), F.col("text").alias("body"))
    rows = _spans(spark, sf).withColumnRenamed("doc_id", "source").join(docs.select("source", "body"), "source")
    cut = F.substring(F.col("body"), F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int"))
    seen = rows.select("source", F.when(F.col("span") == 3, "r0").otherwise("r1").alias("document_revision"), cut.alias("content"), "start_char", "end_char")
    out = evidence.accepted(seen, docs)
    return out.groupBy(F.col("source").alias("doc_id")).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query(f"""WITH {SPANS}, {ANCHORS}, d AS (SELECT doc_id, unnest(range(1, 7)) AS depth FROM documents),
c AS (SELECT d.doc_id, depth, greatest(start_char, a) AS l, least(end_char, b) AS r, b - a AS size FROM d JOIN spans USING (doc_id) JOIN anchors USING (doc_id) WHERE span < depth AND start_char < b AND end_char > a),
p AS (SELECT *, max(r) OVER (PARTITION BY doc_id, depth ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
f AS (SELECT doc_id, depth FROM p GROUP BY doc_id, depth HAVING sum(greatest(0, r - greatest(l, coalesce(before, l)))) = any_value(size))
SELECT a.doc_id AS query_id, min(depth)::INT AS rank FROM anchors a LEFT JOIN f USING (doc_id) GROUP BY a.doc_id""")
def first_full_rank(spark, sf):
    """First rank at which the hits so far cover the labelled span whole; null if none."""
    hits = _spans(spark, sf).select(F.col("doc_id").alias("query_id"), "doc_id", (F.col("span") + 1).cast("int").alias("rank"), "start_char", "end_char")
    anchors = table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), "doc_id", F.lit(0).alias("anchor_id"), F.lit(5).cast("long").alias("start_char"), (35 + F.col("doc_id") % 11).alias("end_char")
    )
    return evidence.first_full_rank(hits, anchors, ["doc_id"])


@query(f"""WITH {SPANS}, p AS (SELECT *, max(end_char) OVER (PARTITION BY doc_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
u AS (SELECT doc_id, sum(greatest(0, end_char - greatest(start_char, coalesce(before, start_char)))) AS union_chars FROM p GROUP BY doc_id),
w AS (SELECT doc_id, sum(end_char - start_char) AS chars, sum(CASE WHEN span < 3 THEN end_char - start_char ELSE 0 END) AS kept FROM spans GROUP BY doc_id)
SELECT doc_id, chars::BIGINT AS chars, union_chars::BIGINT AS union_chars, round(1 - union_chars / chars::DOUBLE, 6) AS duplicate_fraction, round(kept / chars::DOUBLE, 6) AS retained FROM w JOIN u USING (doc_id)""")
def context_report(spark, sf):
    """How much evidence overlaps, and how much of it packing kept."""
    return _six(evidence.context_report(_spans(spark, sf), F.col("span") < 3, ["doc_id"]), "duplicate_fraction", "retained")


@query("""
WITH v AS (SELECT doc_id, source AS family_id, CASE WHEN quality IS NOT NULL THEN quality + toxic / 2.0::DOUBLE END AS v FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT family_id, avg(v) AS m FROM v GROUP BY family_id)
SELECT (SELECT count(*) FROM v)::BIGINT AS cases, (SELECT count(v) FROM v)::BIGINT AS defined, round((SELECT avg(v) FROM v), 6) AS case_mean, count(m)::BIGINT AS families, round(avg(m), 6) AS family_mean FROM f
""")
def pilot_summary(spark, sf):
    """A mean over cases beside a mean over families of cases."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    values = rows.select(F.col("source").alias("family_id"), (F.col("quality") + F.col("toxic") / 2.0).alias("v"))
    return _six(runs.case_and_family_means(values, "v"), "case_mean", "family_mean")


@query("""
WITH f AS (SELECT user_id AS case_id, event_type AS method, 'f' || (event_id % 4) AS facet, max(value) > 30 AS satisfied FROM events GROUP BY ALL),
r AS (SELECT case_id, method, CASE WHEN (case_id + length(method)) % 17 = 0 THEN 'error' ELSE 'ok' END AS status, round(count(*) FILTER (WHERE satisfied) / count(*)::DOUBLE, 6) AS coverage,
 coalesce(string_agg(facet, ',' ORDER BY facet) FILTER (WHERE NOT satisfied), '') AS missing_facets FROM f GROUP BY case_id, method)
SELECT * FROM r WHERE status <> 'ok' OR coverage < 1
""")
def pilot_shortfalls(spark, sf):
    """Cases of a pilot that failed or lack evidence, with the facets that are missing."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("method"), F.concat(F.lit("f"), F.col("event_id") % 4).alias("facet"), "value")
    facets = e.groupBy("case_id", "method", "facet").agg((F.max("value") > 30).alias("satisfied"))
    status = F.when((F.col("case_id") + F.length("method")) % 17 == 0, "error").otherwise("ok")
    rows = facets.groupBy("case_id", "method").agg(F.round(F.count_if("satisfied") / F.count("*"), 6).alias("coverage")).withColumn("status", status)
    return runs.shortfalls(rows, facets).withColumn("missing_facets", F.concat_ws(",", "missing_facets"))


@query("SELECT user_id AS case_id FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id HAVING count(DISTINCT CASE WHEN value > 60 THEN event_type END) < 2")
def undefined_cases(spark, sf):
    """Cases that a comparison leaves out, as an arm has no value."""
    e = table(spark, sf, "events").where("event_type IN ('view', 'click')")
    values = e.groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("arm")).agg(F.max(F.when(F.col("value") > 60, F.col("value"))).alias("v"))
    return runs.comparable(values, "v", 2)[1]


@query("""
WITH b AS (SELECT doc_id, md5(text) AS r FROM documents WHERE doc_id % 10 <> 1), a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS r FROM documents WHERE doc_id % 10 <> 2)
SELECT (count(*) FILTER (WHERE a.r = b.r))::BIGINT AS fresh, (count(*) FILTER (WHERE a.r <> b.r))::BIGINT AS stale, (count(*) FILTER (WHERE b.r IS NULL))::BIGINT AS absent FROM a LEFT JOIN b USING (doc_id)
""")
def snapshot_freshness(spark, sf):
    """Live documents that a snapshot has as they are, has outdated, or lacks."""
    from tarn.plans.knowledge import _after, _before

    return runs.freshness(_after(spark, sf), _before(spark, sf), "doc_id", "revision")


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN trim('{"k": ' || doc_id || '}') END AS block FROM documents
""")
def json_block(spark, sf):
    """The one fenced JSON block of a text, or null: none or two are not repaired."""
    from tarn.operators.context import single_json_block

    one = F.concat(F.lit("```json\n{\"k\": "), F.col("doc_id"), F.lit("}\n```\n"))
    kind = F.col("doc_id") % 3
    text = F.when(kind == 1, F.concat(F.lit("see\n"), one)).when(kind == 2, F.concat(one, one)).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", single_json_block(text).alias("block"))


# Facets with two alternatives each; the first is the lesser number.
@query("SELECT DISTINCT doc_id AS case_id, doc_id * 10 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS span_id FROM documents UNION SELECT doc_id, doc_id * 10 + 3 FROM documents")
def gold_context(spark, sf):
    """Spans of each facet's first alternative."""
    d = F.col("doc_id")
    one = lambda facet, alternative, span: table(spark, sf, "documents").select(d.alias("case_id"), F.lit(facet).alias("facet_id"), alternative.alias("alternative"), (d * 10 + span).alias("span_id"))
    rows = one(1, F.when(d % 2 == 0, 0).otherwise(5), 1).unionByName(one(1, F.lit(3), 2)).unionByName(one(2, F.lit(1), 3))
    return evidence.gold_context(rows)


@query("""
WITH g AS (SELECT doc_id, unnest([0, 1, 2]) AS k FROM documents) SELECT doc_id AS case_id, round(count(*) FILTER (WHERE (doc_id + k) % 3 = 0 OR (k = 1 AND doc_id % 2 = 0)) / 3.0::DOUBLE, 6) AS recall FROM g GROUP BY doc_id
""")
def source_group_recall(spark, sf):
    """Share of source groups of which any source was found."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    groups = d.select("case_id", k.alias("group_id")).withColumn("source", F.concat(F.lit("s"), "group_id"))
    groups = groups.unionByName(groups.where("group_id = 1").withColumn("source", F.lit("other")))
    hits = groups.where("(source <> 'other' AND (case_id + group_id) % 3 = 0) OR (source = 'other' AND case_id % 2 = 0)").select("case_id", "source")
    return _six(evidence.group_recall(hits, groups), "recall")


@query(f"""WITH {SPANS}, p AS (SELECT *, max(end_char) OVER (PARTITION BY doc_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_char > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_char, end_char) AS island FROM p),
m AS (SELECT doc_id, min(start_char) AS s, max(end_char) AS e FROM i GROUP BY doc_id, island)
SELECT doc_id, count(*)::BIGINT AS spans, sum(len(regexp_extract_all(substr(text, s + 1, e - s), '[^ ]+')))::BIGINT AS tokens FROM m JOIN documents USING (doc_id) GROUP BY doc_id""")
def unique_evidence_tokens(spark, sf):
    """Tokens of what spans cover, each place once."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return evidence.unique_tokens(_spans(spark, sf), docs, ["doc_id"], lambda t: F.size(F.regexp_extract_all(t, F.lit("([^ ]+)"), F.lit(1))).cast("long"))


@query(f"""WITH {COSINE}, a AS (SELECT * FROM ({COSINE_RANKED}) WHERE rank <= 10), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM sc WHERE vec_id % 3 <> 0) WHERE rank <= 10),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS r, b.rank AS r2, a.score AS s, b.score AS s2 FROM a FULL JOIN b ON a.query_id = b.query_id AND a.vec_id = b.vec_id)
SELECT query_id, round(count(*) FILTER (WHERE r IS NOT NULL AND r2 IS NOT NULL) / count(r)::DOUBLE, 6) AS recall, bool_and(coalesce(r = r2, false)) AS same_order, round(max(abs(s - s2)), 6) AS max_delta FROM j GROUP BY query_id""")
def neighbour_recall(spark, sf):
    """A list that misses a third of the vectors against the whole one."""
    return _six(irmetrics.neighbour_recall(_cosine(spark, sf, 10), _cosine(spark, sf, 10, F.col("vec_id") % 3 != 0), 10), "recall", "max_delta")


# The stages of a hybrid search with a reranked head: legs, union, fused lists, and what is shown.
STAGES_SQL = f"""{LEGS}, fu AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM legs GROUP BY query_id, doc_id)),
qs AS (SELECT query_id, list(term) AS asked FROM qt GROUP BY query_id),
rr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)::INT AS rank FROM (SELECT query_id, doc_id, coalesce(len(list_intersect(asked, terms)) / len(asked)::DOUBLE, 0) AS s FROM fu LEFT JOIN qs USING (query_id) JOIN tok USING (doc_id) WHERE rank <= 20)),
stg AS (SELECT query_id, method AS stage, doc_id FROM legs UNION SELECT query_id, 'union', doc_id FROM legs UNION SELECT query_id, 'pool', doc_id FROM fu WHERE rank <= 20 UNION SELECT query_id, 'top', doc_id FROM fu WHERE rank <= 10 UNION SELECT query_id, 'shown', doc_id FROM rr WHERE rank <= 10),
rel AS (SELECT l.query_id, d.doc_id, d.lang AS aspect_id, (1 + length(d.lang))::DOUBLE AS weight FROM (SELECT DISTINCT query_id FROM legs) l JOIN documents d ON d.doc_id % 17 = l.query_id % 17)
"""


def _stages(spark, sf):
    lists = _lists(spark, sf)
    fused = fusion.rrf(lists).drop("votes")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms(F.col("text")).alias("asked"))
    head = F.broadcast(fused.where("rank <= 20")).join(_tokens(spark, sf).select("doc_id", "terms"), "doc_id").join(asked, "query_id")
    shown = fusion.rerank(head, fusion.overlap_score(F.col("asked"), F.col("terms"))).where("rank <= 10")
    one = lambda df, name: df.select("query_id", F.lit(name).alias("stage"), "doc_id")
    stages = lists.select("query_id", F.col("method").alias("stage"), "doc_id").unionByName(one(lists, "union")).unionByName(one(fused.where("rank <= 20"), "pool"))
    stages = stages.unionByName(one(fused.where("rank <= 10"), "top")).unionByName(one(shown, "shown"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("aspect_id"), (F.col("doc_id") % 17).alias("_k"))
    queries = lists.select("query_id").distinct().withColumn("_k", F.col("query_id") % 17)
    supports = queries.join(docs, "_k").select("query_id", "doc_id", "aspect_id", (1.0 + F.length("aspect_id")).alias("weight"))
    return stages, supports


@query(f"""{STAGES_SQL}, a AS (SELECT DISTINCT query_id, aspect_id, weight FROM rel), t AS (SELECT query_id, sum(weight) AS total FROM a GROUP BY query_id),
g AS (SELECT query_id, stage, sum(weight) AS got FROM (SELECT DISTINCT s.query_id, stage, aspect_id, weight FROM stg s JOIN rel USING (query_id, doc_id)) GROUP BY query_id, stage)
SELECT query_id, stage, round(coalesce(got, 0) / total, 6) AS coverage FROM (SELECT DISTINCT query_id, stage FROM stg) LEFT JOIN t USING (query_id) LEFT JOIN g USING (query_id, stage)""")
def stage_aspect_coverage(spark, sf):
    """How much of a query's aspects each stage of a reranked hybrid search still has."""
    return _six(irmetrics.stage_aspects(*_stages(spark, sf)), "coverage")


@query(f"""{STAGES_SQL}, h AS (SELECT rel.query_id, rel.doc_id, bool_or(stage = 'union') AS u, bool_or(stage = 'pool') AS p, bool_or(stage = 'top') AS t, bool_or(stage = 'shown') AS w FROM rel LEFT JOIN stg USING (query_id, doc_id) GROUP BY ALL),
x AS (SELECT query_id, list_filter([CASE WHEN bool_or(coalesce(NOT u, true)) THEN 'missed_union' END, CASE WHEN bool_or(u AND NOT p) THEN 'lost_at_pool' END, CASE WHEN bool_or(p AND NOT t) THEN 'lost_at_top' END, CASE WHEN bool_or(t AND NOT w) THEN 'lost_at_shown' END], lambda v: v IS NOT NULL) AS tags FROM h GROUP BY query_id)
SELECT query_id, array_to_string(CASE WHEN len(tags) = 0 THEN ['none'] ELSE tags END, ',') AS tags FROM x""")
def stage_losses(spark, sf):
    """Which steps of a reranked hybrid search lost relevant documents."""
    stages, supports = _stages(spark, sf)
    qrels = supports.select("query_id", "doc_id", F.lit(1).alias("grade"))
    found = irmetrics.failure_tags(stages.where("stage NOT IN ('bm25', 'semantic')"), qrels, ["union", "pool", "top", "shown"])
    return found.select("query_id", F.concat_ws(",", "tags").alias("tags"))
