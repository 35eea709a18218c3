"""The relational checklist over the star schema: joins, sets, windows, grouping sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.plans.base import query, table


@query("""
SELECT 'inner' AS kind, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'left', count(*) FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'full', count(*) FROM documents FULL JOIN embeddings ON doc_id = vec_id UNION ALL SELECT 'semi', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'anti', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def rel_join_types(spark, sf):
    docs, labels, vectors = (table(spark, sf, t) for t in ("documents", "labels", "embeddings"))
    d, lab = docs.select("doc_id"), labels.select("doc_id")
    kinds = [("inner", d.join(lab, "doc_id")), ("left", d.join(lab, "doc_id", "left")), ("full", d.join(vectors.select("vec_id"), F.col("doc_id") == F.col("vec_id"), "full"))]
    kinds += [("semi", d.join(lab, "doc_id", "left_semi")), ("anti", d.join(lab, "doc_id", "left_anti"))]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in kinds]
    first = out[0]
    for part in out[1:]:
        first = first.unionByName(part)
    return first


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))""")
def rel_grouping_sets(spark, sf):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf, "lineitem").groupingSets([[], [a], [a, b]], a, b)
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(revenue), 2).alias("revenue"))


@query("""
SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT user_id FROM events WHERE event_type = 'click')
UNION ALL SELECT 'intersect', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'click')
UNION ALL SELECT 'except', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'click')
UNION ALL SELECT 'union_all', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' UNION ALL SELECT user_id FROM events WHERE event_type = 'click')
""")
def rel_setops(spark, sf):
    e = table(spark, sf, "events")
    a, b = (e.where(F.col("event_type") == t).select("user_id") for t in ("view", "click"))
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b)), ("union_all", a.union(b))]
    out = None
    for op, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT event_id, row_number() OVER w::INT AS nth, lag(event_id) OVER w AS before, lead(event_type) OVER w AS next_type, round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS earlier,
max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def rel_windows(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select(
        "event_id", F.row_number().over(w).alias("nth"), F.lag("event_id").over(w).alias("before"), F.lead("event_type").over(w).alias("next_type"),
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), 4).alias("earlier"), F.max("value").over(w.rowsBetween(-2, 0)).alias("recent_most"),
    )


@query("""
SELECT n_name, count(DISTINCT o_orderkey)::BIGINT AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name
""")
def rel_star_join(spark, sf):
    """A filter that reaches the scan, and a join of four tables."""
    orders = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    rows = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("n_name").agg(F.count_distinct("o_orderkey").alias("orders"), F.round(revenue, 2).alias("revenue"))


@query("""SELECT a.conv_id, a.turn, count(b.turn)::BIGINT AS earlier_users FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'user' AND b.turn < a.turn GROUP BY a.conv_id, a.turn""")
def rel_theta_join(spark, sf):
    """An inequality beside an equality."""
    c = table(spark, sf, "conversations")
    users = c.where("role = 'user'").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    rows = c.select("conv_id", "turn").join(users, (F.col("conv_id") == F.col("c")) & (F.col("t") < F.col("turn")), "left")
    return rows.groupBy("conv_id", "turn").agg(F.count("t").alias("earlier_users"))


@query("""SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def rel_topk_per_group(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("""SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT json_extract_string(props, '$.k'))::BIGINT AS kinds, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type""")
def rel_json(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(k).alias("kinds"), F.max(k.cast("long")).alias("most"))
