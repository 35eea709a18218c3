"""Queries over documents, benchmark items and vectors: matching, ranking, fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions.text import terms
from tarn.operators import bm25, exact, fusion, graph, irmetrics, trigrams, vector
from tarn.operators.segments import Segments, counted
from tarn.plans.base import query, scratch, spread, table

TOKENS = r"""
tok AS (SELECT doc_id, source, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS terms FROM documents),
len AS (SELECT doc_id, source, len(terms)::BIGINT AS length FROM tok),
post AS (SELECT term, doc_id, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY ALL),
st AS (SELECT count(*)::BIGINT AS n_docs, sum(length)::BIGINT AS total_terms, avg(length) AS avg_length FROM len),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')) AS term FROM benchmark)
"""

BM25 = rf"""{TOKENS},
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT query_id, p.doc_id, l.source,
       sum(round(1e12 * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
             / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)))::BIGINT)::DOUBLE / 1e12 AS score
       FROM qt JOIN post p USING (term) JOIN df USING (term) JOIN len l USING (doc_id), st
       GROUP BY query_id, p.doc_id, l.source)
"""

RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc"


def _tokens(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return bm25.tokenised(docs, F.col("text")).drop("text")


def _asked(spark, sf):
    return bm25.query_terms(table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), F.col("text"), "query_id")


@query(rf"WITH {TOKENS} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term")
def term_df(spark, sf):
    """Document and collection frequency of every term."""
    found = bm25.postings(_tokens(spark, sf))
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(rf"WITH {TOKENS} SELECT doc_id, array_to_string(terms[1:5], ' ') AS first_terms, len(list_distinct(terms))::BIGINT AS distinct_terms FROM tok")
def tokenize_terms(spark, sf):
    """First terms and number of distinct terms of each document."""
    own = _tokens(spark, sf)
    return own.select("doc_id", F.concat_ws(" ", F.slice("terms", 1, 5)).alias("first_terms"), F.size(F.array_distinct("terms")).cast("long").alias("distinct_terms"))


@query(rf"WITH {TOKENS} SELECT doc_id, length FROM len")
def doc_lengths(spark, sf):
    return _tokens(spark, sf).select("doc_id", "length")


@query(rf"WITH {TOKENS} SELECT n_docs, total_terms, round(avg_length, 6) AS avg_length FROM st")
def corpus_stats(spark, sf):
    return bm25.corpus_stats(_tokens(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


def _six(df, *columns):
    """Scores as they are shown; ranks are by the whole ones."""
    return df.withColumns({c: F.round(c, 6) for c in columns or ("score",)})


def _bm25(spark, sf, k, keep=None):
    return bm25.best(_tokens(spark, sf), _asked(spark, sf), k, keep=keep)


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({RANKED}) WHERE rank <= 10")
def bm25_topk(spark, sf):
    """Ten best documents of every benchmark item, in one plan."""
    return _six(_bm25(spark, sf, 10))


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE source = 'src3') WHERE rank <= 5")
def bm25_source_filter(spark, sf):
    """A source filter before the ranking; statistics stay global."""
    return _six(_bm25(spark, sf, 5, F.col("source") == "src3"))


def count_substring(x: str) -> str:
    return f"(length(text) - length(replace(text, '{x}', ''))) // {len(x)}"


@query(f"SELECT doc_id, ({count_substring('the ')})::BIGINT AS n FROM documents WHERE {count_substring('the ')} > 0")
def exact_literal_count(spark, sf):
    n = exact.literal_count(F.col("text"), "the ").cast("long")
    return table(spark, sf, "documents").select("doc_id", n.alias("n")).where("n > 0")


@query("""
WITH p AS (SELECT doc_id, string_split(text, 'and ') AS parts FROM documents),
u AS (SELECT doc_id, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS ordinal FROM p),
s AS (SELECT doc_id, n, ordinal, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY ordinal) + ordinal * 4 AS s FROM u)
SELECT doc_id, ordinal::INT AS ordinal, s::BIGINT AS start_char, (s + 4)::BIGINT AS end_char FROM s WHERE ordinal < n - 1
""")
def exact_literal_offsets(spark, sf):
    """Every place of a literal, in code points."""
    return exact.literal_matches(table(spark, sf, "documents"), "and ")


@query("SELECT doc_id, ((length(text) - length(replace(lower(text), 'der ', ''))) // 4)::BIGINT AS n FROM documents WHERE contains(lower(text), 'der ')")
def exact_ignore_case(spark, sf):
    n = exact.literal_count(F.col("text"), "DER ", ignore_case=True).cast("long")
    return table(spark, sf, "documents").select("doc_id", n.alias("n")).where("n > 0")


@query(r"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{3,4}|[a-z]+@[a-z]+\.[a-z]+')")
def exact_regex_docs(spark, sf):
    return exact.pattern_documents(table(spark, sf, "documents"), r"[0-9]{3}-[0-9]{3,4}|[a-z]+@[a-z]+\.[a-z]+").select("doc_id", "source")


@query(r"""
SELECT doc_id, (generate_subscripts(m, 1) - 1)::INT AS ordinal, unnest(m) AS found
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m FROM documents)
""")
def exact_regex_offsets(spark, sf):
    """Every match of a pattern, with its text cut out by its offsets."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    spans = exact.pattern_matches(docs, r"[0-9]+", keep=["text"])
    cut = F.substring(F.col("text"), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    return spans.select("doc_id", "ordinal", cut.alias("found"))


@query("SELECT doc_id, source FROM documents WHERE contains(source, 'c1')")
def match_source(spark, sf):
    return exact.source_matches(table(spark, sf, "documents"), "c1").select("doc_id", "source")


@query("""
WITH p AS (SELECT doc_id, source, string_split(text, 'with ') AS parts FROM documents),
u AS (SELECT doc_id, source, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS ordinal FROM p),
s AS (SELECT doc_id, source, n, ordinal, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY ordinal) + ordinal * 5 AS s FROM u)
SELECT source || '/' || doc_id AS source, doc_id, s::BIGINT AS start_char FROM s WHERE ordinal < n - 1 ORDER BY 1, 3 LIMIT 20
""")
def exact_first_hits(spark, sf):
    """The first twenty matches of all, by source and place; a document may have several."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.concat_ws("/", "source", "doc_id").alias("source"))
    hits = exact.literal_matches(docs, "with ", keep=["source"])
    return exact.first_matches(hits, 20).select("source", "doc_id", "start_char")


#: Patterns of the queries below: a literal within a gap, a branch, a repeat, one that asks for no trigram.
PATTERNS = [r"resi[a-z]*er", r"(?:ngwh|ändch)[a-zä]+ ", r"(?:tion){2,}", r"\b[A-Z][0-9]{2}"]


def _found(sql: str) -> str:
    return " UNION ALL ".join(sql.format(n=n, p=p) for n, p in enumerate(PATTERNS))


@query(_found("SELECT {n}::INT AS pattern, doc_id, len(regexp_extract_all(text, '{p}'))::BIGINT AS n, instr(text, regexp_extract(text, '{p}'))::BIGINT - 1 AS start_char FROM documents WHERE regexp_matches(text, '{p}')"))
def trigram_matches(spark, sf):
    """Matches of four patterns in each document and the first one's place, found through a trigram index."""
    docs, index = table(spark, sf, "documents"), trigrams.TrigramIndex(spark, scratch(spark))
    index.add(docs)
    parts = []
    for n, pattern in enumerate(PATTERNS):
        hits = index.matches(docs, pattern).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start_char").alias("start_char"))
        parts.append(hits.select(F.lit(n).alias("pattern"), "doc_id", "n", "start_char"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _holds(*words: str) -> str:
    return " AND ".join(f"contains(lower(text), '{w[i:i + 3]}')" for w in words for i in range(len(w) - 2))


@query(f"""
WITH t AS (SELECT {_holds("resi")} AS a, ({_holds("ngwh")}) OR ({_holds("ändch")}) AS b, {_holds("tion")} AS c,
{", ".join(f"regexp_matches(text, '{p}') AS m{n}" for n, p in enumerate(PATTERNS))} FROM documents)
SELECT 0::INT AS pattern, count(*) FILTER (WHERE a) AS opened, count(*) FILTER (WHERE m0) AS matching FROM t
UNION ALL SELECT 1, count(*) FILTER (WHERE b), count(*) FILTER (WHERE m1) FROM t
UNION ALL SELECT 2, count(*) FILTER (WHERE c), count(*) FILTER (WHERE m2) FROM t
UNION ALL SELECT 3, count(*), count(*) FILTER (WHERE m3) FROM t
""")
def trigram_opened(spark, sf):
    """How many documents the index lets each pattern open, and how many match."""
    docs, index = table(spark, sf, "documents"), trigrams.TrigramIndex(spark, scratch(spark))
    index.add(docs)
    parts = []
    for n, pattern in enumerate(PATTERNS):
        opened = index.narrowed(docs, pattern).agg(F.count("*").alias("opened"))
        parts.append(opened.crossJoin(index.documents(docs, pattern).agg(F.count("*").alias("matching"))).select(F.lit(n).alias("pattern"), "*"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


COSINE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
q AS (SELECT vec_id AS query_id, e AS qe, label AS q_label FROM v WHERE vec_id % 20 = 0),
sc AS (SELECT query_id, q_label, vec_id, label, round(greatest(-1, least(1, list_cosine_similarity(e, qe))), 12) AS score FROM v, q WHERE vec_id <> query_id)
"""
COSINE_RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM sc"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


def _vector_queries(spark, sf, every=20):
    return _vectors(spark, sf).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _cosine(spark, sf, k, keep=None):
    """Best others of each query vector: one more is asked for, then itself is left out."""
    found = vector.cosine_top_k(_vector_queries(spark, sf), _vectors(spark, sf), k + 1, keep=keep).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@query(f"WITH {COSINE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({COSINE_RANKED}) WHERE rank <= 10")
def cosine_topk(spark, sf):
    return _six(_cosine(spark, sf, 10))


@query(f"WITH {COSINE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM sc WHERE label < 3) WHERE rank <= 5")
def cosine_filtered(spark, sf):
    """A filter on candidates before the ranking."""
    return _six(_cosine(spark, sf, 5, F.col("label") < 3))


@query(f"WITH {COSINE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM sc WHERE label < 6 AND vec_id % 3 = 1) WHERE rank <= 5")
def cosine_conjunction(spark, sf):
    """Several conditions on candidates, all of which hold."""
    return _six(_cosine(spark, sf, 5, (F.col("label") < 6) & (F.col("vec_id") % 3 == 1)))


@query("""
SELECT vec_id, len(embedding)::INT AS dimensions, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS norm,
       CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'shape' END AS problem FROM embeddings
""")
def vector_validate(spark, sf):
    """Every stored vector's size, norm and what is wrong with it."""
    e = F.col("embedding")
    return _vectors(spark, sf).select("vec_id", F.size(e).alias("dimensions"), F.round(vector.norm(e), 4).alias("norm"), vector.validity(e, 64).alias("problem"))


@query()
def ann_recall(spark, sf):
    """Recall of the inverted-list search against the exact one, by query: every id divisible by 20."""
    asked = _vector_queries(spark, sf)
    exact_ = vector.cosine_top_k(asked, _vectors(spark, sf), 10)
    near = vector.partitioned_top_k(asked, _vectors(spark, sf), 10)
    return irmetrics.neighbour_recall(exact_, near, 10)


def _legs_sql(depth):
    return f"""WITH {BM25}, lex AS (SELECT query_id, doc_id, rank FROM ({RANKED}) WHERE rank <= {depth}),
sem AS (SELECT query_id, doc_id, rank FROM (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(greatest(-1, least(1, list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]))), 12) AS score
    FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b)) WHERE rank <= {depth}),
legs AS (SELECT *, 'bm25' AS method FROM lex UNION ALL SELECT *, 'semantic' AS method FROM sem)
"""


LEGS = _legs_sql(20)


def _legs(spark, sf, k=20):
    """A benchmark item's lexical leg, and the neighbours of the vector of the same number."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"))
    asked = _vectors(spark, sf).join(items, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = vector.cosine_top_k(asked, _vectors(spark, sf), k).withColumnRenamed("vec_id", "doc_id")
    return {"bm25": _bm25(spark, sf, k), "semantic": near}


def _lists(spark, sf, k=20):
    legs = _legs(spark, sf, k)
    one = lambda n: legs[n].select("query_id", F.lit(n).alias("method"), "doc_id", "rank")
    return one("bm25").unionByName(one("semantic")).persist()  # 2 k rows a query, read by each stage


FUSED = "SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM legs GROUP BY query_id, doc_id"


@query(f"{LEGS} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM ({FUSED})")
def rrf_fusion(spark, sf):
    """Both legs fused by reciprocal ranks, in full."""
    return _six(fusion.rrf(_lists(spark, sf)).drop("votes"))


@query(f"{LEGS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM ({FUSED})) WHERE rank <= 10")
def hybrid_topk(spark, sf):
    return _six(fusion.hybrid(_legs(spark, sf), candidates=20, top_k=10).drop("votes"))


@query(f"""{LEGS}, arms AS (SELECT unnest([5, 10, 20])::INT AS depth),
f AS (SELECT depth, query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM legs, arms WHERE rank <= depth GROUP BY ALL)
SELECT depth, query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY depth, query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f) WHERE rank <= 20""")
def depth_arms(spark, sf):
    """The same frozen legs fused at three depths."""
    return _six(fusion.depth_arms(_lists(spark, sf), [5, 10, 20]))


OVERLAP = rf"""{LEGS},
qs AS (SELECT query_id, list(term) AS asked FROM qt GROUP BY query_id),
r AS (SELECT l.query_id, l.doc_id, l.rank AS input_rank, len(list_intersect(asked, terms)) / len(asked)::DOUBLE AS score
      FROM lex l JOIN qs USING (query_id) JOIN tok USING (doc_id))
"""


def _reranked(spark, sf, policy="identity"):
    words = _tokens(spark, sf).select("doc_id", "terms")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms(F.col("text")).alias("asked"))
    hits = F.broadcast(_bm25(spark, sf, 20)).join(words, "doc_id").join(asked, "query_id")  # twenty rows a query
    out = fusion.rerank(hits, fusion.overlap_score(F.col("asked"), F.col("terms")), tie_policy=policy)
    return _six(out.select("query_id", "doc_id", "input_rank", "score", "rank", "movement"))


@query(f"{OVERLAP} SELECT query_id, doc_id, input_rank, round(score, 6) AS score, rank, input_rank - rank AS movement FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM r)")
def rerank_overlap(spark, sf):
    """The lexical leg reranked by the share of query terms; ties by identity."""
    return _reranked(spark, sf)


@query(f"{OVERLAP} SELECT query_id, doc_id, input_rank, round(score, 6) AS score, rank, input_rank - rank AS movement FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, input_rank)::INT AS rank FROM r)")
def rerank_input_ties(spark, sf):
    """The same with ties in the order of the input."""
    return _reranked(spark, sf, "input_rank")


@query(f"""WITH {BM25}, h AS (SELECT query_id, doc_id, source, rank FROM ({RANKED}) WHERE rank <= 500),
f AS (SELECT query_id, source, min(rank) AS hit_rank FROM h GROUP BY query_id, source)
SELECT query_id, source, hit_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank)::INT AS rank FROM f) WHERE rank <= 100""")
def source_collapse(spark, sf):
    """First hit of each source among five hundred, the first hundred of a query."""
    sources = table(spark, sf, "documents").select("doc_id", "source")
    hits = F.broadcast(_bm25(spark, sf, 500)).join(sources, "doc_id")
    return fusion.first_per_source(hits, limit=100).select("query_id", "source", "hit_rank", "rank")


@query(f"""{_legs_sql(500)}, fu AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM ({FUSED})),
qs AS (SELECT query_id, list(term) AS asked FROM qt GROUP BY query_id),
hd AS (SELECT query_id, doc_id, coalesce(len(list_intersect(asked, terms)) / len(asked)::DOUBLE, 0) AS score FROM fu LEFT JOIN qs USING (query_id) JOIN tok USING (doc_id) WHERE rank <= 20)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM hd
UNION ALL SELECT query_id, doc_id, rank FROM fu WHERE rank > 20 AND rank <= 100""")
def rerank_splice(spark, sf):
    """Legs of five hundred fused; the first twenty reranked, then the fused order up to a hundred."""
    fused = fusion.rrf(_lists(spark, sf, 500)).where(F.col("rank") <= 100).drop("votes")
    words = _tokens(spark, sf).select("doc_id", "terms")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms(F.col("text")).alias("asked"))
    head = F.broadcast(fused.where(F.col("rank") <= 20)).join(words, "doc_id").join(asked, "query_id")
    return fusion.splice(fusion.rerank(head, fusion.overlap_score(F.col("asked"), F.col("terms"))), fused, depth=20, limit=100, id_col="doc_id")


# Hits that disagree: the semantic leg gives some documents another source.
@query(f"""{LEGS}, h AS (SELECT l.doc_id, CASE WHEN l.method = 'semantic' AND l.doc_id % 3 = 0 THEN source || '!' WHEN l.doc_id % 5 = 0 THEN NULL ELSE source END AS source FROM legs l JOIN documents USING (doc_id))
SELECT doc_id, count(DISTINCT source)::BIGINT AS source FROM h GROUP BY doc_id HAVING count(DISTINCT source) > 1""")
def rrf_conflicts(spark, sf):
    """Documents that two legs know under different sources; unknown ones don't count."""
    hits = F.broadcast(_lists(spark, sf)).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    d = F.col("doc_id")
    source = F.when((F.col("method") == "semantic") & (d % 3 == 0), F.concat("source", F.lit("!"))).when(d % 5 == 0, F.lit(None)).otherwise(F.col("source"))
    return fusion.conflicts(hits.withColumn("source", source), ["doc_id"], ["source"])


@query(f"""{LEGS} SELECT query_id, doc_id, max(CASE WHEN method = 'bm25' THEN rank END) AS before, max(CASE WHEN method = 'semantic' THEN rank END) AS after,
max(CASE WHEN method = 'bm25' THEN rank END) - max(CASE WHEN method = 'semantic' THEN rank END) AS gained FROM legs GROUP BY query_id, doc_id""")
def rank_movement(spark, sf):
    """Where a hit of either leg stands in the other."""
    legs = _legs(spark, sf)
    return irmetrics.movement(legs["bm25"], legs["semantic"])


def _near(spark, sf, m, ef):
    """Ten best others of each query vector by graphs, and what each query was compared with."""
    graphs = graph.build(_vectors(spark, sf), graph.GraphConfig(m=m))
    found = graph.top_k(_vector_queries(spark, sf), graphs, 11, ef).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 10)


@query()
def graph_topk(spark, sf):
    """Ten near vectors of every id divisible by 20 through neighbour graphs, with the number of vectors scored."""
    return _six(_near(spark, sf, 8, 16))


@query(f"WITH {COSINE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({COSINE_RANKED}) WHERE rank <= 10")
def graph_whole_beam(spark, sf):
    """A beam as wide as the table: graphs reach every vector, so the hits are those of the exact search."""
    return _six(_near(spark, sf, 16, 1 << 30)).drop("n_scored")


@query()
def graph_recall(spark, sf):
    """Recall@10 against exact search, and the share of rows scored, of two widths of graph and beam."""
    exact_hits = _cosine(spark, sf, 10).select("query_id", "vec_id", F.lit(1).alias("right"))
    total = _vectors(spark, sf).agg(F.count("*").alias("total"))
    arms = []
    for m, ef in ((8, 16), (16, 64)):
        hits = _near(spark, sf, m, ef).join(exact_hits, ["query_id", "vec_id"], "left")
        by_query = hits.groupBy("query_id").agg(F.count("right").alias("right"), F.max("n_scored").alias("n_scored"))
        arm = by_query.agg(F.count("*").alias("n_queries"), F.avg(F.col("right") / 10).alias("recall"), F.avg("n_scored").alias("scored")).crossJoin(F.broadcast(total))
        arms.append(arm.select(F.lit(m).alias("m"), F.lit(ef).alias("ef_search"), "n_queries", F.round("recall", 6).alias("recall"), F.round(F.col("scored") / F.col("total"), 6).alias("share_scored")))
    return arms[0].unionByName(arms[1])


def _counted(spark, sf, keep):
    own = _tokens(spark, sf).where(keep)
    return counted(own.select(F.col("doc_id").alias("chunk_id"), "source", F.lit("1").alias("mark"), "terms", "length"))


def _by_blocks(spark, sf, index, state, k=10):
    """Every benchmark item's ranks from stored blocks; there are 200 items at most."""
    asked = {r["query_id"]: r["terms"] for r in _asked(spark, sf).groupBy("query_id").agg(F.collect_list("term").alias("terms")).collect()}
    return _six(index.top_k(state, asked, k).select("query_id", F.col("chunk_id").cast("long").alias("doc_id"), "score", "rank"))


# documents are ranked by their ids as text where blocks hold them
BY_TEXT = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR)::INT AS rank FROM sc"


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({BY_TEXT}) WHERE rank <= 10")
def bm25_blocks(spark, sf):
    """Ten best documents of every benchmark item from stored blocks with score bounds."""
    index = Segments(spark, scratch(spark))
    return _by_blocks(spark, sf, index, index.update(None, _counted(spark, sf, F.lit(True))))


@query(f"WITH {BM25.replace('FROM documents)', 'FROM documents WHERE doc_id % 10 <> 5)')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({BY_TEXT}) WHERE rank <= 10")
def segments_edited(spark, sf):
    """Ranks after additions, removals, a return and a merge are those of an index of what is left."""
    index, d = Segments(spark, scratch(spark), fan=3), F.col("doc_id") % 10
    ids = lambda keep: table(spark, sf, "documents").where(keep).select(F.col("doc_id").alias("chunk_id"))
    state = index.update(None, _counted(spark, sf, d < 5))
    state = index.update(state, _counted(spark, sf, d >= 7), ids(d == 2))
    state = index.update(state, _counted(spark, sf, d.isin(5, 6)), ids(d == 8))
    state = index.update(state, _counted(spark, sf, d.isin(2, 8)), ids(d == 5))
    return _by_blocks(spark, sf, index, state)
