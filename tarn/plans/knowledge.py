"""Queries of the corpus as a store: changes, conflicts, chunks, context, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import chunking, context, lifecycle
from tarn.plans.base import query, spread, table
from tarn.plans.retrieval import BM25, RANKED, _bm25

# Before and after: some documents are new, some gone, some edited.
BEFORE = "b AS (SELECT doc_id, md5(text) AS r FROM documents WHERE doc_id % 10 <> 1)"
AFTER = "a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS r FROM documents WHERE doc_id % 10 <> 2)"


def _before(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 10 <> 1").select("doc_id", F.md5(F.col("text").cast("binary")).alias("revision"))


def _after(spark, sf):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").where("doc_id % 10 <> 2").select("doc_id", F.md5(text.cast("binary")).alias("revision"))


@query(f"""WITH {BEFORE}, {AFTER} SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.r = b.r THEN 'unchanged' ELSE 'modified' END AS change
FROM b FULL JOIN a ON a.doc_id = b.doc_id""")
def corpus_diff(spark, sf):
    return lifecycle.changes(_before(spark, sf), _after(spark, sf), "doc_id", "revision")


@query(f"WITH {BEFORE}, {AFTER} SELECT DISTINCT r AS revision FROM a WHERE r NOT IN (SELECT r FROM b)")
def missing_embeddings(spark, sf):
    """Distinct texts that the cache has no vector for."""
    return lifecycle.missing_embeddings(_after(spark, sf), _before(spark, sf), "revision").select("revision")


@query(f"WITH {BEFORE}, {AFTER} SELECT doc_id, count(DISTINCT r)::BIGINT AS revisions FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id HAVING count(DISTINCT r) > 1")
def revision_conflicts(spark, sf):
    both = _before(spark, sf).unionByName(_after(spark, sf)).withColumnRenamed("revision", "document_revision")
    return lifecycle.revision_conflicts(both)


@query("SELECT md5(text) AS revision, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_docs(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("revision"))
    return rows.groupBy("revision").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 9 <> 0), s AS (SELECT vec_id, CASE WHEN vec_id % 8 = 0 THEN list_transform(embedding, lambda x: x + 0.5::FLOAT) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 11 <> 0)
SELECT coalesce(e.vec_id, s.vec_id) AS vec_id, CASE WHEN s.vec_id IS NULL THEN 'missing' WHEN e.vec_id IS NULL THEN 'foreign' ELSE 'different' END AS problem
FROM e FULL JOIN s ON e.vec_id = s.vec_id WHERE s.vec_id IS NULL OR e.vec_id IS NULL OR e.vec_id % 8 = 0
""")
def snapshot_verify(spark, sf):
    """Stored vectors against those expected."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    moved = F.when(F.col("vec_id") % 8 == 0, F.transform("embedding", lambda x: x + 0.5)).otherwise(F.col("embedding"))
    return lifecycle.verify_vectors(v.where("vec_id % 11 <> 0").withColumn("embedding", moved), v.where("vec_id % 9 <> 0"), "vec_id")


def _notes(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"))
    body = F.concat(F.lit("## "), F.col("source"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n### part\n\n")))
    return docs.select(F.concat(F.col("doc_id"), F.lit(".md")).alias("source"), F.col("lang").alias("title"), body.alias("content"))


@query()
def chunk_markdown(spark, sf):
    """Sections and packed chunks of every document as a note."""
    found = chunking.chunk_notes(_notes(spark, sf), size=512, overlap=64)
    return found.select("source", "chunk_index", "start_char", "end_char", "occurrence", F.concat_ws(" / ", "heading_path").alias("path"), F.sha2("content", 256).alias("sha256"))


# Notes of a document's lines: a heading of one of three levels before each.
LINES = r"""l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '[\x00-\x09\x0B-\x1F\x7F-\x9F\x{2028}\x{2029}]', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(text, '[\x00-\x09\x0B-\x1F\x7F-\x9F\x{2028}\x{2029}]', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS i FROM documents),
p AS (SELECT *, 1 + (i * 7 + doc_id) % 3 AS level, repeat('#', (1 + (i * 7 + doc_id) % 3)::BIGINT) || ' h' || i || ' ##' || chr(10) || chr(10) || 'x ' || line || chr(10) AS part FROM l),
q AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, max(CASE WHEN level = 1 THEN i END) OVER w AS one, max(CASE WHEN level <= 2 THEN i END) OVER w AS two, max(CASE WHEN level = 2 THEN i END) OVER w AS second FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def _lined(spark, sf):
    """Notes with headings of three levels before their lines."""
    line = F.transform(F.split(F.regexp_replace("text", "[\\x00-\\x09\\x0B-\\x1F\\x7F-\\x9F\\u2028\\u2029]", " "), "\n"), lambda x: F.trim(x))
    docs = spread(table(spark, sf, "documents").select("doc_id", F.filter(line, lambda x: x != "").alias("lines")))
    part = lambda x, i: F.concat(F.repeat(F.lit("#"), (1 + (i * 7 + F.col("doc_id")) % 3).cast("int")), F.lit(" h"), i, F.lit(" ##\n\nx "), x, F.lit("\n"))
    return docs.where(F.size("lines") > 0).select(F.concat("doc_id", F.lit(".md")).alias("source"), F.lit("t").alias("title"), F.concat_ws("", F.transform("lines", part)).alias("content"))


SECTIONS = f"""WITH {LINES} SELECT doc_id || '.md' AS source, i::INT AS chunk_index, (stop - length(part))::INT AS start_char, stop::INT AS end_char,
concat_ws(' / ', CASE WHEN level > 1 AND one IS NOT NULL THEN 'h' || one END, CASE WHEN level > 2 AND second IS NOT NULL AND (one IS NULL OR second > one) THEN 'h' || second END, 'h' || i) AS path FROM q"""


@query(SECTIONS)
def chunk_sections(spark, sf):
    """Sections of notes with headings of three levels, each with its path."""
    found = chunking.chunk_notes(_lined(spark, sf), size=100_000_000, overlap=0)
    return found.select("source", "chunk_index", "start_char", "end_char", F.concat_ws(" / ", "heading_path").alias("path"))


@query(SECTIONS)
def chunk_lateral(spark, sf):
    """The same sections by SQL text alone, through the table function."""
    chunking.register_chunks(spark, "tarn_chunks")
    return spark.sql(
        "SELECT n.source, c.chunk_index, c.start_char, c.end_char, array_join(c.heading_path, ' / ') AS path "
        "FROM {notes} n, LATERAL tarn_chunks(n.source, n.title, n.content, 100000000, 0) c",
        notes=_lined(spark, sf),
    )


@query("""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z]', '', 'g'), '(.{4})', '\\1 ', 'g') AS t FROM documents), n AS (SELECT doc_id, length(t) AS len, (length(t) + 4) // 5 AS units FROM t),
c AS (SELECT doc_id, len, unnest(range(0, CASE WHEN len <= 50 THEN 1 ELSE (units - 10 + 7) // 8 + 1 END)) AS k FROM n)
SELECT doc_id || '.md' AS source, k::INT AS chunk_index, (40 * k)::INT AS start_char, least(40 * k + 50, len)::INT AS end_char FROM c
""")
def chunk_packed(spark, sf):
    """One long line cut at its blanks and packed, two words of each chunk coming along in the next."""
    words = F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "(.{4})", "$1 ")
    notes = spread(table(spark, sf, "documents").select(F.concat("doc_id", F.lit(".md")).alias("source"), F.lit("t").alias("title"), words.alias("content")))
    return chunking.chunk_notes(notes, size=50, overlap=10).select("source", "chunk_index", "start_char", "end_char")


@query("""
WITH d AS (SELECT doc_id, 4 + length(text) % 40 AS m FROM documents),
l AS (SELECT doc_id, m, unnest(range(0, (m - 2) // 2 + 1)) AS k FROM d), c AS (SELECT doc_id, m, unnest(range(0, m // 2 + 1)) AS k FROM d)
SELECT doc_id || '.list' AS source, (14 * k)::INT AS start_char, least(14 * k + 21, 7 * m)::INT AS end_char FROM l UNION ALL SELECT doc_id || '.code', (8 * k)::INT, least(8 * k + 12, 4 * m + 8) FROM c
""")
def chunk_blocks(spark, sf):
    """Lists cut between items and fenced code between lines, a unit of each chunk coming along in the next."""
    docs = spread(table(spark, sf, "documents").select("doc_id", (4 + F.length("text") % 40).cast("int").alias("m")))
    note = lambda kind, text: docs.select(F.concat("doc_id", F.lit(f".{kind}")).alias("source"), F.lit("t").alias("title"), text.alias("content"), F.lit(kind).alias("kind"))
    items, code = note("list", F.repeat(F.lit("- abcd\n"), F.col("m"))), note("code", F.concat(F.lit("```\n"), F.repeat(F.lit("abc\n"), F.col("m")), F.lit("```\n")))
    made = chunking.chunk_notes(items, size=21, overlap=7).unionByName(chunking.chunk_notes(code, size=12, overlap=4))
    return made.select("source", "start_char", "end_char")


@query("SELECT doc_id || '.md' AS source, 0::BIGINT AS gaps, 0::BIGINT AS wrong FROM documents")
def chunk_lossless(spark, sf):
    """No chunk differs from its slice, and no character is lost."""
    notes = _notes(spark, sf)
    return chunking.lossless(chunking.chunk_notes(notes, size=300, overlap=40), notes)


@query("SELECT doc_id, 0::INT AS chunk_index, 0::INT AS start_char, length(text)::INT AS end_char FROM documents")
def chunk_whole(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("lang").alias("title"), F.col("text").alias("content"))
    out = chunking.whole_notes(docs)
    return out.select(F.col("source").cast("long").alias("doc_id"), "chunk_index", "start_char", "end_char")


# Evidence: windows of a hundred characters, sixty apart, over the whole texts of the five best
# documents of each benchmark item. Every fifth window is missing, so there are gaps; every
# seventh is there twice, and every ninth is blank.
WINDOWS = f"""{BM25}, b AS (SELECT query_id, doc_id, rank FROM ({RANKED}) WHERE rank <= 5),
w AS (SELECT query_id, b.doc_id, rank, text, unnest(range(0, (length(text) + 59) // 60)) AS k FROM b JOIN documents USING (doc_id)),
h AS (SELECT query_id, doc_id, k, (60 * k)::INT AS s, least(60 * k + 100, length(text))::INT AS e, CASE WHEN k % 9 = 8 THEN '  ' || chr(10) ELSE substr(text, 60 * k + 1, 100) END AS content, (rank * 1000000 + 2 * k + copy)::INT AS rank, copy
      FROM w, (SELECT unnest([0, 1]) AS copy) WHERE (k + doc_id) % 5 <> 4 AND (copy = 0 OR k % 7 = 3))"""


def _hits(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    best = F.broadcast(_bm25(spark, sf, 5).select("query_id", "doc_id", "rank")).join(docs, "doc_id")  # five rows a query
    n = F.floor((F.length("text") + 59) / 60).cast("long")
    rows = best.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).where((F.col("k") + F.col("doc_id")) % 5 != 4)
    rows = rows.withColumn("copy", F.explode(F.when(F.col("k") % 7 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    start = (60 * F.col("k")).cast("int")
    content = F.when(F.col("k") % 9 == 8, "  \n").otherwise(F.substring(F.col("text"), start + 1, F.lit(100)))
    return rows.select(
        "query_id", F.lit("v1").alias("index_version"), "doc_id", F.lit("r").alias("document_revision"), F.concat_ws("-", "doc_id", "k").alias("chunk_id"),
        start.alias("start_char"), F.least(start + 100, F.length("text")).cast("int").alias("end_char"), content.alias("content"),
        (F.col("rank") * 1_000_000 + 2 * F.col("k") + F.col("copy")).cast("int").alias("rank"),
    )


@query(f"""WITH {WINDOWS} SELECT query_id, rank, CASE WHEN NOT regexp_matches(content, '\\S') THEN 'empty' WHEN copy = 1 THEN 'duplicate' ELSE 'kept' END AS action FROM h""")
def evidence_prepared(spark, sf):
    """Blank and repeated evidence is left out, with the reason."""
    return context.prepared(_hits(spark, sf)).select("query_id", "rank", "action")


@query(f"""WITH {WINDOWS}, g AS (SELECT DISTINCT query_id, doc_id, s, e FROM h WHERE regexp_matches(content, '\\S')),
p AS (SELECT *, max(e) OVER (PARTITION BY query_id, doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, doc_id ORDER BY s) AS island FROM p),
m AS (SELECT query_id, doc_id, min(s) AS s, max(e) AS e, count(*) AS parts FROM i GROUP BY query_id, doc_id, island)
SELECT query_id, m.doc_id, s::INT AS start_char, e::INT AS end_char, sha256(substr(text, s + 1, e - s)) AS sha256, parts::BIGINT AS parts FROM m JOIN documents USING (doc_id)""")
def evidence_merged(spark, sf):
    """Overlapping windows of one document as one span of its text."""
    hits = context.prepared(_hits(spark, sf)).where("action = 'kept'")
    return context.merged(hits).select("query_id", "doc_id", "start_char", "end_char", F.sha2("content", 256).alias("sha256"), "parts")


@query(f"""WITH {WINDOWS}, g AS (SELECT query_id, doc_id, k, s, e, min(rank) AS rank FROM h WHERE regexp_matches(content, '\\S') GROUP BY ALL),
p AS (SELECT *, max(e) OVER (PARTITION BY query_id, doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, doc_id ORDER BY s) AS island FROM p)
SELECT query_id, doc_id, min(rank)::INT AS rank, string_agg(doc_id || '-' || k, ',' ORDER BY s) AS origins FROM i GROUP BY query_id, doc_id, island""")
def evidence_origins(spark, sf):
    """The chunks that each merged span comes from, by place."""
    hits = context.prepared(_hits(spark, sf)).where("action = 'kept'")
    return context.merged(hits).select("query_id", "doc_id", "rank", F.concat_ws(",", "origins").alias("origins"))


@query(f"""WITH RECURSIVE {WINDOWS}, g AS (SELECT query_id, doc_id, s, e, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h WHERE copy = 0 AND regexp_matches(content, '\\S')),
t AS (SELECT query_id, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS doc_id, NULL::INT AS e, true AS ok, NULL::INT AS rank FROM (SELECT DISTINCT query_id FROM g)
 UNION ALL SELECT query_id, n, used + CASE WHEN ok THEN cost ELSE 0 END, CASE WHEN ok THEN new_doc ELSE doc_id END, CASE WHEN ok THEN new_e ELSE e END, ok, rank FROM (
   SELECT *, used + cost <= 900 AS ok FROM (
     SELECT t.query_id, g.n, t.used, t.doc_id, t.e, g.doc_id AS new_doc, g.e AS new_e, g.rank, CASE WHEN t.doc_id = g.doc_id THEN g.e - greatest(g.s, t.e) ELSE g.e - g.s END AS cost
     FROM t JOIN g ON g.query_id = t.query_id AND g.n = t.n + 1)))
SELECT query_id, rank, CASE WHEN ok THEN 'selected' ELSE 'budget' END AS action FROM t WHERE n > 0""")
def pack_budget(spark, sf):
    """Greedy packing of evidence under a budget; what doesn't fit stops nothing after it."""
    hits = context.prepared(_hits(spark, sf)).where("action = 'kept'")
    return context.pack(hits, budget=900)


@query("""
WITH d AS (SELECT item_id, text, '[{"role":"system","content":"Cite."},{"role":"user","content":' || to_json('{"question":' || to_json(text) || ',"notes":[{"source_id":"S1","title":"t","source":"s.md","content":' || to_json(text) || '}]}') || '}]' AS m FROM benchmark)
SELECT item_id AS query_id, sha256(m::VARCHAR) AS context_id, length(m::VARCHAR) <= 500 AS fits FROM d
""")
def context_messages(spark, sf):
    """Messages as they are sent, their identity, and the last check of the budget."""
    note = F.array(F.struct(F.lit("S1").alias("source_id"), F.lit("t").alias("title"), F.lit("s.md").alias("source"), F.col("text").alias("content")))
    made = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), context.rendered(F.col("text"), note, "Cite.").alias("m"))
    return made.select("query_id", context.context_id(F.col("m")).alias("context_id"), context.within_budget(F.col("m"), F.length, context.Budget(window=600, output=50, margin=50)).alias("fits"))


@query("""
WITH h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'selected' WHEN doc_id % 3 = 1 THEN 'budget' ELSE 'empty' END AS action FROM documents UNION ALL SELECT doc_id, 'budget' FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id AS query_id, CASE WHEN bool_or(action = 'selected') THEN 'ready' WHEN bool_or(action = 'budget') THEN 'budget_exhausted' ELSE 'no_evidence' END AS status FROM h GROUP BY doc_id
""")
def context_status(spark, sf):
    """Ready, out of budget, or without evidence."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"))
    k = F.col("query_id") % 3
    rows = d.withColumn("action", F.when(k == 0, "selected").when(k == 1, "budget").otherwise("empty"))
    return context.status(rows.unionByName(d.where("query_id % 2 = 0").withColumn("action", F.lit("budget"))))


@query("SELECT doc_id, doc_id % 5 = 0 AS refused FROM documents")
def evidence_verified(spark, sf):
    """Evidence that isn't a stored record, word for word, is refused before it can be cited."""
    facts = [F.lit("v").alias("index_version"), F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.lit("r").alias("document_revision"), F.lit(0).alias("start_char"), F.length("text").alias("end_char")]
    records = table(spark, sf, "documents").select(*facts, F.col("text").alias("content"))
    hits = records.withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    good = context.verified(hits.where("doc_id % 5 <> 0"), records).select("doc_id", F.lit(False).alias("refused"))
    return good.unionByName(context.unverified(hits, records).select("doc_id", F.lit(True).alias("refused")))


# Raw answers: good ones, and each kind of broken one, with the document's own words.
_TEXT = "replace(replace(replace(replace(replace(text, chr(92), ''), '\"', ''), chr(10), ' '), chr(13), ' '), chr(9), ' ')"


@query(f"""
SELECT doc_id AS answer_id, CASE doc_id % 8 WHEN 0 THEN 'answered' WHEN 7 THEN 'insufficient_evidence' END AS status, CASE doc_id % 8 WHEN 0 THEN sha256({_TEXT}) END AS claim_sha256, doc_id % 8 NOT IN (0, 7) AS broken FROM documents
""")
def answers_parsed(spark, sf):
    """Strict answers, and errors for all others: nothing is repaired."""
    words = F.col("text")
    for c in ("\\", '"'):
        words = F.replace(words, F.lit(c), F.lit(""))
    words = F.translate(words, "\n\r\t", "   ")
    claim = F.concat(F.lit('{"text":"'), words, F.lit('","source_ids":["S1"]}'))
    one = lambda status, claims, missing, more="": F.concat(F.lit(f'{{"status":"{status}",{more}"claims":['), claims, F.lit(f'],"missing_information":[{missing}]}}'))
    none, k = F.lit(""), F.col("doc_id") % 8
    raw = (
        F.when(k == 0, one("answered", claim, ""))
        .when(k == 1, one("answered", claim, "", '"status":"answered",'))
        .when(k == 2, one("answered", claim, "NaN"))
        .when(k == 3, F.concat(F.lit("```json\n"), one("answered", claim, ""), F.lit("\n```")))
        .when(k == 4, one("answered", claim, "", '"x":1,'))
        .when(k == 5, one("answered", none, ""))
        .when(k == 6, one("answered", claim, '"more"'))
        .otherwise(one("insufficient_evidence", none, '"all"'))
    )
    p = table(spark, sf, "documents").select("doc_id", context.parsed_answer(raw).alias("p"))
    return p.select(
        F.col("doc_id").alias("answer_id"), "p.answer.status", F.sha2(F.get("p.answer.claims", F.lit(0))["text"], 256).alias("claim_sha256"), F.col("p.error").isNotNull().alias("broken")
    )


# Answers: each document claims its own last line (or itself, where that is blank), and some cite
# what they should not.
LAST = "CASE WHEN doc_id % 6 = 0 THEN 'no such words' WHEN trim(split_part(text, chr(10), -1)) <> '' THEN split_part(text, chr(10), -1) ELSE text END"


def _claims(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text") != "")
    d = F.col("doc_id")
    line = F.element_at(F.split("text", "\n"), -1)
    quote = F.struct(F.lit("S1").alias("source_id"), F.when(d % 6 == 0, "no such words").when(F.trim(line) != "", line).otherwise(F.col("text")).alias("text"))
    ids = F.when(d % 4 == 0, F.array().cast("array<string>")).when(d % 4 == 1, F.array(F.lit("S1"), F.lit("S9"))).otherwise(F.array(F.lit("S1")))
    text = F.when(d % 9 == 0, "as [S1] says").otherwise("as it says")
    claims = docs.select(d.alias("answer_id"), F.lit(0).alias("claim_index"), text.alias("text"), ids.alias("source_ids"), F.array(quote).alias("quotes"))
    sources = docs.select(d.alias("answer_id"), F.lit("S1").alias("source_id"), F.col("text").alias("content"), F.lit(0).alias("start_char"))
    return claims, sources


@query(f"""
WITH d AS (SELECT doc_id, text, {LAST} AS q FROM documents WHERE text <> ''),
i AS (SELECT doc_id, 'missing_reference' AS code, NULL AS source_id FROM d WHERE doc_id % 4 = 0
 UNION ALL SELECT doc_id, 'unknown_source', 'S9' FROM d WHERE doc_id % 4 = 1
 UNION ALL SELECT doc_id, 'inline_reference', NULL FROM d WHERE doc_id % 9 = 0
 UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'quote_not_referenced' WHEN NOT contains(text, q) THEN 'quote_not_found' ELSE 'ambiguous_quote' END, 'S1' FROM d
   WHERE doc_id % 4 = 0 OR NOT contains(text, q) OR contains(substr(text, instr(text, q) + 1), q))
SELECT doc_id AS answer_id, 0::INT AS claim_index, code, source_id FROM i
""")
def citation_validate(spark, sf):
    """What is wrong with each claim's references and quotes."""
    return context.issues(*_claims(spark, sf))


@query(f"""
WITH d AS (SELECT doc_id, text, {LAST} AS q FROM documents WHERE text <> '' AND doc_id % 4 <> 0)
SELECT doc_id AS answer_id, (instr(text, q) - 1)::INT AS start_char, (instr(text, q) - 1 + length(q))::INT AS end_char FROM d WHERE contains(text, q) AND NOT contains(substr(text, instr(text, q) + 1), q)
""")
def quote_spans(spark, sf):
    """Places of quotes that occur once."""
    return context.quote_places(*_claims(spark, sf)).where("start_char IS NOT NULL").select("answer_id", "start_char", "end_char")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '[1][2]' ELSE '[1]' END AS m, CASE WHEN doc_id % 9 = 0 THEN 'as \\[S1\\] says' ELSE 'as it says' END AS t FROM documents WHERE text <> '')
SELECT doc_id AS answer_id, t || ' ' || m AS body FROM d
""")
def rendered_claims(spark, sf):
    """Claims as inert Markdown with numbered sources."""
    return context.rendered_claims(_claims(spark, sf)[0])


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'as [S1] says' ELSE 'as it says' END AS t FROM documents WHERE text <> '' AND doc_id % 4 > 1 AND doc_id % 9 <> 0 AND doc_id % 6 <> 0)
SELECT doc_id AS answer_id, t || ' [1]' || chr(10) || chr(10) || 'Missing:' || chr(10) || chr(10) || '- no \\`date\\`' || chr(10) || chr(10) || 'Sources:' || chr(10) || chr(10) || '[1] Doc ' || doc_id || ' (' || doc_id || '.md)' AS markdown FROM d
""")
def answers_rendered(spark, sf):
    """Whole answers as inert Markdown, those with an issue left out."""
    claims, sources = _claims(spark, sf)
    claims = claims.withColumn("quotes", F.when(F.col("answer_id") % 6 == 0, F.col("quotes")).otherwise(F.slice("quotes", 1, 0)))
    answers = claims.select("answer_id", F.array(F.lit("no `date`")).alias("missing_information")).distinct()
    named = sources.select("answer_id", "source_id", F.concat(F.lit("Doc "), "answer_id").alias("title"), F.concat("answer_id", F.lit(".md")).alias("source"))
    return context.rendered_answers(answers, claims, named, context.issues(claims, sources))


@query("""
WITH d AS (SELECT doc_id, doc_id % 4 AS k FROM documents WHERE text <> '')
SELECT doc_id AS answer_id, 1::BIGINT AS claims, k > 1 AND doc_id % 9 <> 0 AS references_valid, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE 1.0 END AS claim_coverage FROM d
""")
def citation_stats(spark, sf):
    """Claims of each answer, how many are cited, and whether all references hold."""
    claims, sources = _claims(spark, sf)
    claims = claims.withColumn("quotes", F.slice("quotes", 1, 0))
    return context.citation_summary(context.issues(claims, sources), claims)


# Every line of a document is a claim; what it cites and how it is judged hang on its length.
LINES = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CASE length(line) % 4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS refs, CASE WHEN length(line) % 4 = 0 THEN 0 ELSE 1 END AS valid,
 CASE WHEN doc_id % 3 = 0 THEN NULL WHEN length(line) % 5 = 0 THEN NULL WHEN length(line) % 5 < 3 AND length(line) % 4 IN (1, 3) THEN 'supported' ELSE 'partial' END AS label FROM l),
a AS (SELECT doc_id AS answer_id, count(*)::BIGINT AS claim_count, sum(refs)::BIGINT AS reference_count, sum(valid)::BIGINT AS valid_reference_count, bool_and(refs = 1) AS references_valid,
 CASE WHEN sum(refs) > 0 THEN sum(valid) / sum(refs)::DOUBLE END AS citation_id_validity, sum(valid) / count(*)::DOUBLE AS claim_reference_coverage,
 CASE WHEN doc_id % 3 <> 0 THEN count(label) / count(*)::DOUBLE END AS support_review_coverage,
 CASE WHEN count(label) > 0 THEN count(*) FILTER (WHERE label = 'supported') / count(label)::DOUBLE END AS supported_claim_rate,
 CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS answer_correct, NULL::BOOLEAN AS answer_complete FROM c GROUP BY doc_id)
"""


def _line_statistics(spark, sf):
    docs = table(spark, sf, "documents").where("text IS NOT NULL").withColumnRenamed("doc_id", "answer_id")
    claims = docs.select("answer_id", F.posexplode(F.split("text", "\n", -1)).alias("claim_index", "line"))
    n, names = F.length("line"), lambda *ids: F.array(*map(F.lit, ids)).cast("array<string>")
    cited = F.when(n % 4 == 0, names()).when(n % 4 == 1, names("S1")).when(n % 4 == 2, names("S1", "S3")).otherwise(names("S2"))
    sources = docs.select("answer_id", F.explode(names("S1", "S2")).alias("source_id"))

    def label(line):
        n = F.length(line)
        return F.when(n % 5 == 0, None).when((n % 5 < 3) & (n % 4).isin(1, 3), "supported").otherwise("partial")

    reviews = docs.where(F.col("answer_id") % 3 != 0).select(
        "answer_id", F.lit("R").alias("reviewer"), F.transform(F.split("text", "\n", -1), label).alias("claim_support"),
        (F.col("answer_id") % 2 == 0).alias("answer_correct"), F.lit(None).cast("boolean").alias("answer_complete"),
    )
    return context.citation_statistics(docs, claims.withColumn("source_ids", cited), sources, reviews)


@query(f"""WITH {LINES} SELECT * REPLACE (round(citation_id_validity, 6) AS citation_id_validity, round(claim_reference_coverage, 6) AS claim_reference_coverage,
round(support_review_coverage, 6) AS support_review_coverage, round(supported_claim_rate, 6) AS supported_claim_rate) FROM a""")
def citation_reviews(spark, sf):
    """Of each answer: how many references exist, how many claims have one, how many were reviewed and found supported."""
    rates = ["citation_id_validity", "claim_reference_coverage", "support_review_coverage", "supported_claim_rate"]
    return _line_statistics(spark, sf).withColumns({c: F.round(c, 6) for c in rates})


@query(f"""WITH {LINES}, u AS (SELECT unnest([{{'measure': 'references_valid', 'v': references_valid::INT::DOUBLE}}, {{'measure': 'citation_id_validity', 'v': citation_id_validity}},
 {{'measure': 'claim_reference_coverage', 'v': claim_reference_coverage}}, {{'measure': 'support_review_coverage', 'v': support_review_coverage}}, {{'measure': 'supported_claim_rate', 'v': supported_claim_rate}},
 {{'measure': 'answer_correct', 'v': answer_correct::INT::DOUBLE}}, {{'measure': 'answer_complete', 'v': answer_complete::INT::DOUBLE}}], recursive := true) FROM a)
SELECT measure, round(avg(v), 6) AS mean, count(v)::BIGINT AS defined_cases FROM u GROUP BY measure""")
def citation_review_means(spark, sf):
    """Means of these rates over the answers where they are defined, and of how many."""
    return context.citation_means(_line_statistics(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("SELECT doc_id AS answer_id, (-1)::INT AS claim_index, 'inline_reference_in_missing_information' AS code FROM documents WHERE doc_id % 3 = 0")
def missing_information_check(spark, sf):
    """What is said to be missing must not hold references either."""
    claims, sources = _claims(spark, sf)
    told = F.when(F.col("doc_id") % 3 == 0, "see https://a.example").otherwise("a date")
    answers = table(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"), F.array(told).alias("missing_information"))
    return context.issues(claims, sources, answers=answers).where("claim_index = -1").select("answer_id", "claim_index", "code")


@query("""
SELECT doc_id AS case_id, CASE WHEN doc_id % 5 < 2 THEN doc_id % 2 = 0 END AS complete, CASE WHEN doc_id % 5 < 2 THEN 1 + (doc_id % 3 = 0)::INT END::INT AS correct, doc_id % 5 > 1 AS broken FROM documents
""")
def judgments_parsed(spark, sf):
    """Judgments on two facts; repeated keys, other numbers of facts and NaN are errors."""
    from tarn.operators.generation import fact_judgments

    d = F.col("doc_id")
    fact = lambda i, ok: F.concat(F.lit(f'{{"index":{i},"rationale":"r","correct":'), ok.cast("string"), F.lit("}"))
    whole = lambda facts, more="": F.concat(F.lit('{"facts":['), facts, F.lit(f'],{more}"task_fulfilled":true,"rationale":"r","complete":'), (d % 2 == 0).cast("string"), F.lit("}"))
    first, second = fact(0, F.lit(True)), fact(1, d % 3 == 0)
    raw = (
        F.when(d % 5 < 2, whole(F.concat_ws(",", second, first)))
        .when(d % 5 == 2, whole(first))
        .when(d % 5 == 3, whole(F.concat_ws(",", first, second), '"rationale":"r",'))
        .otherwise(F.replace(whole(F.concat_ws(",", first, second)), F.lit('"index":1'), F.lit('"index":NaN')))
    )
    p = table(spark, sf, "documents").select("doc_id", fact_judgments(raw, F.lit(2)).alias("p"))
    return p.select(F.col("doc_id").alias("case_id"), "p.complete", "p.correct", F.col("p.error").isNotNull().alias("broken"))


@query("SELECT r_regionkey AS case_id, ['used', 'truncated', 'structure', 'references', 'budget'][r_regionkey::INT + 1] AS outcome FROM region")
def generation_outcomes(spark, sf):
    """One cited answer for each region, by a scripted model: a good one, and each kind of failure."""
    from tarn.operators import generation

    rows = []
    for r in table(spark, sf, "region").orderBy("r_regionkey").collect():  # 5 rows
        cites = "S1" if r["r_regionkey"] != 3 else "S9"
        text = "no answer" if r["r_regionkey"] == 2 else '{"status":"answered","claims":[{"text":"so","source_ids":["%s"]}],"missing_information":[]}' % cites
        reply = generation.Reply(text, "length" if r["r_regionkey"] == 1 else "stop")
        budget = context.Budget(window=40 if r["r_regionkey"] == 4 else 8192, output=10, margin=0)
        try:
            generation.cited_answer(spark, "which?", {"S1": r["r_name"]}, lambda m, s, reply=reply: reply, "Cite.", budget, len)
            rows.append((r["r_regionkey"], "used"))
        except generation.GenerationError as error:
            rows.append((r["r_regionkey"], error.code))
    return spark.createDataFrame(rows, "case_id long, outcome string")
