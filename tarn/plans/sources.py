"""Queries of sources, sinks and snapshots: what is written is read back and compared.

Notes are made of the tables of nations and regions, which are the same at every
scale; everything else works on whole growing tables.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from tarn.functions.text import terms
from tarn.operators import bm25, chunking, lifecycle, runs, vector
from tarn.plans.base import query, scratch, table
from tarn.sources import datasets, notes
from tarn.sources.files import Files


def _note_folder(spark, sf):
    """A note for each nation, and files that are none."""
    files = Files(spark, scratch(spark))
    for r in table(spark, sf, "nation").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").collect():  # 25 rows
        files.create(f"{r['n_name'].lower()} {r['n_nationkey']}+.md", f"lead\n# {r['n_name']}\n\nIn {r['r_name']}.\n\n".encode())
    files.create("empty.md", b"")
    files.create("other.MD", b"# not a note")
    files.create("below/x.md", b"# not entered")
    return files.root


NOTES = "n AS (SELECT lower(n_name) || ' ' || n_nationkey || '+.md' AS source, n_name AS title, 'lead' || chr(10) || chr(10) || 'In ' || r_name || '.' AS content FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'empty.md', 'empty', '')"


@query(f"WITH {NOTES} SELECT source, title, content FROM n")
def note_scan(spark, sf):
    """Notes right in a folder, by their suffix as written; the title line leaves the body."""
    return notes.stable_notes(spark, _note_folder(spark, sf))


@query(f"WITH {NOTES} SELECT source, title, content, 1::BIGINT AS files_opened FROM n WHERE source = (SELECT max(source) FROM n)")
def note_filtered(spark, sf):
    """One note under a source filter, and how many files its plan opens."""
    folder = _note_folder(spark, sf)
    last = max(r["source"] for r in table(spark, sf, "nation").select(F.concat(F.lower("n_name"), F.lit(" "), "n_nationkey", F.lit("+.md")).alias("source")).collect())  # 25 rows
    opened = len(notes.note_files(spark, folder, last).inputFiles())
    return notes.load_notes(spark, folder, last).withColumn("files_opened", F.lit(opened).cast("long"))


@query(f"WITH {NOTES} SELECT source, substr(content, 3, 6) AS part, 2::BIGINT AS start_char, 8::BIGINT AS end_char FROM n WHERE source <> 'empty.md'")
def note_read(spark, sf):
    """A range of characters of every live note."""
    live = lifecycle.with_revisions(notes.load_notes(spark, _note_folder(spark, sf))).persist()
    names = [r["source"] for r in live.where("source <> 'empty.md'").select("source").collect()]  # 25 rows
    parts = [notes.read_part(live, source=n, start=2, end=8) for n in names]
    live.unpersist()
    return spark.createDataFrame([(p["source"], p["content"], p["start_char"], p["end_char"]) for p in parts], "source string, part string, start_char long, end_char long")


@query("SELECT doc_id, lang, sha256(text) AS sha256, n_chars::BIGINT AS n_chars FROM documents")
def jsonl_strict(spark, sf):
    """Documents through a JSONL file and its strict reader."""
    path = scratch(spark)
    table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "text", "lang", "n_chars")).alias("value")).write.text(path)
    found = datasets.read_jsonl(spark, path, "doc_id long, text string, lang string, n_chars long")
    return found.select("doc_id", "lang", F.sha2("text", 256).alias("sha256"), "n_chars")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def tsv_import(spark, sf):
    """Customers through a TSV file, identifiers as text."""
    path = scratch(spark)
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(path, sep="\t", header=True, quote="")
    return datasets.read_tsv(spark, path, "c_custkey string, c_name string, c_mktsegment string")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_brand FROM part")
def parquet_import(spark, sf):
    return datasets.read_parquet(spark, f"{sf}/part.parquet", ["p_partkey"]).select("p_partkey", "p_brand")


@query("SELECT 'supplier' AS name, count(*)::BIGINT AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier UNION ALL SELECT 'part', count(*), sum(p_partkey) FROM part")
def dataset_saved(spark, sf):
    """Tables saved with checksums and loaded again."""
    folder = scratch(spark)
    datasets.save({"supplier": table(spark, sf, "supplier"), "part": table(spark, sf, "part")}, folder)
    found = datasets.load(spark, folder)
    one = lambda n, key: found[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(key).cast("long").alias("keys"))
    return one("supplier", "s_suppkey").unionByName(one("part", "p_partkey"))


@query("""
WITH q AS (SELECT item_id FROM benchmark UNION ALL SELECT item_id FROM benchmark WHERE item_id % 6 = 0), r AS (SELECT doc_id::VARCHAR AS query_id, doc_id, quality FROM labels)
SELECT 'query_twice' AS problem, item_id::VARCHAR AS key FROM benchmark WHERE item_id % 6 = 0
UNION SELECT 'unknown_query', query_id FROM r WHERE query_id NOT IN (SELECT item_id::VARCHAR FROM q)
UNION SELECT 'unknown_document', (doc_id + 7)::VARCHAR FROM r WHERE doc_id + 7 NOT IN (SELECT doc_id FROM documents)
""")
def dataset_import(spark, sf):
    """An external collection that can't be saved, and why."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    queries = items.unionByName(items.where("query_id % 6 = 0"))
    qrels = table(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), (F.col("doc_id") + 7).alias("doc_id"), F.col("quality").alias("grade"))
    corpus = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("title"), "text")
    return datasets.import_dataset(corpus, queries, qrels, scratch(spark))


@query("""
WITH v AS (SELECT (2 + conv_id % 3) || 'hop' || turn || '__' || conv_id AS id, conv_id, turn, conv_id % 2 = turn % 2 AS answerable FROM conversations WHERE turn IN (0, 1))
SELECT conv_id::VARCHAR AS question_id, (2 + conv_id % 3)::INT AS hops, max(id) FILTER (WHERE answerable) AS answerable, max(id) FILTER (WHERE NOT answerable) AS unanswerable
FROM v GROUP BY conv_id HAVING count(*) FILTER (WHERE answerable) = 1 AND count(*) FILTER (WHERE NOT answerable) = 1
""")
def question_pairs(spark, sf):
    """Answerable and unanswerable variants of one multi-hop question: its first two turns."""
    c = table(spark, sf, "conversations").where("turn IN (0, 1)")
    name = F.concat((2 + F.col("conv_id") % 3).cast("string"), F.lit("hop"), F.col("turn"), F.lit("__"), F.col("conv_id"))
    return datasets.paired_questions(c.select(name.alias("id"), (F.col("conv_id") % 2 == F.col("turn") % 2).alias("answerable")))


@query("SELECT item_id AS query_id, sha256(text) AS text_sha256, CASE item_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM benchmark")
def dataset_frozen(spark, sf):
    """The same queries with nothing but their split rewritten."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit("old").alias("split"))
    i = F.col("query_id") % 3
    splits = q.select("query_id", F.when(i == 0, "dev").when(i == 1, "validation").otherwise("test").alias("split"))
    return datasets.frozen(q, splits).select("query_id", F.sha2("text", 256).alias("text_sha256"), "split")


@query("SELECT sha256(lang || chr(10) || text) || '.md' AS source, lang AS title, sha256(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS content_sha256 FROM documents")
def notes_converted(spark, sf):
    """Documents from elsewhere as notes under opaque names."""
    source, title, content = notes.note_of(F.col("lang"), F.col("text"))
    return table(spark, sf, "documents").select(source, title, F.sha2(content, 256).alias("content_sha256"))


@query("""SELECT doc_id, sha256(lang || chr(10) || chr(10) || text) AS document_sha256, sha256('Instruct: find' || chr(10) || 'Query:' || text) AS query_sha256, len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) > 500 AS over_limit FROM documents""")
def embedding_inputs(spark, sf):
    """Texts as they are embedded, and whether they are over a model's limit of terms."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", F.sha2(chunking.prepared_document(F.col("lang"), F.col("text")), 256).alias("document_sha256"),
        F.sha2(chunking.prepared_query("find", F.col("text")), 256).alias("query_sha256"), chunking.over_limit(F.size(terms(F.col("text"))), 500).alias("over_limit"),
    )


# A snapshot of the documents as chunks, with vectors that are numbers of their texts.
def _built(spark, sf, index=False):
    docs = table(spark, sf, "documents").where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.concat("doc_id", F.lit(".md")).alias("source"),
        F.sha2("text", 256).alias("document_revision"), F.col("text").alias("content"), F.md5(F.col("text").cast("binary")).alias("embedding_key"), F.lit(0).alias("chunk_index"),
    )
    store = lifecycle.Store(spark, scratch(spark))
    tokens = bm25.tokenised(docs, F.col("content")).select("chunk_id", "source", "terms", "length") if index else None
    return store, docs, tokens


def _numbers(df):
    """A stand-in for a model: length, and share of blanks."""
    size = F.length("content").cast("double")
    return df.withColumn("embedding", F.array(size + 1, F.regexp_count("content", F.lit(" ")) / (size + 1)))


@query("SELECT doc_id::VARCHAR AS chunk_id, doc_id || '.md' AS source, 2::INT AS dimensions, round(length(text) + 1.0::DOUBLE, 6) AS first FROM documents")
def snapshot_build(spark, sf):
    """A snapshot built, verified, published and read back with its vectors."""
    store, docs, _ = _built(spark, sf)
    store.build(docs, _numbers, {"size": 1})
    return store.loaded().select("chunk_id", "source", F.size("embedding").alias("dimensions"), F.round(F.col("embedding")[0], 6).alias("first"))


@query("""
SELECT 'first' AS build, false AS reused, 'added' AS change, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'again', true, 'added', count(*) FROM documents
UNION ALL SELECT 'edited', false, CASE WHEN doc_id % 10 = 0 THEN 'deleted' WHEN doc_id % 10 = 1 THEN 'modified' ELSE 'unchanged' END, count(*) FROM documents GROUP BY 3
""")
def snapshot_reuse(spark, sf):
    """What three builds did: all new, nothing to do, and some edited or gone."""
    store, docs, _ = _built(spark, sf)
    d = F.col("doc_id").cast("long") % 10
    edited = docs.where(d != 0).withColumns({c: F.when(d == 1, F.concat(c, F.lit("!"))).otherwise(F.col(c)) for c in ("document_revision", "content", "embedding_key")})
    made = [("first", store.build(docs, _numbers, {})), ("again", store.build(docs, _numbers, {})), ("edited", store.build(edited, _numbers, {}))]
    rows = [(name, m["reused"], change, n) for name, m in made for change, n in m["changes"].items()]
    return spark.createDataFrame(rows, "build string, reused boolean, change string, n long")


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS term FROM documents)
SELECT term, doc_id::VARCHAR AS chunk_id, doc_id || '.md' AS source, count(*)::BIGINT AS tf FROM t WHERE term IN ('the', 'and', 'der', 'report') GROUP BY ALL
""")
def snapshot_postings(spark, sf):
    """Stored postings of some terms, from their buckets alone."""
    store, docs, tokens = _built(spark, sf, index=True)
    store.build(docs, lambda df: df.withColumn("embedding", F.array().cast("array<double>")), {}, tokens=tokens)
    return store.postings(["the", "and", "der", "report"]).select("term", "chunk_id", "source", "tf")


@query("SELECT unnest(['failed', 'ready']) AS status, unnest([1, 1])::BIGINT AS builds, unnest([false, true]) AS active")
def snapshot_failure(spark, sf):
    """A build whose vectors are no numbers fails and leaves the active one alone."""
    store, docs, _ = _built(spark, sf)
    good = store.build(docs, _numbers, {})
    try:
        store.build(docs.withColumn("embedding_key", F.concat("embedding_key", F.lit("?"))), lambda df: df.withColumn("embedding", F.array(F.lit(float("nan")))), {"size": 2})
    except ValueError:
        pass
    found = store.status()
    rows = [(b["status"], 1, b["version"] == found["active"]["version"] == good["version"]) for b in found["builds"] if b["status"] == "failed" or b["version"] == good["version"]]
    return spark.createDataFrame(rows, "status string, builds long, active boolean")


@query("""
WITH k AS (SELECT doc_id, md5(text) AS key FROM documents), e AS (SELECT CASE WHEN doc_id % 10 = 1 THEN key || '!' ELSE key END AS key FROM k WHERE doc_id % 10 <> 0)
SELECT 'built' AS step, 1::BIGINT AS entry, count(DISTINCT key)::BIGINT AS vectors, false AS refused FROM k
UNION ALL SELECT 'late', 2, count(DISTINCT key), true FROM (SELECT key FROM k UNION ALL SELECT key FROM e)
UNION ALL SELECT 'compacted', 4, count(DISTINCT key), false FROM e
""")
def snapshot_commits(spark, sf):
    """Entries of a store's log and its distinct vectors: a build, one refused as another was published within it, and compaction."""
    store, docs, _ = _built(spark, sf)
    slow, rows = lifecycle.Store(spark, store.files.root, lease_s=0.0), []
    d = F.col("doc_id").cast("long") % 10
    edited = docs.where(d != 0).withColumns({c: F.when(d == 1, F.concat(c, F.lit("!"))).otherwise(F.col(c)) for c in ("document_revision", "content", "embedding_key")})

    def note(step, refused=False):
        rows.append((step, store.head()[0], store.vectors().select("embedding_key").distinct().count(), refused))

    def taken_over(df):
        store.build(edited, _numbers, {})
        return _numbers(df)

    store.build(docs, _numbers, {})
    note("built")
    try:
        slow.build(docs, taken_over, {"size": 2})
        note("late")
    except RuntimeError:
        note("late", True)
    store.compact()  # both versions are ready: all vectors stay
    store.expire()
    store.compact()
    note("compacted")
    return spark.createDataFrame(rows, "step string, entry long, vectors long, refused boolean")


@query("SELECT doc_id::VARCHAR AS chunk_id, sha256(text) AS sha256 FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def snapshot_record(spark, sf):
    """One record of a version, by its id."""
    store, docs, _ = _built(spark, sf)
    made = store.build(docs, _numbers, {})
    least = str(table(spark, sf, "documents").agg(F.min("doc_id")).first()[0])
    return store.record(made["version"], least).select("chunk_id", F.sha2("content", 256).alias("sha256"))


@query("""
SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'missing' WHEN vec_id % 11 = 0 THEN 'ambiguous' WHEN vec_id % 7 = 0 THEN 'size' WHEN vec_id % 5 = 0 THEN 'zero' END AS problem
FROM embeddings WHERE vec_id % 13 = 0 OR vec_id % 11 = 0 OR vec_id % 7 = 0 OR vec_id % 5 = 0
""")
def vector_cache_check(spark, sf):
    """What is wrong with stored vectors before a snapshot may be published."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    i, e = F.col("vec_id"), F.col("embedding")
    kept = v.where(i % 13 != 0).withColumn("embedding", F.when((i % 7 == 0) & (i % 11 != 0), F.slice(e, 1, 3)).when((i % 5 == 0) & (i % 11 != 0), F.transform(e, lambda x: x * 0)).otherwise(e))
    twice = v.where((i % 11 == 0) & (i % 13 != 0)).withColumn("embedding", F.transform(e, lambda x: x + 1))
    return lifecycle.cache_problems(v, kept.unionByName(twice), "vec_id")


@query("SELECT vec_id, vec_id % 4 = 0 AS foreign FROM embeddings")
def hits_resolved(spark, sf):
    """Hits and whether a record backs them."""
    v = table(spark, sf, "embeddings").select("vec_id")
    return vector.resolved(v, v.where("vec_id % 4 <> 0"), "vec_id").select("vec_id", "foreign")


@query("SELECT unnest(['same', 'other']) AS kind, unnest([true, false]) AS accepted")
def embedding_spec_guard(spark, sf):
    """Vectors of another kind are refused."""
    dims = table(spark, sf, "embeddings").select(F.max(F.size("embedding"))).first()[0]
    own, rows = vector.EmbeddingSpec("model", dims), []
    for kind, spec in (("same", vector.EmbeddingSpec("model", dims)), ("other", vector.EmbeddingSpec("model", dims + 1))):
        try:
            own.require(spec)
            rows.append((kind, True))
        except ValueError:
            rows.append((kind, False))
    return spark.createDataFrame(rows, "kind string, accepted boolean")


@query("""
WITH c AS (SELECT r_name AS method, r_regionkey, n_nationkey AS case_id FROM nation, region)
SELECT case_id, method, CASE WHEN (case_id + r_regionkey) % 6 = 0 THEN 'failed' ELSE 'done' END AS outcome, (SELECT count(*) FROM documents)::BIGINT AS documents FROM c
""")
def run_matrix(spark, sf):
    """Every method on every case over an input that is checked not to drift; failures stay as rows."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    n = docs.count()
    cases = [{"case_id": r["n_nationkey"]} for r in table(spark, sf, "nation").collect()]  # 25 rows

    def method(key):
        def run(case):
            if (case["case_id"] + key) % 6 == 0:
                raise RuntimeError("no answer")
            return [{"documents": n}]

        return run

    methods = {r["r_name"]: method(r["r_regionkey"]) for r in table(spark, sf, "region").collect()}  # 5 rows
    found = runs.run_cases(cases, methods, docs)
    rows = [(r["case_id"], r["method"], "failed" if r["error"] else "done", n) for r in found]
    return spark.createDataFrame(rows, "case_id long, method string, outcome string, documents long")


@query("SELECT '| r_regionkey | r_name |' AS line, 0::BIGINT AS place UNION ALL SELECT '|---|---|', 1 UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |', row_number() OVER (ORDER BY r_regionkey) + 1 FROM region")
def report_markdown(spark, sf):
    """A report as Markdown, in a new file that appears whole."""
    files = Files(spark, scratch(spark))
    rows = table(spark, sf, "region").orderBy("r_regionkey").select("r_regionkey", "r_name").collect()  # 5 rows
    datasets.put_report(files, "report.md", ["r_regionkey", "r_name"], [r.asDict() for r in rows], "markdown")
    lines = files.read("report.md").decode().splitlines()
    return spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, place long")


@query("SELECT unnest(['one writer', 'two writers', 'lapsed']) AS state, unnest([true, false, true]) AS entered")
def store_lock(spark, sf):
    """One writer at a time; a lapsed lock is taken over."""
    store, rows = lifecycle.Store(spark, scratch(spark)), []

    def tried(state):
        try:
            with store.writer():
                rows.append((state, True))
        except RuntimeError:
            rows.append((state, False))

    tried("one writer")
    with store.writer():
        tried("two writers")
    old = datetime.datetime(2000, 1, 1).timestamp()
    store.files.create("writer.lock", json.dumps({"token": "dead", "until": old}).encode())
    tried("lapsed")
    return spark.createDataFrame(rows, "state string, entered boolean")


@query("SELECT item_id AS query_id, length(text)::DOUBLE AS first, 2::INT AS dimensions FROM benchmark")
def embedded_batches(spark, sf):
    """Texts given to a model in batches, by number and by tokens; a busy model is asked again."""

    class Busy(Exception):
        status = 429

    asked = []

    def model(texts):
        asked.append(len(texts))
        if len(asked) % 2:
            raise Busy("again")
        return [[float(len(t)), 1.0] for t in texts]

    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    found = chunking.embed(rows, model, count=len, most_items=8, most_tokens=4_000, attempts=2, delay=0.0)
    return found.select("query_id", F.col("embedding")[0].alias("first"), F.size("embedding").alias("dimensions"))


def _engine(spark, sf):
    from tarn.api import Engine

    return Engine(spark, _note_folder(spark, sf), scratch(spark), lambda texts: [[float(t.count("A")) + 1, float(t.count("I")) + 1] for t in texts], lambda q, t: -t.map(len).astype(float))


@query(f"WITH {NOTES} SELECT source, instr(content, 'In ')::BIGINT - 1 AS start_char, 'In ' AS content FROM n WHERE contains(content, 'In ')")
def engine_match(spark, sf):
    """Literal matches in live notes, without an index."""
    return _engine(spark, sf).match("In ", top_k=1000).select("source", "start_char", "content")


@query(f"""WITH {NOTES} SELECT r_name AS asked, source, 'bm25' AS method FROM n JOIN region ON contains(content, 'In ' || r_name || '.') OR title = r_name""")
def engine_search(spark, sf):
    """Notes of each region, by a ranked search of its name over stored postings."""
    engine, rows = _engine(spark, sf), []
    engine.index()
    for r in table(spark, sf, "region").collect():  # 5 rows
        name = r["r_name"].split()[-1]
        found = engine.search(name, "lexical", top_k=100).collect()
        rows += [(r["r_name"], h["source"], h["method"]) for h in found if r["r_name"] in h["content"] or h["title"] == r["r_name"]]
    return spark.createDataFrame(rows, "asked string, source string, method string")


@query("SELECT unnest(['bm25', 'lexical', 'semantic', 'hybrid', 'hybrid+rerank', 'other', 'blank', 'zero']) AS mode, unnest(['bm25', 'bm25', 'semantic', 'hybrid', 'hybrid+rerank', NULL, NULL, NULL]) AS method, unnest([3, 3, 3, 3, 3, NULL, NULL, NULL])::BIGINT AS hits")
def engine_modes(spark, sf):
    """Every mode answers as itself; unknown modes, blank queries and no results asked for are refused."""
    engine, rows = _engine(spark, sf), []
    engine.index()
    for mode, asked, k in [("bm25", "in", 3), ("lexical", "in", 3), ("semantic", "in", 3), ("hybrid", "in", 3), ("hybrid+rerank", "in", 3), ("other", "in", 3), ("blank", " ", 3), ("zero", "in", 0)]:
        try:
            found = engine.search(asked, {"blank": "bm25", "zero": "bm25"}.get(mode, mode.partition("+")[0]), mode.endswith("rerank"), top_k=k).collect()
            rows.append((mode, found[0]["method"], len(found)))
        except ValueError:
            rows.append((mode, None, None))
    return spark.createDataFrame(rows, "mode string, method string, hits long")


@query("SELECT unnest(['slow', 'fast']) AS job, unnest([true, false]) AS stopped")
def run_deadline(spark, sf):
    """A job beyond its deadline is cancelled; another goes on."""
    slow = F.udf(lambda x: (__import__("time").sleep(2), x)[1], "long")
    rows = []
    for job, seconds, df in (("slow", 0.4, spark.range(8).select(slow("id"))), ("fast", 60, table(spark, sf, "region"))):
        try:
            with runs.deadline(spark, seconds):
                df.collect()
            rows.append((job, False))
        except TimeoutError:
            rows.append((job, True))
    return spark.createDataFrame(rows, "job string, stopped boolean")


@query("SELECT unnest(['python', 'machine', 'spark', 'pyarrow', 'numpy', 'pandas', 'time_zone']) AS name, true AS known")
def run_provenance(spark, sf):
    """Versions that results depend on."""
    return spark.createDataFrame([(k, bool(v)) for k, v in datasets.provenance(spark).items()], "name string, known boolean")
