"""A text index that grows by segments, with postings in blocks that carry score bounds.

An update writes one segment of the documents that are new, and a list of those that
are gone from older segments with the terms they take along; nothing else is written.
When ``fan`` segments have come to one level they are merged into one of the next, so
a document is rewritten as often as there are levels.

A segment's documents are dealt into shards and numbered in each by id. Of each term of
a shard, postings lie in blocks of ``BLOCK``: document numbers, frequencies and lengths,
packed, and the pairs of frequency and length that no other pair of the block beats.
From these pairs a block's highest score follows for any statistics of the corpus, which
change as it grows. A search takes windows of documents by their bounds, best first,
unpacks only blocks that may still reach the kth score, and counts the others.

Ranks and scores are those of :mod:`tarn.operators.bm25` over the documents that are
there, however they came.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators.bm25 import STEPS, Bm25
from tarn.sources.files import Files

#: Postings of a block, and folders that a segment's terms are dealt into at most.
BLOCK, BUCKETS = 128, 16
#: Documents and postings of a shard, about: a search holds one in memory. Segments that don't say how many shards they have were written with the older number.
SHARD, SHARD_POSTINGS, OLDER_SHARD = 10_240, 4_000_000, 50_000
#: Documents that a search scores at a time.
WINDOW = 1024
#: Queries that one call answers.
MOST_QUERIES = 1000
_RAW = 16
_PAIRS = "array<struct<tf:int,length:int>>"
_BLOCKS = f"shard int, term string, block int, n int, first int, last int, postings binary, best {_PAIRS}, ids array<string>, sources array<string>"
_DOCS = "chunk_id string, source string, mark string, length long, terms array<struct<term:string,tf:int>>"


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def counted(tokens: DataFrame) -> DataFrame:
    """Documents as segments hold them, from ``chunk_id, source, mark, terms, length``: each distinct term with its frequency.

    ``mark`` names a document's text: one whose mark has changed is another document.
    """

    def runs(ordered: Column) -> Column:
        """Of equal neighbours: where each run begins, and how far it goes."""
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i - 1) != F.get(ordered, i)))

        def sized(starts: Column) -> Column:
            size = lambda a, k: F.coalesce(F.get(starts, k + 1), F.size(ordered)) - a
            return F.transform(starts, lambda a, k: F.struct(F.get(ordered, a).alias("term"), size(a, k).alias("tf")))

        return _let(starts, sized)

    terms = F.when(F.size("terms") > 0, _let(F.array_sort("terms"), runs)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))
    return tokens.select(F.col("chunk_id").cast("string"), F.col("source").cast("string"), F.col("mark").cast("string"), F.col("length").cast("long"), terms.alias("terms"))


def _frontier(tf: np.ndarray, length: np.ndarray) -> list[dict]:
    """Pairs that no other pair beats by both a higher frequency and a shorter text."""
    if len(tf) == 1:
        return [{"tf": int(tf[0]), "length": int(length[0])}]
    out, least = [], None
    for k in np.lexsort((length, -tf)).tolist():
        if least is None or length[k] < least:
            least = length[k]
            out.append({"tf": int(tf[k]), "length": int(length[k])})
    return out


def _packed(docs: np.ndarray, tf: np.ndarray, length: np.ndarray) -> bytes:
    """Steps between document numbers, frequencies and lengths; a few postings as they are, more in zstd."""
    rows = np.concatenate([docs[:1], docs[1:] - docs[:-1], tf, length]).astype("<u4").tobytes()
    return rows if len(docs) < _RAW else pa.compress(rows, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    """Rows of document numbers, frequencies and lengths."""
    data = data if n < _RAW else pa.decompress(data, decompressed_size=12 * n, codec="zstd", asbytes=True)
    rows = np.frombuffer(data, "<u4").reshape(3, n).astype(np.int64)
    rows[0] = np.cumsum(rows[0])
    return rows


def _blocks(numbered: DataFrame, buckets: int) -> DataFrame:
    """Blocks of all postings, and a row of ids and sources for each ``BLOCK`` documents of a shard (its term is empty)."""
    schema = pa.schema(
        [("shard", pa.int32()), ("term", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("postings", pa.binary()),
         ("best", pa.list_(pa.struct([("tf", pa.int32()), ("length", pa.int32())]))), ("ids", pa.list_(pa.string())), ("sources", pa.list_(pa.string()))]
    )

    def run(batches):
        held: dict = {"key": None, "block": 0, "rows": []}

        def block():
            shard, term = held["key"]
            doc, tf, length = np.array([r[:3] for r in held["rows"]], np.int64).T
            ids, sources = ([r[3] for r in held["rows"]], [r[4] for r in held["rows"]]) if term == "" else (None, None)
            row = (shard, term, held["block"], len(doc), int(doc[0]), int(doc[-1]), _packed(doc, tf, length), _frontier(tf, length), ids, sources)
            held["block"], held["rows"] = held["block"] + 1, []
            return row

        def rows():
            for b in batches:
                for shard, term, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "term", "doc", "tf", "length", "chunk_id", "source")), strict=True):
                    if held["rows"] and ((shard, term) != held["key"] or len(held["rows"]) == BLOCK):
                        yield block()
                    if (shard, term) != held["key"]:
                        held["key"], held["block"] = (shard, term), 0
                    held["rows"].append(row)
            if held["rows"]:
                yield block()

        out = []
        for row in rows():
            out.append(row)
            if len(out) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    null = F.lit(None).cast("string")
    terms = numbered.select("shard", "doc", "length", F.explode("terms").alias("t")).select("shard", F.col("t.term").alias("term"), "doc", F.col("t.tf").alias("tf"), "length", null.alias("chunk_id"), null.alias("source"))
    names = numbered.select("shard", F.lit("").alias("term"), "doc", F.lit(0).alias("tf"), "length", "chunk_id", "source")
    every = terms.unionByName(names).withColumn("bucket", _bucket(buckets))
    dealt = every.repartition("bucket", "shard").sortWithinPartitions("bucket", "term", "shard", "doc")
    return dealt.drop("bucket").mapInArrow(run, _BLOCKS).withColumn("bucket", _bucket(buckets))


def _bucket(buckets: int) -> Column:
    return (F.crc32(F.col("term").cast("binary")) % buckets).cast("int")


class Segments:
    """The index in one folder: ``docs``, ``blocks`` by segment, ``gone`` by update; a state says what is live."""

    def __init__(self, spark: SparkSession, root: str, fan: int = 4):
        self.spark, self.files, self.fan = spark, Files(spark, str(root)), fan

    def _write(self, docs: DataFrame, level: int) -> dict | None:
        """One segment of counted documents; nothing if there are none."""
        name = uuid.uuid4().hex[:12]
        docs.write.parquet(self.files.path(f"docs/segment={name}"))
        stored = self.spark.read.schema(_DOCS).parquet(self.files.path(f"docs/segment={name}"))
        size = stored.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
        if not size["n"]:
            self.files.remove(f"docs/segment={name}")
            return None
        buckets = max(1, min(BUCKETS, size["postings"] // 500_000))
        shards = max(-(-size["n"] // SHARD), -(-size["postings"] // SHARD_POSTINGS))
        place = F.row_number().over(Window.partitionBy("shard").orderBy("chunk_id")) - 1
        numbered = stored.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")).withColumn("doc", place)
        _blocks(numbered, buckets).write.partitionBy("bucket").parquet(self.files.path(f"blocks/segment={name}"))
        found = self.files.folders(f"blocks/segment={name}")
        return {"segment": name, "level": level, "n_docs": size["n"], "total_terms": size["terms"], "shards": shards, "buckets": buckets, "parts": sorted(int(x.partition("=")[2]) for x in found if x.startswith("bucket="))}

    def update(self, state: dict | None, added: DataFrame, removed: DataFrame | None = None) -> dict:
        """The state after an update. ``added``: :func:`counted` documents; ``removed``: the ``chunk_id`` of others that are live.

        Older states stay readable until their segments are removed (:meth:`clean`).
        """
        state = json.loads(json.dumps(state or {"segments": [], "gone": [], "n_docs": 0, "total_terms": 0}))
        if removed is not None and state["segments"]:
            state = self._without(state, removed)
        made = self._write(added, 0)
        if made:
            state["segments"].append(made)
            state["n_docs"] += made["n_docs"]
            state["total_terms"] += made["total_terms"]
        return self._merged(state)

    def difference(self, state: dict | None, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``chunk_id`` of those of ``chunk_id, source, mark`` that the index lacks, and of those that it has beyond them."""
        same = ["chunk_id", "source", "mark"]
        new = marks.select(*[F.col(c).cast("string") for c in same])
        old = self.live(state or {"segments": []}).select(*same)
        return new.join(old, same, "left_anti").select("chunk_id"), old.join(new, same, "left_anti").select("chunk_id")

    def _without(self, state: dict, removed: DataFrame) -> dict:
        name = uuid.uuid4().hex[:12]
        lost = self.live(state).join(removed.select(F.col("chunk_id").cast("string")).distinct(), "chunk_id", "left_semi")
        lost.write.parquet(self.files.path(f"gone/batch={name}"))
        stored = self.spark.read.schema(_DOCS + ", segment string").parquet(self.files.path(f"gone/batch={name}"))
        size = stored.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms")).first()
        if size["n"]:
            state["gone"].append(name)
            state["n_docs"] -= size["n"]
            state["total_terms"] -= size["terms"]
        return state

    def _merged(self, state: dict) -> dict:
        """Segments of a level that has come to ``fan`` of them become one of the next level."""
        while True:
            levels: dict[int, list[dict]] = {}
            for s in state["segments"]:
                levels.setdefault(s["level"], []).append(s)
            full = next((x for _, x in sorted(levels.items()) if len(x) >= self.fan), None)
            if full is None:
                return state
            names = {s["segment"] for s in full}
            made = self._write(self.live(state).where(F.col("segment").isin(sorted(names))).drop("segment"), full[0]["level"] + 1)
            state["segments"] = [s for s in state["segments"] if s["segment"] not in names] + ([made] if made else [])

    def live(self, state: dict) -> DataFrame:
        """Documents that are there, with their ``segment``."""
        if not state["segments"]:
            return self.spark.createDataFrame([], _DOCS + ", segment string")
        rows = self._read("docs", _DOCS, [f"segment={s['segment']}" for s in state["segments"]], "segment string")
        return rows.join(self._gone(state).select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti") if state["gone"] else rows

    def _gone(self, state: dict) -> DataFrame:
        return self._read("gone", _DOCS + ", segment string", [f"batch={b}" for b in state["gone"]], "batch string")

    def _read(self, kind: str, schema: str, parts: list[str], more: str) -> DataFrame:
        root = self.files.path(kind)
        return self.spark.read.schema(f"{schema}, {more}").option("basePath", root).parquet(*[f"{root}/{p}" for p in parts])

    def blocks(self, state: dict, terms: list[str]) -> DataFrame:
        """Blocks of some terms, and the ids; only folders that may hold them are read."""
        parts = []
        for s in state["segments"]:
            own = {zlib.crc32(t.encode()) % s["buckets"] for t in [*terms, ""]}
            parts += [f"segment={s['segment']}/bucket={b}" for b in s["parts"] if b in own]
        return self._read("blocks", _BLOCKS, parts, "segment string, bucket int").where(F.col("term").isin([*terms, ""]))

    def postings(self, state: dict, terms: list[str]) -> DataFrame:
        """``term, chunk_id, source, tf, length`` of some terms in the documents that are there."""
        if not state["segments"]:
            return self.spark.createDataFrame([], "term string, chunk_id string, source string, tf long, length long")

        def opened(pdf):
            import pandas as pd

            ids = {(b["block"], k): (i, s) for b in pdf[pdf["term"] == ""].to_dict("records") for k, (i, s) in enumerate(zip(b["ids"], b["sources"], strict=True))}
            rows = []
            for b in pdf[pdf["term"] != ""].to_dict("records"):
                for doc, tf, length in _unpacked(b["postings"], b["n"]).T.tolist():
                    rows.append((b["segment"], b["term"], *ids[doc // BLOCK, doc % BLOCK], tf, length))
            return pd.DataFrame(rows, columns=["segment", "term", "chunk_id", "source", "tf", "length"])

        found = self.blocks(state, terms).groupBy("segment", "shard").applyInPandas(opened, "segment string, term string, chunk_id string, source string, tf long, length long")
        if state["gone"]:
            found = found.join(self._gone(state).select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti")
        return found.drop("segment")

    def frequencies(self, state: dict, terms: list[str]) -> dict[str, int]:
        """Documents that hold each of some terms: one row a term comes to the driver."""
        if not terms or not state["segments"]:
            return {}
        n = self.blocks(state, terms).where("term <> ''").select("term", "n")
        if state["gone"]:
            live = [s["segment"] for s in state["segments"]]
            lost = self._gone(state).where(F.col("segment").isin(live)).select(F.explode("terms.term").alias("term")).where(F.col("term").isin(terms))
            n = n.unionByName(lost.select("term", F.lit(-1).alias("n")))
        return {r["term"]: r["n"] for r in n.groupBy("term").agg(F.sum("n").alias("n")).collect() if r["n"]}

    def top_k(self, state: dict, asked: dict[int, list[str]], k: int, source: str | None = None, params: Bm25 | None = None) -> DataFrame:
        """``query_id, chunk_id, score, rank, blocks, opened`` of up to ``MOST_QUERIES`` queries, given by their terms.

        ``blocks`` counts the blocks of the query's terms, ``opened`` those unpacked.
        Longer batches are for :func:`tarn.operators.bm25.scores`, which reads all
        postings once. ``source``: only documents of it are ranked; statistics stay global.
        """
        if k < 1 or len(asked) > MOST_QUERIES:
            raise ValueError(f"top_k is positive, and queries are {MOST_QUERIES} at most")
        params = params or Bm25()
        terms = sorted({t for x in asked.values() for t in x})
        schema = "query_id long, chunk_id string, score double, rank int, blocks long, opened long"
        if not terms or not state["n_docs"]:
            return self.spark.createDataFrame([], schema)
        n, average = state["n_docs"], state["total_terms"] / state["n_docs"]
        weight = lambda d: math.log1p((n - d + 0.5) / (d + 0.5))
        if [_shards(s) for s in state["segments"]] == [1] and not state["gone"]:
            return self.blocks(state, terms).drop("bucket").coalesce(1).mapInArrow(_one_shard(asked, weight, average, params, k, source), schema)
        df = self.frequencies(state, terms)
        idf = {t: weight(d) for t, d in df.items()}
        if not idf:
            return self.spark.createDataFrame([], schema)
        queries = {q: sorted(set(x) & idf.keys()) for q, x in asked.items()}

        def search(key, table):
            return _searched(table, queries, idf, average, params, k, source)

        rows = self.blocks(state, sorted(idf)).drop("bucket").withColumn("lost", F.lit(None).cast("string"))
        if state["gone"]:
            lost = self._gone(state).where(F.col("segment").isin([s["segment"] for s in state["segments"]])).select("segment", "chunk_id")
            shards = {s["segment"]: _shards(s) for s in state["segments"]}
            of = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])
            lost = lost.select("segment", F.pmod(F.xxhash64("chunk_id"), of[F.col("segment")]).cast("int").alias("shard"), F.col("chunk_id").alias("lost"))
            rows = rows.unionByName(lost, allowMissingColumns=True)
        found = rows.groupBy("segment", "shard").applyInArrow(search, schema.replace("rank int, ", ""))
        window = Window.partitionBy("query_id")
        order = window.orderBy(F.desc("score"), "chunk_id")
        sums = [F.sum(c).over(window).alias(c) for c in ("blocks", "opened")]
        ranked = found.select("query_id", "chunk_id", "score", F.row_number().over(order).alias("rank"), *sums)
        return ranked.where((F.col("rank") <= k) & F.col("chunk_id").isNotNull())

    def clean(self, states: list[dict]) -> None:
        """Removes segments and lists that none of these states needs."""
        live = {s["segment"] for x in states for s in x["segments"]}
        for kind in ("docs", "blocks"):
            for name in self.files.folders(kind):
                if name.partition("=")[2] not in live:
                    self.files.remove(f"{kind}/{name}")
        batches = {b for x in states for b in x["gone"]}
        for name in self.files.folders("gone"):
            if name.partition("=")[2] not in batches:
                self.files.remove(f"gone/{name}")


def _shards(segment: dict) -> int:
    return segment.get("shards", -(-segment["n_docs"] // OLDER_SHARD))


def _parts(tf, length, idf, average: float, params: Bm25):
    """Steps of a score that postings add, as :func:`tarn.operators.bm25.scores` rounds them."""
    norm = params.k1 * (1 - params.b + params.b * length / average)
    return np.floor(idf * tf * (params.k1 + 1) / (tf + norm) * STEPS + 0.5).astype(np.int64)


def _one_shard(asked: dict[int, list[str]], weight, average: float, params: Bm25, k: int, source: str | None):
    """A search of the only shard there is: what a term weighs shows from its own blocks, and what is found is ranked."""

    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        df: dict[str, int] = {}
        for term, size in zip(table.column("term").to_pylist(), table.column("n").to_pylist(), strict=True):
            if term:
                df[term] = df.get(term, 0) + size
        idf = {t: weight(d) for t, d in df.items()}
        queries = {q: sorted(set(x) & idf.keys()) for q, x in asked.items()}
        found = _searched(table.append_column("lost", pa.nulls(table.num_rows, pa.string())), queries, idf, average, params, k, source)
        found = found.filter(pc.is_valid(found.column("chunk_id")))
        query, sums, rows = None, (0, 0), []
        for r in found.to_pylist():
            rank = 1 if r["query_id"] != query else rank + 1
            query, sums = r["query_id"], (r["blocks"], r["opened"]) if rank == 1 else sums
            rows.append((query, r["chunk_id"], r["score"], rank, *sums))
        types = [("query_id", pa.int64()), ("chunk_id", pa.string()), ("score", pa.float64()), ("rank", pa.int32()), ("blocks", pa.int64()), ("opened", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], schema=pa.schema(types))

    return run


def _searched(table: pa.Table, queries: dict[int, list[str]], idf: dict[str, float], average: float, params: Bm25, k: int, source: str | None) -> pa.Table:
    """Each query's best ``k`` of one shard."""
    lost = set(x for x in table.column("lost").to_pylist() if x is not None)
    names = table.select(["block", "ids", "sources"]).filter(pc.equal(table.column("term"), "")).sort_by("block")
    ids = [i for x in names.column("ids").to_pylist() for i in x]
    allowed = np.array([i not in lost for i in ids], bool)
    if source is not None:
        allowed &= np.array([s == source for x in names.column("sources").to_pylist() for s in x], bool)
    own = table.filter(pc.not_equal(table.column("term"), ""))
    bounds = _bounds(own, idf, average, params)
    by_term: dict[str, list[dict]] = {}
    for r, bound in sorted(zip(own.select(["term", "block", "n", "first", "last", "postings"]).to_pylist(), bounds, strict=True), key=lambda x: x[0]["block"]):
        r["bound"] = bound
        by_term.setdefault(r["term"], []).append(r)
    opened: dict[int, tuple] = {}
    out = []
    for query, terms in queries.items():
        hits, n_open, n_all = _best([by_term[t] for t in terms if t in by_term], allowed, idf, average, params, k, opened)
        counts = [(n_all, n_open)] + [(0, 0)] * max(0, len(hits) - 1)
        out += [(query, ids[d], s / STEPS, *c) for (s, d), c in zip(hits, counts, strict=False)] or ([(query, None, None, n_all, n_open)] if n_all else [])
    types = [("query_id", pa.int64()), ("chunk_id", pa.string()), ("score", pa.float64()), ("blocks", pa.int64()), ("opened", pa.int64())]
    return pa.table([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(types)], schema=pa.schema(types))


def _bounds(blocks: pa.Table, idf: dict[str, float], average: float, params: Bm25) -> list[int]:
    """The highest steps that a posting of each block has, from its pairs, without an object for each."""
    if not blocks.num_rows:
        return []
    best = pa.concat_arrays(blocks.column("best").chunks)
    sizes = pc.list_value_length(best).to_numpy()
    tf, length = (c.to_numpy() for c in best.flatten().flatten())
    weight = np.repeat([idf[t] for t in blocks.column("term").to_pylist()], sizes)
    return np.maximum.reduceat(_parts(tf, length, weight, average, params), np.cumsum(sizes) - sizes).tolist()


def _best(lists: list[list[dict]], allowed: np.ndarray, idf, average, params, k: int, opened: dict) -> tuple[list[tuple[int, int]], int, int]:
    """(steps, document) of the best ``k``; how many blocks were unpacked, and of how many.

    Windows of documents are taken by their bound: of each term the highest one of its
    blocks there, summed. A window whose bound is under the kth score can't change the
    result, nor can any after it.
    """
    inside: dict[int, list[dict]] = {}
    bound: dict[int, int] = {}
    for blocks in lists:
        highest: dict[int, int] = {}
        for b in blocks:
            for w in range(b["first"] // WINDOW, b["last"] // WINDOW + 1):
                inside.setdefault(w, []).append(b)
                highest[w] = max(highest.get(w, 0), b["bound"])
        for w, x in highest.items():
            bound[w] = bound.get(w, 0) + x
    touched: set[int] = set()
    best_score, best_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for w in sorted(bound, key=lambda w: (-bound[w], w)):
        if len(best_score) == k and bound[w] < best_score[-1]:
            break
        low = w * WINDOW
        score = np.full(WINDOW, -1, np.int64)
        for b in inside[w]:
            if id(b) not in opened:
                doc, tf, length = _unpacked(b["postings"], b["n"])
                opened[id(b)] = doc.astype(np.int32), _parts(tf, length, idf[b["term"]], average, params)  # no view of what was unpacked
            touched.add(id(b))
            doc, parts = opened[id(b)]
            i, m = np.searchsorted(doc, (low, low + WINDOW))
            at = doc[i:m] - low
            score[at] = np.maximum(score[at], 0) + parts[i:m]
        own = np.flatnonzero((score >= 0)[: len(allowed) - low] & allowed[low : low + WINDOW])
        if len(own):
            best_score, best_doc = np.concatenate([best_score, score[own]]), np.concatenate([best_doc, own + low])
            order = np.lexsort((best_doc, -best_score))[:k]
            best_score, best_doc = best_score[order], best_doc[order]
    return list(zip(best_score.tolist(), best_doc.tolist(), strict=True)), len(touched), sum(map(len, lists))
