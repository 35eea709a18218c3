"""Versioned snapshots of chunks, vectors and postings, kept as Parquet.

A build is written beside the active version, read back and verified, and becomes
active by one more entry of a numbered log. An entry is written only if its number is
free and its writer still holds the lock, so a failed build never replaces what is
served, and a writer whose lease has lapsed can't publish over another's work.
Everything lies in one folder of any store that Spark reaches.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import identity
from tarn.operators import graph
from tarn.operators.segments import Segments, counted
from tarn.sources.files import Files


def with_revisions(notes: DataFrame) -> DataFrame:
    """Adds ``doc_id`` (of the path) and ``document_revision`` (of title and content)."""
    return notes.withColumns({"doc_id": identity("note", F.col("source")), "document_revision": identity("revision", F.col("title"), F.col("content"))})


def changes(before: DataFrame, after: DataFrame, key: str = "source", revision: str = "document_revision") -> DataFrame:
    """``<key>, change``: added, deleted, modified or unchanged."""
    a = before.select(key, F.col(revision).alias("_a"), F.lit(1).alias("_in_a"))
    b = after.select(key, F.col(revision).alias("_b"), F.lit(1).alias("_in_b"))
    rows = a.join(b, key, "full")
    kind = (
        F.when(F.col("_in_a").isNull(), "added")
        .when(F.col("_in_b").isNull(), "deleted")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged")
        .otherwise("modified")
    )
    return rows.select(key, kind.alias("change"))


def missing_embeddings(chunks: DataFrame, cache: DataFrame, key: str = "embedding_key") -> DataFrame:
    """Each distinct text without a vector in the cache, once."""
    return chunks.dropDuplicates([key]).join(cache.select(key).distinct(), key, "left_anti")


def revision_conflicts(records: DataFrame) -> DataFrame:
    """Documents with several revisions in one snapshot."""
    return records.groupBy("doc_id").agg(F.count_distinct("document_revision").alias("revisions")).where("revisions > 1")


def repeated_ids(records: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return records.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def corpus_fingerprint(records: DataFrame, columns: list[str]) -> DataFrame:
    """One row that changes if any record does, whatever their order: ``records, fingerprint``."""
    digest = F.xxhash64(*[F.col(c) for c in columns])
    return records.agg(F.count("*").alias("records"), F.concat_ws("-", F.bit_xor(digest), F.sum(F.pmod(digest, F.lit(1 << 31)))).alias("fingerprint"))


def verify_vectors(stored: DataFrame, expected: DataFrame, key: str = "embedding_key", tolerance: float = 1e-6) -> DataFrame:
    """``<key>, problem``: missing, foreign or different vectors."""
    a = expected.select(key, F.col("embedding").alias("_a"))
    b = stored.select(key, F.col("embedding").alias("_b"))
    far = F.exists(F.zip_with("_a", "_b", lambda x, y: F.coalesce(F.abs(x - y) > tolerance + 1e-5 * F.abs(y), F.lit(True))), lambda v: v)
    rows = a.join(b, key, "full")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "foreign").when(far, "different")
    return rows.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def cache_problems(keys: DataFrame, vectors: DataFrame, key: str = "embedding_key") -> DataFrame:
    """``<key>, problem``: texts whose stored vector is missing, ambiguous, not finite, zero, or of another size.

    The size that most vectors have is the right one. Vectors without components
    (of an engine that has no model) are fine as long as all are.
    """
    own = keys.select(key).distinct().join(vectors.select(key, "embedding").distinct(), key, "left")
    sizes = own.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count()
    usual = F.broadcast(sizes.agg(F.max_by("n", "count").alias("_usual")))  # one row
    found = own.groupBy(key).agg(F.count("embedding").alias("n"), F.first("embedding", ignorenulls=True).alias("embedding")).crossJoin(usual)
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = (
        F.when(F.col("n") == 0, "missing")
        .when(F.col("n") > 1, "ambiguous")
        .when(F.size(e) != F.col("_usual"), "size")
        .when(odd, "not_finite")
        .when((F.size(e) > 0) & F.forall(e, lambda x: x == 0), "zero")
    )
    return found.select(key, problem.alias("problem")).where("problem IS NOT NULL")


class Store:
    """Snapshots of one vault: ``chunks``, ``graphs`` and ``manifests`` by version, ``vectors``, a text ``index``, a ``log``."""

    def __init__(self, spark: SparkSession, root: str, lease_s: float = 6 * 3600):
        self.spark, self.files, self.lease_s = spark, Files(spark, str(root)), lease_s
        self._token: str | None = None

    @contextlib.contextmanager
    def writer(self):
        """One writer at a time. A lock whose lease has run out belongs to a dead process and is taken over.

        Should that process live after all, it can't publish any more (:meth:`_commit`).
        """
        own = {"token": uuid.uuid4().hex, "until": time.time() + self.lease_s}
        data = json.dumps(own).encode()
        if not self.files.create("writer.lock", data):
            if self._lock()["until"] > time.time():
                raise RuntimeError("another writer holds the store")
            self.files.remove("writer.lock")
            if not self.files.create("writer.lock", data):
                raise RuntimeError("another writer holds the store")
        if self._lock()["token"] != own["token"]:  # a store may let two create one file
            raise RuntimeError("another writer holds the store")
        self._token = own["token"]
        try:
            yield
        finally:
            self._token = None
            if self._lock()["token"] == own["token"]:
                self.files.remove("writer.lock")

    def _renew(self) -> None:
        """A new lease for the writer at work; raises if another has taken the lock over."""
        if self._lock()["token"] != self._token:
            raise RuntimeError("another writer has taken the store over")
        self._put("writer.lock", {"token": self._token, "until": time.time() + self.lease_s})

    def _commit(self, base: int, entry: dict) -> int:
        """Writes the log's entry after ``base``, by the lock's holder and if no other has come in between."""
        self._renew()
        if not self.files.publish(f"log/{base + 1:012d}.json", json.dumps(entry, sort_keys=True).encode()):
            raise RuntimeError("another writer has published meanwhile")
        return base + 1

    def head(self) -> tuple[int, dict]:
        """Number and content of the log's last entry; 0 and nothing before the first."""
        names = self.files.names("log", ".json")
        return (int(names[-1][:-5]), json.loads(self.files.read(f"log/{names[-1]}"))) if names else (0, {})

    def _lock(self) -> dict:
        try:
            return json.loads(self.files.read("writer.lock"))
        except Exception:  # gone, or not whole yet
            return {"token": None, "until": time.time() + 1}

    def _put(self, name: str, value: dict) -> None:
        self.files.replace(name, json.dumps(value, sort_keys=True).encode())

    def manifest(self, version: str) -> dict:
        return json.loads(self.files.read(f"manifests/{version}.json"))

    def manifests(self) -> list[dict]:
        return [json.loads(self.files.read(f"manifests/{n}")) for n in self.files.names("manifests", ".json")]

    def active(self) -> dict | None:
        """The manifest that queries use; None before the first build."""
        version = self.head()[1].get("version")
        return self.manifest(version) if version else None

    def _ready(self, version: str | None) -> dict:
        found = self.active() if version is None else self.manifest(version)
        if found is None or found["status"] != "ready":
            raise ValueError("no ready snapshot")
        return found

    def _table(self, kind: str, version: str) -> str:
        return self.files.path(f"{kind}/version={version}")

    def records(self, version: str | None = None) -> DataFrame:
        """Records of a ready version as they were published, without a look at the whole of it."""
        return self.spark.read.parquet(self._table("chunks", self._ready(version)["version"]))

    def chunks(self, version: str | None = None) -> DataFrame:
        """Records of a ready version; their number, ids and revisions are checked."""
        rows, found = self.records(version), self._ready(version)
        if rows.count() != found["chunks"]:
            raise ValueError("the snapshot is not whole")
        if revision_conflicts(rows).limit(1).count() or repeated_ids(rows).limit(1).count():
            raise ValueError("a document has two revisions or a chunk id occurs twice")
        return rows

    def scan(self, version: str | None = None) -> DataFrame:
        """Checked records in the order of their documents' paths and places."""
        return self.chunks(version).orderBy("source", "chunk_index")

    def record(self, version: str, chunk_id: str) -> DataFrame:
        return self.records(version).where(F.col("chunk_id") == chunk_id)

    def _vectors(self) -> str:
        """The folder of vectors that the log names; compaction begins a new one."""
        return self.head()[1].get("vectors", "vectors")

    def vectors(self) -> DataFrame:
        if not self.files.exists(self._vectors()):
            return self.spark.createDataFrame([], "embedding_key string, embedding array<double>")
        return self.spark.read.schema("embedding_key string, embedding array<double>").parquet(self.files.path(self._vectors()))

    def loaded(self, version: str | None = None) -> DataFrame:
        """Records with their vectors, one each; a text without a proper vector raises."""
        rows = self.chunks(version)
        self._verify(rows)
        return rows.join(self.vectors().dropDuplicates(["embedding_key"]), "embedding_key")

    @property
    def segments(self) -> Segments:
        """The text index, whose segments versions share."""
        return Segments(self.spark, self.files.path("index"))

    def index(self, version: str | None = None) -> dict:
        """The state of a ready version's text index (see :class:`Segments`)."""
        found = self._ready(version)
        if "index" not in found:
            raise ValueError("the snapshot was built without an index")
        return found["index"]

    def postings(self, terms: list[str], version: str | None = None) -> DataFrame:
        """``term, chunk_id, source, tf, length`` of some terms: only their buckets are read."""
        return self.segments.postings(self.index(version), terms)

    def graphs(self, version: str | None = None) -> DataFrame | None:
        """The neighbour graphs of a ready version's vectors by chunk; None if it was built without."""
        found = self._ready(version)
        if not found.get("graph"):
            return None
        return self.spark.read.schema(graph.GRAPH.format(id="string")).parquet(self._table("graphs", found["version"]))

    def status(self) -> dict:
        """From saved metadata alone."""
        found = self.active()
        return {"active": found, "builds": [{k: m[k] for k in ("version", "status")} for m in self.manifests()]}

    def _verify(self, rows: DataFrame) -> None:
        bad = cache_problems(rows, self.vectors()).limit(1).collect()
        if bad:
            raise ValueError(f"a stored vector is {bad[0]['problem']}: {bad[0]['embedding_key']}")

    def build(self, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], config: dict, force: bool = False, tokens: DataFrame | None = None, neighbours: graph.GraphConfig | None = None) -> dict:
        """A new version, or the active one if neither corpus nor configuration changed.

        ``chunks``: ``chunk_id, doc_id, source, document_revision, content,
        embedding_key`` and more. ``embed`` adds ``embedding`` to the texts that the
        cache lacks. ``tokens``: ``chunk_id, source, terms, length``; those of chunks that
        the active version's index lacks become a segment of it; ``neighbours``: how to build graphs over the vectors, if at all. What is stored is read back and verified before it is published,
        and before an active version is kept. The result says what was added,
        modified and deleted.
        """
        with self.writer():
            self.recover()
            base, last = self.head()
            if revision_conflicts(chunks).limit(1).count() or repeated_ids(chunks).limit(1).count():
                raise ValueError("a document has two revisions or a chunk id occurs twice")
            mark = corpus_fingerprint(chunks, ["chunk_id", "document_revision", "content"]).first()
            identity_ = {"corpus": mark["fingerprint"], "config": json.dumps(config, sort_keys=True)}
            before = self.active()
            if before and not force and all(before[k] == v for k, v in identity_.items()):
                self._verify(self.chunks(before["version"]))
                return {**before, "reused": True}
            version = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
            name = f"manifests/{version}.json"
            made = {"version": version, "status": "building", "chunks": mark["records"], **identity_}
            self._put(name, made)
            try:
                docs = chunks.select("source", "document_revision").distinct()
                old = self.records(before["version"]).select("source", "document_revision").distinct() if before else docs.limit(0)
                made["changes"] = {r["change"]: r["n"] for r in changes(old, docs).groupBy("change").agg(F.count("*").alias("n")).collect()}
                fresh = embed(missing_embeddings(chunks, self.vectors())).select("embedding_key", F.col("embedding").cast("array<double>").alias("embedding"))
                fresh.write.mode("append").parquet(self.files.path(self._vectors()))
                self._renew()
                chunks.write.parquet(self._table("chunks", version))
                if tokens is not None:
                    made["index"] = self._index(chunks, tokens, before.get("index") if before else None)
                self._renew()
                self._verify_published(chunks, version)
                if neighbours is not None:
                    rows = self.spark.read.parquet(self._table("chunks", version)).select("chunk_id", "embedding_key")
                    rows = rows.join(self.vectors().dropDuplicates(["embedding_key"]), "embedding_key").where(F.size("embedding") > 0)
                    graph.build(rows, neighbours, "chunk_id").write.parquet(self._table("graphs", version))
                    made["graph"] = {"m": neighbours.m, "ef_construct": neighbours.ef_construct}
                self._renew()
                made["status"] = "ready"
                self._put(name, made)
                self._commit(base, {**last, "version": version})
            except BaseException:
                self._put(name, {**made, "status": "failed"})
                raise
            return {**made, "reused": False}

    def _verify_published(self, chunks: DataFrame, version: str) -> None:
        """What lies in the store is what was to be stored, and every text has its vector."""
        stored, columns = self.spark.read.parquet(self._table("chunks", version)), ["chunk_id", "document_revision", "content"]
        if corpus_fingerprint(stored, columns).first() != corpus_fingerprint(chunks, columns).first():
            raise ValueError("the stored chunks differ from those to be stored")
        self._verify(stored)

    def _index(self, chunks: DataFrame, tokens: DataFrame, state: dict | None) -> dict:
        """The index after this build: only chunks that are new or gone are tokenised and written."""
        mark = F.sha2(F.concat_ws("\u0001", "document_revision", "content"), 256).alias("mark")
        marks = chunks.select("chunk_id", "source", mark)
        if not state:
            return self.segments.update(None, counted(tokens.join(marks.select("chunk_id", "mark"), "chunk_id")))
        added, removed = self.segments.difference(state, marks)
        fresh = tokens.join(marks.select("chunk_id", "mark"), "chunk_id").join(added, "chunk_id", "left_semi")
        return self.segments.update(state, counted(fresh), removed)

    def recover(self) -> None:
        """Marks builds that a crash left unfinished as failed."""
        for m in self.manifests():
            if m["status"] == "building":
                self._put(f"manifests/{m['version']}.json", {**m, "status": "failed"})

    def expire(self, keep: int = 1) -> list[str]:
        """Gives up ready versions but the active one and the ``keep - 1`` newest others; returns theirs."""
        if keep < 1:
            raise ValueError("the active version stays")
        with self.writer():
            active = self.head()[1].get("version")
            ready = [m for m in self.manifests() if m["status"] == "ready" and m["version"] != active]
            gone = ready[: max(0, len(ready) - (keep - 1))]
            for m in gone:
                self._put(f"manifests/{m['version']}.json", {**m, "status": "expired"})
            return [m["version"] for m in gone]

    def compact(self) -> dict:
        """Rewrites the vectors: those of ready versions' texts, equal rows of one text once.

        Two vectors of one text both stay, as that is an error which builds report. What
        is read is replaced by one entry of the log; the old files go with :meth:`cleanup`.
        """
        with self.writer():
            base, last = self.head()
            if not last:
                raise ValueError("no ready snapshot")
            ready = [self._table("chunks", m["version"]) for m in self.manifests() if m["status"] == "ready"]
            used = self.spark.read.schema("embedding_key string").parquet(*ready).distinct()
            fresh = f"vectors-{base + 1:012d}-{uuid.uuid4().hex[:8]}"
            self.vectors().join(used, "embedding_key", "left_semi").distinct().write.parquet(self.files.path(fresh))
            self._commit(base, {**last, "vectors": fresh})
            return {"vectors": fresh, "bytes_before": self.files.size(last.get("vectors", "vectors")), "bytes_after": self.files.size(fresh)}

    def cleanup(self) -> list[str]:
        """Removes tables of failed and expired builds, vectors given up, and old entries of the log; returns these builds' versions."""
        with self.writer():
            number, last = self.head()
            gone = [m["version"] for m in self.manifests() if m["status"] in ("failed", "expired")]
            for version in gone:
                for kind in ("chunks", "graphs"):
                    self.files.remove(f"{kind}/version={version}")
                self.files.remove(f"manifests/{version}.json")
            self.segments.clean([m["index"] for m in self.manifests() if "index" in m])
            for folder in self.files.folders(""):
                if folder.startswith("vectors") and folder != last.get("vectors", "vectors"):
                    self.files.remove(folder)
            for entry in self.files.names("log", ".json"):
                if int(entry[:-5]) < number:
                    self.files.remove(f"log/{entry}")
            return gone
