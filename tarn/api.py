"""The engine as one object: index notes, then match, search, read and ask.

Every call makes one plan; rankings of many queries at once come from the
operators themselves, of which these are thin wrappers for single ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.text import exact_terms, identity, python_terms, title_and_body
from tarn.operators import agent, bm25, chunking, exact, fusion, graph, lifecycle, vector
from tarn.sources import notes as note_source

MODES = ("bm25", "lexical", "semantic", "hybrid")


@dataclass(frozen=True)
class Settings:
    size: int = 512
    overlap: int = 64
    k1: float = 1.2
    b: float = 0.75
    candidates: int = 20
    rrf_k: int = 60
    #: Neighbour graphs over a snapshot's vectors; None builds none.
    neighbours: graph.GraphConfig | None = None
    instruction: str = "Given a question, find the passages that answer it"


@dataclass
class Engine:
    """``notes``: a folder of Markdown files; ``root``: where snapshots are kept.

    A snapshot remembers its folder. Without ``notes`` that one is taken; live notes of
    another folder than that of the active snapshot are refused, as hits in them would
    not be those of the index. :meth:`index` may turn to another folder.

    ``embedder`` gives one vector for each text; without it only lexical modes work.
    """

    spark: SparkSession
    notes: str | None
    root: str
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    scorer: Callable | None = None
    count: Callable[[str], int] = len
    settings: Settings = field(default_factory=Settings)
    #: What kind of vectors ``embedder`` makes; a snapshot of another kind is refused.
    spec: vector.EmbeddingSpec | None = None

    @property
    def store(self) -> lifecycle.Store:
        return lifecycle.Store(self.spark, self.root)

    def live(self, source: str | None = None) -> DataFrame:
        """Notes as they are now, or the one named, with identities; no other file is opened for one."""
        return lifecycle.with_revisions(note_source.load_notes(self.spark, self._folder(), source))

    def _folder(self, anew: bool = False) -> str:
        """The folder of live notes; ``anew``: it need not be that of the active snapshot."""
        active = self.store.active()
        saved = json.loads(active["config"]).get("notes") if active else None
        if self.notes is None and saved is None:
            raise ValueError("no folder of notes is given, and none was indexed")
        if self.notes is not None and saved is not None and not anew and note_source.place(self.notes) != saved:
            raise ValueError("the notes are not those of the active snapshot: give its folder, or another root")
        return saved if self.notes is None else self.notes

    def _records(self, notes: DataFrame) -> DataFrame:
        chunks = chunking.chunk_notes(notes, self.count, self.settings.size, self.settings.overlap)
        own = chunks.join(notes.select("source", "doc_id", "document_revision"), "source")
        chunk_id = identity("chunk", F.col("section_id"), F.col("content"), F.col("occurrence"))
        text = chunking.prepared_document(F.col("title"), F.col("content"))
        return own.withColumns({"chunk_id": chunk_id, "embedding_key": F.sha2(text, 256), "text": text})

    def index(self, force: bool = False) -> dict:
        """Builds a new snapshot, or keeps the active one if nothing changed."""
        folder = self._folder(anew=True)
        notes = note_source.stable_notes(self.spark, folder)
        records = self._records(lifecycle.with_revisions(notes)).persist()
        config = {"notes": note_source.place(folder), "size": self.settings.size, "overlap": self.settings.overlap, "embedded": self.embedder is not None, "spec": self._kind(), "neighbours": repr(self.settings.neighbours)}
        text = title_and_body(F.col("title"), F.col("content"))
        tokens = bm25.tokenised(records, text, exact_terms).select("chunk_id", "source", "terms", "length")
        try:
            return self.store.build(records, self._embed, config, force, tokens, self.settings.neighbours if self.embedder else None)
        finally:
            records.unpersist()
            notes.unpersist()

    def _kind(self) -> str | None:
        return self.spec.fingerprint if self.spec is not None else None

    def _embed(self, lacking: DataFrame) -> DataFrame:
        if self.embedder is None:
            return lacking.withColumn("embedding", F.array().cast("array<double>"))
        return chunking.embed(lacking, self.embedder, "text", self.count)

    def status(self) -> dict:
        return self.store.status()

    def match(self, query: str, regex: bool = False, ignore_case: bool = False, target: str = "content", source: str | None = None, top_k: int = 5) -> DataFrame:
        """Literal or pattern matches in live notes, by source and place; needs no index."""
        if not query.strip() or top_k < 1 or target not in ("content", "source"):
            raise ValueError("a match needs a query, a positive top_k and a known target")
        docs = self.live(source)
        if target == "source":
            return exact.source_matches(docs, query).orderBy("source").limit(top_k)
        find = exact.pattern_matches if regex else exact.literal_matches
        spans = find(docs, query, text_col="content", ignore_case=ignore_case, keep=["source", "title", "document_revision", "content"])
        cut = F.substring(F.col("content"), F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int"))
        return exact.first_matches(spans.withColumn("content", cut), top_k)

    def search(self, query: str, mode: str = "hybrid", rerank: bool = False, source: str | None = None, top_k: int = 10, ef_search: int | None = None) -> DataFrame:
        """Ranked chunks of the active snapshot; the mode is never replaced by another.

        With ``ef_search`` the semantic leg goes through the snapshot's neighbour graphs
        with a beam of so many; a search under a ``source`` filter is always exact.
        """
        if mode not in MODES or not query.strip() or top_k < 1:
            raise ValueError(f"a search needs a query, a positive top_k and one of {MODES}")
        s, store = self.settings, self.store
        active = store.active()
        chunks = store.records()
        depth = max(top_k, s.candidates) if rerank or mode == "hybrid" else top_k
        keep = None if source is None else F.col("source") == source
        legs = {}
        if mode in ("bm25", "lexical", "hybrid"):
            legs["bm25"] = self._lexical(query, active, source, depth)
        if mode in ("semantic", "hybrid"):
            if self.embedder is None:
                raise ValueError("this engine has no embedder")
            if json.loads(active["config"])["spec"] != self._kind():
                raise ValueError("the snapshot's vectors are of another kind")
            (v,) = self.embedder([chunking.prepared_text(s.instruction, query)])
            v = list(map(float, v))
            legs["semantic"] = self._semantic(v, chunks, keep, depth) if ef_search is None or keep is not None else self._near(v, active, depth, ef_search)
        if mode == "hybrid":
            pinned = {name: leg.withColumn("index_id", F.lit(active["version"])) for name, leg in legs.items()}
            hits = fusion.hybrid(pinned, depth, s.rrf_k, depth, id_col="chunk_id", index_col="index_id").drop("votes")
        else:
            hits = legs.get("bm25", legs.get("semantic"))
        rows = vector.backed(hits, chunks, "chunk_id")
        if rerank:
            if self.scorer is None:
                raise ValueError("this engine has no scorer")
            rows = fusion.rerank(rows, fusion.scorer(self.scorer)(F.lit(query), F.col("content")), id_col="chunk_id")
        method = ("bm25" if mode == "lexical" else mode) + ("+rerank" if rerank else "")
        return rows.where(F.col("rank") <= top_k).withColumn("method", F.lit(method)).orderBy("rank")

    def _lexical(self, query: str, active: dict, source: str | None, k: int) -> DataFrame:
        """From the blocks that the snapshot's index holds; only the query's terms are read."""
        params = bm25.Bm25(self.settings.k1, self.settings.b)
        found = self.store.segments.top_k(self.store.index(active["version"]), {0: python_terms(query)}, k, source, params)
        return found.select("query_id", "chunk_id", "score", "rank")

    def _semantic(self, v: list[float], chunks: DataFrame, keep, k: int) -> DataFrame:
        rows = chunks if keep is None else chunks.where(keep)
        query = F.array(*[F.lit(x) for x in v])
        vectors = self.store.vectors().dropDuplicates(["embedding_key"])
        scored = rows.join(vectors, "embedding_key").withColumn("score", F.round(vector.cosine(F.col("embedding"), query), vector.DIGITS))
        best = scored.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", "score").where("score IS NOT NULL").orderBy(F.desc("score"), "chunk_id").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))

    def _near(self, v: list[float], active: dict, k: int, ef_search: int) -> DataFrame:
        graphs = self.store.graphs(active["version"])
        if graphs is None:
            raise ValueError("the snapshot has no neighbour graphs")
        asked = self.spark.createDataFrame([(0, v)], "query_id long, query_vector array<double>")
        return graph.top_k(asked, graphs, k, ef_search, id_col="chunk_id").drop("n_scored")

    def read(self, source: str, start: int | None = None, end: int | None = None, section_id: str | None = None) -> dict:
        """A live note, or part of it."""
        sections = self._records(self.live(source)) if section_id is not None else None
        return note_source.read_part(self.live(source), source=source, start=start, end=end, section_id=section_id, sections=sections)

    def ask(self, question: str, chat: Callable[[list[dict]], dict], max_turns: int = 8, caps: dict[str, int] | None = None, deadline_s: float | None = None) -> agent.Run:
        """A bounded run of a model with the three tools over this engine."""
        keep = ("source", "chunk_id", "content", "start_char", "end_char", "score", "rank")

        def rows(df):
            return [{k: v for k, v in r.asDict().items() if k in keep} for r in df.collect()]

        tools = {"match": lambda **a: rows(self.match(**a)), "search": lambda **a: rows(self.search(**a)), "read": lambda **a: [self.read(**a)]}
        return agent.run_agent(question, chat, tools, max_turns, caps, deadline_s)
