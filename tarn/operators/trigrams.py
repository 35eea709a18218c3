"""A trigram index that keeps patterns from texts that can't match.

Texts are taken in blocks of some megabytes. Of each block, every trigram of code points
(of the case-folded text) has one row with the numbers of the documents that hold it. A
pattern becomes an and/or of trigrams that each of its matches must hold; documents
that satisfy it are looked at by :mod:`tarn.operators.exact`, and no others. Results are
those of a full scan: the index only proposes.

An index grows by blocks: :meth:`TrigramIndex.add` writes those of new or changed
documents. Blocks of old texts propose documents in vain at worst.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from re import _constants as kinds
from re import _parser as syntax

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import exact
from tarn.sources.files import Files

#: Characters and documents of a block, folders that trigrams are dealt into, and trigrams that a pattern asks for at most.
BLOCK_CHARS, BLOCK_DOCS, BUCKETS, MOST = 4_000_000, 8192, 64, 64

#: A formula: ("tri", code), ("and", parts) or ("or", parts); None holds for any text.
Formula = tuple | None


def codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text's folded form, as 63-bit numbers, ascending."""
    points = np.frombuffer(text.casefold().encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:]) if len(points) > 2 else np.zeros(0, np.int64)


def _all(parts: list[Formula]) -> Formula:
    own = [p for p in parts if p is not None]
    return None if not own else own[0] if len(own) == 1 else ("and", own)


def _of_literal(literal: str) -> Formula:
    return _all([("tri", int(c)) for c in codes(literal)])


def formula(pattern: str, ignore_case: bool = False) -> Formula:
    """Trigrams that every match of a pattern holds; None if nothing can be said.

    Only what is plain is used: runs of literals, groups, branches and repeats that occur
    at least once. What the two readers of patterns might take differently asks for
    nothing. Where case is folded, only ASCII letters count, which fold alike everywhere.
    """
    if "[:" in pattern or "[[" in pattern:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = syntax.parse(pattern)
    except Exception:  # RE2 has syntax of its own
        return None

    def walk(items, fold: bool) -> Formula:
        parts, run = [], []

        def close():
            parts.append(_of_literal("".join(run)))
            run.clear()

        for kind, value in items:
            if kind is kinds.LITERAL and (not fold or value < 128):
                run.append(chr(value))
                continue
            close()
            if kind is kinds.SUBPATTERN:
                _, added, dropped, inner = value
                parts.append(walk(inner, (fold or bool(added & syntax.SRE_FLAG_IGNORECASE)) and not dropped & syntax.SRE_FLAG_IGNORECASE))
            elif kind is kinds.BRANCH:
                arms = [walk(arm, fold) for arm in value[1]]
                parts.append(None if None in arms else ("or", arms))
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
                parts.append(walk(value[2], fold))
        close()
        return _all(parts)

    return _bounded(walk(tree, ignore_case or bool(tree.state.flags & syntax.SRE_FLAG_IGNORECASE)))


def trigrams_of(asked: Formula) -> list[int]:
    if asked is None:
        return []
    return [asked[1]] if asked[0] == "tri" else sorted({c for part in asked[1] for c in trigrams_of(part)})


def _bounded(asked: Formula) -> Formula:
    """The same or a weaker formula of at most ``MOST`` trigrams; parts of an "and" may go, of an "or" none."""
    if asked is None or len(trigrams_of(asked)) <= MOST:
        return asked
    if asked[0] == "or":
        return None
    kept, room = [], MOST
    for part in sorted(asked[1], key=lambda p: len(trigrams_of(p))):
        room -= len(trigrams_of(part))
        if room >= 0:
            kept.append(part)
    return _all(kept)


def _holders(asked: tuple, held: Column) -> Column:
    """Numbers of the documents of a block that satisfy a formula; ``held``: trigram -> numbers."""
    if asked[0] == "tri":
        return F.coalesce(F.element_at(held, F.lit(asked[1]).cast("long")), F.array().cast("array<int>"))
    first, *rest = [_holders(part, held) for part in asked[1]]
    for other in rest:
        first = F.array_intersect(first, other) if asked[0] == "and" else F.array_union(first, other)
    return first


class TrigramIndex:
    """``blocks`` (ids of documents) and ``postings`` (by bucket of trigram) under one folder of any store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, str(root))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Writes blocks of documents. Repeated rows and ids are fine; null texts hold nothing.

        Postings are dealt by trigram and block, so a trigram that most blocks hold is
        written by many tasks.
        """
        kind = docs.schema[id_col].dataType.simpleString()
        stage = f"staged-{np.random.default_rng().integers(1 << 62):x}"
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        found = rows.mapInArrow(_blocks, f"ids array<{kind}>, terms array<struct<trigram:long,docs:array<int>>>")
        found.select(F.expr("uuid()").alias("block"), "ids", "terms").write.parquet(self.files.path(stage))
        staged = self.spark.read.parquet(self.files.path(stage))
        each = staged.select("block", F.inline("terms")).withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int"))
        # postings before the ids that make them count
        each.repartitionByRange("bucket", "trigram", "block").sortWithinPartitions("bucket", "trigram").write.mode("append").partitionBy("bucket").parquet(self.files.path("postings"))
        staged.select("block", "ids").write.mode("append").parquet(self.files.path("blocks"))
        self.files.remove(stage)

    def candidates(self, asked: tuple, id_col: str = "doc_id") -> DataFrame:
        """Distinct ids of documents that satisfy a formula; reads its trigrams' buckets only."""
        wanted = trigrams_of(asked)
        own = self.spark.createDataFrame([(c,) for c in wanted], "trigram long").select(F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int").alias("b"))
        buckets = sorted({r["b"] for r in own.collect()})  # of MOST trigrams
        rows = self.spark.read.schema("block string, trigram long, docs array<int>, bucket int").parquet(self.files.path("postings"))
        own = rows.where(F.col("bucket").isin(buckets) & F.col("trigram").isin(wanted))
        held = own.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("held"))
        hits = held.select("block", _holders(asked, F.col("held")).alias("hits")).where(F.size("hits") > 0)
        blocks = self.spark.read.parquet(self.files.path("blocks"))
        named = hits.join(blocks, "block").select(F.explode(F.transform("hits", lambda i: F.get("ids", i))).alias(id_col))
        return named.distinct()

    def narrowed(self, docs: DataFrame, pattern: str, ignore_case: bool = False, id_col: str = "doc_id") -> DataFrame:
        """Documents that may match; all of them if the pattern asks for no trigram."""
        asked = formula(pattern, ignore_case)
        return docs if asked is None else docs.join(self.candidates(asked, id_col), id_col, "left_semi")

    def documents(self, docs: DataFrame, pattern: str, ignore_case: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """As :func:`exact.pattern_documents`. All ``docs`` must have been added with their texts; rows without an id are not found."""
        exact.compiled(pattern, ignore_case)
        return exact.pattern_documents(self.narrowed(docs, pattern, ignore_case, id_col), pattern, text_col, ignore_case)

    def matches(self, docs: DataFrame, pattern: str, ignore_case: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        """As :func:`exact.pattern_matches` for a pattern that matches no empty text."""
        run = exact.compiled(pattern, ignore_case)
        if pc.match_substring_regex(pa.array([""]), pattern=run)[0].as_py():
            return exact.pattern_matches(docs, pattern, text_col, id_col, ignore_case, keep)
        return exact.pattern_matches(self.narrowed(docs, pattern, ignore_case, id_col), pattern, text_col, id_col, ignore_case, keep)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of the rows of a task."""
    ids, terms, chars = [], [], 0

    def block() -> pa.RecordBatch:
        sizes = [len(t) for t in terms]
        every, numbers = np.concatenate(terms), np.repeat(np.arange(len(terms), dtype=np.int32), sizes)
        order = np.argsort(every, kind="stable")
        every, numbers = every[order], numbers[order]
        distinct, starts = np.unique(every, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(every)), pa.int32()), pa.array(numbers))
        cells = pa.StructArray.from_arrays([pa.array(distinct), lists], ["trigram", "docs"])
        names = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), cells)],
            ["ids", "terms"],
        )

    for batch in batches:
        for row in range(batch.num_rows):
            text = batch["text"][row].as_py()
            ids.append(batch["id"].slice(row, 1))
            terms.append(codes(text))
            chars += len(text)
            if chars >= BLOCK_CHARS or len(terms) >= BLOCK_DOCS:
                yield block()
                ids, terms, chars = [], [], 0
    if terms:
        yield block()
