"""Best-fit packing (operator 8): vector best fit over several capacities.

A bin (a training sequence) has three capacities: tokens, documents and
attention cost (the sum of squared lengths). Pieces are taken by falling
length; each goes to the open bin with the best score among those that can
hold it in every dimension, or to a new bin. The score is the norm of the
residual after placing, or the weighted dot product of demand and residual
before it; the smallest wins.

Pieces of one length are alike, so the plan needs their counts only: at most
``capacity.tokens`` numbers reach the driver, however many pieces there are.
Bins in the same state are kept as one group with a multiplicity, so the plan
is the same as that of the sequential algorithm over all pieces, in time that
does not grow with them. Pieces then find their place by (length, rank).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.bpe import word_end_codec
from tarn.llm.common import cut, document_columns, emit, pairs, shuffle_width


@dataclass(frozen=True)
class Capacity:
    """What one bin holds at most; the weights and the rule of the score."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    def __post_init__(self):
        if min(self.tokens, self.documents, self.cost) < 1 or min(self.weights) < 0:
            raise ValueError("capacities must be positive, weights not negative")
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule: {self.rule}")

    @property
    def all(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.cost], dtype=np.int64)


@dataclass
class _Group:
    """``count`` bins in one state. slots: (length, first rank, pieces a bin, offset)."""

    residual: np.ndarray
    count: int
    slots: list[tuple[int, int, int, int]]

    def take(self, k: int) -> _Group:
        """Splits off the first ``k`` bins."""
        first = _Group(self.residual, k, list(self.slots))
        self.slots = [(n, r + k * q, q, o) for n, r, q, o in self.slots]
        self.count -= k
        return first


def plan(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: (length, first rank, pieces a bin, first bin, offset)."""
    full, weights = capacity.all, np.array(capacity.weights)
    lengths = sorted((n for n, c in counts.items() if c > 0), reverse=True)
    opened: list[_Group] = []
    done: list[_Group] = []

    def place(group: _Group, n: int, rank: int, q: int, demand: np.ndarray) -> _Group:
        offset = int(full[0] - group.residual[0])
        return _Group(group.residual - q * demand, group.count, [*group.slots, (n, rank, q, offset)])

    for at, n in enumerate(lengths):
        demand = np.array([n, 1, n * n], dtype=np.int64)
        if (demand > full).any():
            raise ValueError(f"a piece of {n} tokens is beyond a bin's capacity")
        left, rank, new = counts[n], 0, []
        if opened:
            residual = np.array([g.residual for g in opened])
            fits = (residual >= demand).all(axis=1)
            if capacity.rule == "norm":
                score = ((((residual - demand) / full) ** 2) * weights).sum(axis=1)
            else:
                score = ((residual / full) * (demand / full) * weights).sum(axis=1)
            gone = set()
            for k in np.argsort(score, kind="stable"):
                if not left:
                    break
                if not fits[k]:
                    continue
                group, q = opened[k], int((residual[k] // demand).min())
                if left >= q and (whole := min(group.count, left // q)):
                    part = group.take(whole)
                    new.append(place(part, n, rank, q, demand))
                    rank, left = rank + whole * q, left - whole * q
                if left and group.count:  # fewer than q pieces are left
                    part = group.take(1)
                    new.append(place(part, n, rank, left, demand))
                    rank, left = rank + left, 0
                if not group.count:
                    gone.add(int(k))
            opened = [g for k, g in enumerate(opened) if k not in gone]
        if left:
            q = int((full // demand).min())
            if whole := left // q:
                new.append(place(_Group(full, whole, []), n, rank, q, demand))
                rank, left = rank + whole * q, left - whole * q
            if left:
                new.append(place(_Group(full, 1, []), n, rank, left, demand))
        opened += new
        least = lengths[at + 1 :][-1:]  # the shortest piece to come
        if least:
            small = np.array([least[0], 1, least[0] ** 2])
            done += [g for g in opened if (g.residual < small).any()]
            opened = [g for g in opened if (g.residual >= small).all()]
    places, first = [], 0
    for group in done + opened:
        places += [(n, r, q, first, o) for n, r, q, o in group.slots]
        first += group.count
    return places


def pack(pieces: DataFrame, capacity: Capacity | None = None, length_col: str = "length", keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id, offset`` to the pieces: which bin, and where in it.

    ``pieces`` are computed once and cut from their lineage. Rows whose length
    is null or not positive get null places; a length beyond a bin raises before
    any is gathered. Equal rows get places of their own; columns named like what is
    added are replaced; an empty table stays empty. A length that many pieces share is ranked in
    salted groups, so no task gathers it.
    """
    capacity = capacity or Capacity()
    clash = {"sequence_id", "offset", "_salt", "_rank", "_base"} & set(pieces.columns)
    pieces = cut(pieces.drop(*clash), narrow=True)
    spark = pieces.sparkSession
    length = F.col(f"`{length_col}`").cast("long")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(shuffle_width(spark))))
    good = salted.where(length > 0)
    cells = good.groupBy(length.alias("_length"), "_salt").agg(F.count("*").alias("_n"))
    cells = cut(cells)
    if over := cells.where(F.col("_length") > capacity.tokens).limit(1).collect():
        raise ValueError(f"a piece of {over[0]['_length']} tokens is beyond a bin's capacity")
    # at most one row for each length that a bin can hold
    counts = {r[0]: r[1] for r in cells.groupBy("_length").agg(F.sum("_n")).collect()}
    places = sorted(plan(counts, capacity))
    big = 1 << 40
    table = np.array(places, dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacity, not by the data

    base = Window.partitionBy("_length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_length", "_salt", F.coalesce(F.sum("_n").over(base), F.lit(0)).alias("_base"))
    order = [F.col(f"`{k}`") for k in keys]
    ranked = good.withColumn("_length", length)
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("_length", "_salt").orderBy(*order)).cast("long") - 1)
    ranked = ranked.join(cells, ["_length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    ranked = ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], "_length", "_rank")
    types = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    own = list(pieces.columns)

    def run(batches):
        table = shared.value
        start = table[:, 0] * big + table[:, 1]
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_length", "_rank"))
            _, first, q, bin_, offset = table[np.searchsorted(start, n * big + rank, "right") - 1].T
            kept = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(bin_ + (rank - first) // q), pa.array(offset + (rank - first) % q * n)],
                names=[*own, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{c}` {types[c]}" for c in own) + ", sequence_id long, offset long"
    packed = ranked.mapInArrow(run, schema)
    rest = salted.where(length.isNull() | (length <= 0)).select(*[F.col(f"`{c}`") for c in own])
    null = F.lit(None).cast("long")
    return packed.unionByName(rest.withColumn("sequence_id", null).withColumn("offset", null))


def token_pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every whole text's tokens and ``end_id``.

    Texts of over ``size`` tokens, the last id included, are cut into pieces of
    ``size``; the last may be shorter. A null text is an empty one: one piece
    that holds ``end_id``. Whole texts are encoded, however long. Repeated rows stay
    repeated; a null id stays null; extra columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    closing = int(end_id).to_bytes(4, "little")

    def run(batches):
        codec = word_end_codec(vocabulary, 32_768, 2_048)  # large leaves take less time

        def rows():
            for batch in batches:
                for doc_id, text in pairs(batch):
                    ids = codec.encode(text) + closing
                    for k in range(0, len(ids), 4 * size):
                        part = ids[k : k + 4 * size]
                        yield doc_id, k // (4 * size), k // 4, len(part) // 4, part

        yield from emit(rows(), schema, lambda r: 64 + len(r[4]))

    out = "doc_id long, piece int, start long, length long, ids binary"
    return document_columns(docs, id_col, text_col).mapInArrow(run, out)
