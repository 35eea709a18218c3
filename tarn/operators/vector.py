"""Exact and approximate cosine search, and checks of stored vectors."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits of a cosine that count.
DIGITS = 12
#: Queries up to which their vectors are broadcast (100,000 of 64 dimensions: 51 MB).
BROADCAST_QUERIES = 100_000
#: Hits that a task of :func:`cosine_top_k` gathers before it keeps each query's best.
HELD_HITS = 1 << 20


@dataclass(frozen=True)
class EmbeddingSpec:
    """What vectors must share to be compared."""

    model: str
    dimensions: int
    revision: str = ""
    template: str = "title-and-body"
    provider: str = "local"
    normalization: str = "l2"
    dtype: str = "float64"

    def __post_init__(self):
        if not self.model.strip() or type(self.dimensions) is not int or self.dimensions < 1:
            raise ValueError("a model and its positive number of dimensions are needed")
        if self.normalization not in ("none", "l2") or self.dtype not in ("float32", "float64"):
            raise ValueError("unknown normalization or type")

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def require(self, other: EmbeddingSpec) -> None:
        """Raises if queries and index were embedded in different ways."""
        if self.fingerprint != other.fingerprint:
            raise ValueError(f"vectors differ in kind: {self} and {other}")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its norm, as doubles; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, held to [-1, 1]; null where a norm is zero."""
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def validity(vector: Column, dimensions: int, tolerance: float = 1e-6) -> Column:
    """Null for a valid unit vector, else what is wrong with it first."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = norm(vector)
    return (
        F.when(vector.isNull(), "missing")
        .when(F.size(vector) != dimensions, "shape")
        .when(~finite, "not_finite")
        .when(length == 0, "zero")
        .when(F.abs(length - 1) > tolerance + 1e-5, "not_unit")
    )


def bounded(packed: DataFrame, n: int) -> DataFrame:
    """Blocks of ``n`` queries, broadcast if they are few: a product of partitions makes its left side once for each of the right."""
    return F.broadcast(packed) if n <= BROADCAST_QUERIES else packed


def best_rows(score: np.ndarray, order: np.ndarray, k: int):
    """Of each row of ``score`` the places and scores, to twelve digits, of the ``k`` best; ties by ``order``, NaN left out."""
    score[np.isnan(score)] = -np.inf
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k] if k < n else np.full(len(score), -np.inf)
    for own, bound in zip(score, least, strict=True):
        # what equals the last of the best once it is rounded is among them
        some = np.flatnonzero((own >= bound - 2 * 10.0**-DIGITS) & (own > -np.inf))
        rounded = np.round(np.clip(own[some], -1, 1), DIGITS) + 0.0
        best = np.lexsort((order[some], -rounded))[:k]
        yield some[best], rounded[best]


def cosine_top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    query_id: str = "query_id",
    id_col: str = "vec_id",
    query_vector: str = "query_vector",
    vector: str = "embedding",
    keep: Column | None = None,
    block: int = 1024,
) -> DataFrame:
    """``<query_id>, <id>, score, rank``: exact cosine, by score, then id.

    Scores are to twelve digits, as the last ones of a product of matrices depend
    on how it was dealt out; equal vectors are ties.

    Queries are gathered into blocks of ``block`` rows, each one Arrow matrix; a
    task multiplies its vectors by a block and passes on only the best ``k`` of its
    own vectors, however many it has: k rows a query, unless these are more than half
    of ``HELD_HITS``, which are passed on as they come.
    """
    vectors = vectors if keep is None else vectors.where(keep)
    asked = queries.select(F.col(query_id).alias("_q"), F.col(query_vector).cast("array<double>").alias("_v"))
    asked = asked.where(F.col("_v").isNotNull())
    n = asked.count()
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(max(1, -(-n // block)))))
    packed = numbered.groupBy("_block", F.size("_v").alias("_dim")).agg(F.collect_list(F.struct("_q", "_v")).alias("_asked"))
    packed = packed.select("_dim", F.transform("_asked", lambda r: r["_q"]).alias("_qs"), F.flatten(F.transform("_asked", lambda r: r["_v"])).alias("_q"))
    cells = vectors.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_x")).where(F.col("_x").isNotNull())
    # a stated query set against all rows, block by block
    paired = cells.mapInArrow(_batched, "_ids array<long>, _xs array<double>, _size int").join(bounded(packed, n), F.col("_size").between(F.col("_dim"), F.col("_dim")))  # no key: one size is the rule

    def best(batches):
        held = _Held(k, HELD_HITS, [query_id, id_col, "score"])
        for batch in batches:
            for i in range(batch.num_rows):
                qs, q, ids, xs = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("_qs", "_q", "_ids", "_xs"))
                if not len(q):
                    continue
                q, x = q.astype(np.float64).reshape(len(qs), -1), xs.astype(np.float64).reshape(len(ids), -1)
                size = np.sqrt((x * x).sum(1))
                for at in range(0, len(q), 256):
                    part = q[at : at + 256]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = part @ x.T
                        score /= np.sqrt((part * part).sum(1))[:, None] * size[None, :]
                    tops = list(best_rows(score, ids, k))
                    own = np.repeat(qs[at : at + 256], [len(rows) for rows, _ in tops])
                    yield from held.add(own, ids[np.concatenate([r for r, _ in tops])], np.concatenate([v for _, v in tops]))
        yield from held.rest()

    found = paired.mapInArrow(best, f"{query_id} long, {id_col} long, score double")
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Held:
    """Hits of a task, of each query the ``k`` best: highest score first, then the least id."""

    def __init__(self, k: int, most: int, names: list[str]):
        self.k, self.most, self.names, self.parts, self.size = k, most, names, [], 0
        self.full, self.least = np.zeros(0, np.int64), np.zeros(0)  # queries that have k hits, and the last one's score

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray):
        """Takes hits; gives those that are too many to hold."""
        if len(self.full):
            place = np.minimum(np.searchsorted(self.full, query), len(self.full) - 1)
            some = (self.full[place] != query) | (score >= self.least[place])
            query, ids, score = query[some], ids[some], score[some]
        self.parts.append((query, ids, score))
        self.size += len(query)
        if self.size > self.most:
            self._cut()
            if self.size > self.most // 2:
                yield from self._given()

    def rest(self):
        if self.size:
            self._cut()
            yield from self._given()

    def _cut(self) -> None:
        query, ids, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        self.full, self.least = query[nth == self.k - 1], score[nth == self.k - 1]
        some = nth < self.k
        self.parts = [(query[some], ids[some], score[some])]
        self.size = int(some.sum())

    def _given(self):
        (columns,), self.parts, self.size = self.parts, [], 0
        for at in range(0, len(columns[0]), 10_000):
            yield pa.record_batch([pa.array(c[at : at + 10_000]) for c in columns], self.names)


def _batched(batches):
    """Vectors of one size as blocks of up to 4,096 rows, without an object for each."""
    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column("_x")))
        for dim in np.unique(sizes):
            own = batch.filter(pa.array(sizes == dim))
            for at in range(0, own.num_rows, 4096):
                part = own.slice(at, 4096)
                ends = pa.array([0, part.num_rows], pa.int32())
                flat = part.column("_x").flatten()
                xs = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
                yield pa.record_batch([pa.ListArray.from_arrays(ends, part.column("_id").cast(pa.int64())), xs, pa.array([dim], pa.int32())], ["_ids", "_xs", "_size"])


def partitioned_top_k(queries: DataFrame, vectors: DataFrame, k: int, cells: int | None = None, probes: int | None = None, spill: int = 2, id_col: str = "vec_id", vector: str = "embedding", seed: int = 7, sample: int = 4096) -> DataFrame:
    """Approximate cosine search: inverted lists of unit vectors, exact ranks within.

    Centres are fitted on at most ``sample`` rows; every row is indexed, in its
    ``spill`` nearest cells. Each query looks into its ``probes`` nearest cells. Unless
    they are given, cells are as many as the square root of the rows, up to a fourth
    of the sample, and two fifths of them are probed, eight at least: vectors without
    structure need that many. Lists and the queries that look into them meet in blocks
    of bounded rows, each pair a product of matrices that passes on ``k`` rows a query,
    so a hot list, as many vectors are alike, is many rows.
    """
    spark = vectors.sparkSession
    if cells is None:
        cells = min(sample // 4, max(8, round(vectors.count() ** 0.5)))
    probes = max(8, -(-2 * cells // 5)) if probes is None else probes
    rows = vectors.select(unit(F.col(vector)).alias("u")).where("u IS NOT NULL").limit(sample).collect()
    if not rows:
        return spark.createDataFrame([], f"query_id long, {id_col} long, score double, rank int")
    x = np.array([r["u"] for r in rows])
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(8):
        own = (x @ centre.T).argmax(1)
        centre = np.array([c / max(np.linalg.norm(c), 1e-12) for c in (x[own == j].sum(0) if (own == j).any() else centre[j] for j in range(len(centre)))])
    shared = spark.sparkContext.broadcast(centre)  # cells * dimensions numbers

    def nearest(n):
        @F.pandas_udf("array<int>")
        def cell(u: pd.Series) -> pd.Series:
            score = np.array(u.tolist()) @ shared.value.T
            return pd.Series(list(np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return cell

    # a list's vectors go in blocks of bounded rows, so a hot list is many rows; so do its queries
    def blocks(rows, own, x, most):
        n = rows.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("n"))  # at most as many rows as lists
        dealt = rows.join(F.broadcast(n), "cell").groupBy("cell", F.pmod(F.xxhash64(own), F.col("n")).alias("part"))
        packed = dealt.agg(F.collect_list(F.struct(F.col(own).alias("i"), F.col(x).alias("x"))).alias("rows"))
        return packed.select("cell", F.transform("rows", lambda r: r["i"]).alias(f"_{own}"), F.flatten(F.transform("rows", lambda r: r["x"])).alias(f"_{x}"))

    indexed = vectors.select(F.col(id_col).alias("_id"), unit(F.col(vector)).alias("u")).where("u IS NOT NULL").withColumn("cell", F.explode(nearest(spill)("u")))
    asked = queries.select("query_id", unit(F.col("query_vector")).alias("q")).where("q IS NOT NULL")
    asked = asked.withColumn("cell", F.explode(nearest(probes)("q")))
    paired = blocks(asked, "query_id", "q", 256).join(blocks(indexed, "_id", "u", 4096), "cell")

    def best(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qs, q, ids, u = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("_query_id", "_q", "__id", "_u"))
                tops = list(best_rows(q.reshape(len(qs), -1) @ u.reshape(len(ids), -1).T, ids, k))
                rows = np.concatenate([r for r, _ in tops])
                yield pa.record_batch([pa.array(np.repeat(qs, [len(r) for r, _ in tops])), pa.array(ids[rows]), pa.array(np.concatenate([v for _, v in tops]))], ["query_id", id_col, "score"])

    # a vector is in several lists; any of the best is among the best of each of its lists
    kind = dict(vectors.dtypes)[id_col]
    scored = paired.mapInArrow(best, f"query_id {dict(queries.dtypes)['query_id']}, {id_col} {kind}, score double").groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def resolved(hits: DataFrame, records: DataFrame, id_col: str) -> DataFrame:
    """Hits with their records; ``foreign`` marks hits that no record backs."""
    own = records.withColumn("_known", F.lit(True))
    return hits.join(own, id_col, "left").withColumn("foreign", F.col("_known").isNull()).drop("_known")


def backed(hits: DataFrame, records: DataFrame, id_col: str) -> DataFrame:
    """Hits with their records; one that no record backs, or a second one of a query, raises when it is read."""
    rows = resolved(hits, records, id_col)
    twice = F.count("*").over(Window.partitionBy("query_id", id_col)) > 1
    fault = F.when(F.col("foreign"), "no record backs hit ").when(twice, "two hits of ")
    rows = rows.withColumn("_fault", F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col(id_col).cast("string")))))
    return rows.where(F.col("_fault").isNull()).drop("foreign", "_fault")
