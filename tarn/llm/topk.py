"""Exact top-k search (operator 2): ball-tree branch and bound per shard.

Candidates are dealt into shards of a bounded number of rows, so copies of one
vector spread over all shards. Each shard is a ball tree. Every query of a block
goes down the tree best first: of the nodes open to it, the one with the greatest
upper bound of the inner product, ``q . centre + |q| * radius``, is next; an inner
node opens its children, a leaf is scored; the query is done once that bound is below
its kth score. Queries that are at the same node are scored together.

The kth score is shared between shards: a query first searches one shard, its
home, then rounds of further shards, each ``GROWTH`` times as many as before; what
all shards of a round have found is merged, and the next round prunes by that kth
score from the start. Equal bounds are not pruned, so ties go to the smaller id
exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS, GROWTH = 8192, 16_384, 256, 4
_EXACT = float(1 << 53)
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector``: floor(scale * x) of each component, as doubles.

    Rows whose id or vector is null, or whose vector holds null or a value that
    isn't finite, are left out. Empty vectors stay. Repeated rows stay repeated;
    an empty table gives an empty result.
    """
    x = F.col("vector")
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            lists = b.column("vector")
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], schema=schema)

    return own.mapInArrow(run, "vec_id long, vector array<double>")


@dataclass
class BallTree:
    """Rows in leaf order; nodes level by level, children of i at 2i+1 and 2i+2."""

    x: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    span: np.ndarray  # first and last row of each node
    leaves: int

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
        depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf_rows))))
        n = (1 << (depth + 1)) - 1
        order = np.arange(len(x))
        span = np.zeros((n, 2), np.int64)
        span[0] = 0, len(x)
        centre, radius = np.zeros((n, x.shape[1])), np.zeros(n)
        for i in range(n):
            a, b = span[i]
            own = x[order[a:b]]
            if len(own):
                centre[i] = own.mean(axis=0)
                radius[i] = np.sqrt(((own - centre[i]) ** 2).sum(axis=1).max())
            if 2 * i + 1 < n:
                if len(own) > 1 and x.shape[1]:  # halves along the widest dimension
                    axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                    order[a:b] = order[a:b][np.argsort(own[:, axis], kind="stable")]
                m = (a + b) // 2
                span[2 * i + 1], span[2 * i + 2] = (a, m), (m, b)
        return cls(x[order], ids[order], centre, radius, span, 1 << depth)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, nodes): no row below a node scores more; empty nodes have none.

        A child's bound is no greater than its parent's. The slack covers what the
        products lose in doubles, by the size of their terms rather than of their sum.
        """
        norm, far = np.sqrt((q * q).sum(axis=1))[:, None], np.sqrt((self.centre**2).sum(axis=1))[None, :]
        slack = (4 * q.shape[1] + 64) * np.finfo(float).eps * norm * (far + self.radius[None, :]) + 0.5
        bound = q @ self.centre.T + norm * self.radius[None, :] + slack
        for i in range(1, bound.shape[1]):
            np.minimum(bound[:, i], bound[:, (i - 1) // 2], out=bound[:, i])
        bound[:, self.span[:, 0] == self.span[:, 1]] = -np.inf
        return bound

    def search(self, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Best scores and ids (queries, k), as integers; rows below ``floor`` may be missing."""
        n, first_leaf = len(q), self.leaves - 1
        best, best_ids = np.full((n, k), _NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.copy()
        bound, frontier = self.bounds(q), np.full((n, len(self.span)), -np.inf)
        frontier[:, 0] = bound[:, 0]
        live = np.arange(n)
        while len(live):
            node = frontier[live].argmax(axis=1)
            top = frontier[live, node]
            open_ = (top > -np.inf) & (top >= _below(kth[live]))
            live, node = live[open_], node[open_]
            frontier[live, node] = -np.inf
            inner_ = node < first_leaf
            who, at = live[inner_], node[inner_]
            for child in (2 * at + 1, 2 * at + 2):
                frontier[who, child] = bound[who, child]
            who, at = live[~inner_], node[~inner_]
            order = np.argsort(at, kind="stable")
            for rows in np.split(who[order], np.flatnonzero(np.diff(at[order])) + 1) if len(who) else ():
                a, b = self.span[node[np.searchsorted(live, rows[0])]]
                self._score(q, q_ids, rows, a, b, best, best_ids)
                full = rows[best[rows, -1] > _NONE]
                kth[full] = np.maximum(kth[full], best[full, -1])
        return best, best_ids

    def _score(self, q, q_ids, rows, a, b, best, best_ids):
        """Merges a leaf's scores into the best of some queries."""
        scores = inner(q[rows], self.x[a:b])
        ids = np.broadcast_to(self.ids[a:b], scores.shape)
        scores = np.where(ids == q_ids[rows, None], _NONE, scores)
        scores = np.concatenate([best[rows], scores], axis=1)
        ids = np.concatenate([best_ids[rows], ids], axis=1)
        top = np.lexsort((ids, ~scores), axis=1)[:, : best.shape[1]]
        best[rows], best_ids[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)


def _below(kth: np.ndarray) -> np.ndarray:
    """The scores as doubles that are no greater."""
    x = kth.astype(np.float64)
    return np.where(np.abs(x) < _EXACT, x, np.nextafter(x, -np.inf))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles.

    A score is a 64-bit integer; a product beyond that is an error, as no rank
    could be told among such.
    """
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    product = whole(a) @ whole(b).T
    if any(abs(v) > np.iinfo(np.int64).max for v in product.flat):
        raise OverflowError("an inner product is beyond 64 bits")
    return product.astype(np.int64)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, len(values) // table.num_rows)


def _search_shard(k: int):
    schema = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not shard.num_rows or not queries.num_rows:
            return schema.empty_table()
        tree = BallTree.build(_matrix(shard, "vector"), shard.column("vec_id").to_numpy())
        q, q_ids, asked = _matrix(queries, "query"), queries.column("query_id").to_numpy(), queries.column("asked").to_numpy()
        floor = queries.column("floor").fill_null(_NONE).to_numpy()
        out = []
        for a in range(0, len(q), 1024):
            b = a + 1024
            best, ids = tree.search(q[a:b], q_ids[a:b], floor[a:b], k)
            row, column = np.nonzero((best > _NONE) & (best >= floor[a:b, None]))
            out.append(pa.table([asked[a:b][row], q_ids[a:b][row], ids[row, column], best[row, column]], schema=schema))
        return pa.concat_tables(out)

    return run


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products.

    Both tables: ``vec_id, vector`` (integers held as doubles, as
    :func:`quantised` gives). Candidates: every row whose id isn't the query's
    and whose vector is as long; ties go to the smaller id; fewer rows are all
    returned. Equal query rows are one query; query rows of one id with different
    vectors are ranked apart, each with ranks from 1. Equal candidate rows count
    each. Null ids and vectors take no part. An empty table gives an empty result;
    other columns are ignored. Shards of candidates meet blocks of queries, both of
    bounded size: each block is sent to all shards and each shard to all blocks, in
    as many tasks. A score beyond 64 bits is an error.
    """
    held = F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    queries = queries.where(held).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).dropDuplicates()
    queries, candidates = cut(queries.withColumn("asked", F.xxhash64("query_id", "query"))), cut(candidates.where(held).select("vec_id", "vector"))
    n_shards = max(1, -(-candidates.count() // shard_rows))
    n_blocks = max(1, -(-queries.count() // block_rows))
    # by place, not by content: equal rows are dealt to all shards
    place = F.xxhash64(F.monotonically_increasing_id())
    dealt = candidates.withColumns({"shard": F.pmod(place, F.lit(n_shards)), "dim": F.size("vector")})
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = queries.withColumns(
        {
            "home": F.pmod(F.xxhash64("asked", F.lit(1)), F.lit(n_shards)),
            "block": F.pmod(F.xxhash64("asked", F.lit(2)), F.lit(n_blocks)).cast("int"),
            "dim": F.size("query"),
        }
    )
    keys = ["shard", "block", "dim"]
    out = "asked long, query_id long, vec_id long, score long"
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")

    def search(first, last, found):
        """The best of all shards so far, the round's included: from ``first`` to ``last`` places after the home."""
        far = asked.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        far = far.withColumn("shard", F.pmod(F.col("home") + F.col("shard"), F.lit(n_shards)).cast("long"))
        if found is None:
            far = far.withColumn("floor", F.lit(None).cast("long"))
        else:
            kth = found.groupBy("asked").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            far = far.join(kth.select("asked", F.when(F.col("n") >= k, F.col("least")).alias("floor")), "asked", "left")
        made = dealt.groupBy(*keys).cogroup(far.groupBy(*keys)).applyInArrow(_search_shard(k), out)
        made = made if found is None else found.unionByName(made)
        return cut(made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))

    found, first, last = None, 0, 1
    while first < n_shards:
        found = search(first, min(last, n_shards), found)
        first, last = last, last * GROWTH
    return found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
