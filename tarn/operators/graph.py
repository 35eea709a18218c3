"""Approximate cosine search by layered neighbour graphs, one for each bounded shard.

A shard's graph is made at once: every vector's ``ef_construct`` nearest ones come from
blocked products of matrices, are thinned so that no neighbour is nearer to one kept than
to the vector itself, and are linked both ways. A vector is in each higher layer with a
chance of 1 / m. A search goes down from the top layer greedily and then keeps a beam
of ``ef_search`` at the bottom; it scores a small part of the shard and says how much.
Equal vectors are one node, so many copies of one don't crowd out all links.

A graph is one row of packed arrays, stored and read like any table; vectors, neighbours
and ids of a shard have a stated bound. Queries go in blocks over all shards, and only
``k`` rows a query and shard are shuffled.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.vector import DIGITS, best_rows, bounded, unit

GRAPH = "shard long, dimensions int, nodes int, ids array<{id}>, owners binary, vectors binary, layers array<struct<members:binary,ends:binary,links:binary>>"
#: Bytes of vectors that one shard holds at most.
SHARD_BYTES = 32 << 20


@dataclass(frozen=True)
class GraphConfig:
    """``m``: neighbours a vector picks (at the bottom it may be linked to twice as many)."""

    m: int = 16
    ef_construct: int = 100
    shard_rows: int = 8192

    def __post_init__(self):
        if self.m < 2 or self.ef_construct < self.m or self.shard_rows < 2:
            raise ValueError("a graph needs m of 2 or more, ef_construct of m or more and shards of 2 rows or more")

    def rows(self, dimensions: int) -> int:
        return max(2, min(self.shard_rows, SHARD_BYTES // (8 * max(1, dimensions))))


def _thinned(candidates: np.ndarray, near: np.ndarray, x: np.ndarray, most: int) -> list[int]:
    """Of candidates, nearest first, those nearer to the vector than to any kept one; then the nearest others."""
    among = x[candidates] @ x[candidates].T
    kept: list[int] = []
    for k in range(len(candidates)):
        if len(kept) == most:
            break
        if not kept or (among[k, kept] < near[k]).all():
            kept.append(k)
    taken = set(kept)
    kept += [k for k in range(len(candidates)) if k not in taken][: most - len(kept)]
    return candidates[kept].tolist()


def _layer(x: np.ndarray, m: int, most: int, ef: int) -> list[np.ndarray]:
    """Neighbours of each vector of one layer: its own picks and those that picked it, thinned to ``most``."""
    n, near_n = len(x), min(ef, len(x) - 1)
    if n < 2:
        return [np.zeros(0, np.int32)] * n
    linked: list[set[int]] = [set() for _ in range(n)]
    for at in range(0, n, 512):
        score = x[at : at + 512] @ x.T
        score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        found = np.argpartition(-score, near_n - 1, axis=1)[:, :near_n]
        for k in range(len(score)):
            own = found[k][np.lexsort((found[k], -score[k, found[k]]))]
            for j in _thinned(own, score[k, own], x, m):
                linked[at + k].add(j)
                linked[j].add(at + k)
    _join_parts(linked, x)
    out = []
    for k, own in enumerate(linked):
        c = np.fromiter(own, np.int64, len(own))
        if len(c) > most:
            score = x[c] @ x[k]
            order = np.lexsort((c, -score))
            c = np.array(_thinned(c[order], score[order], x, most))
        out.append(np.sort(c).astype(np.int32))
    return _relinked(out, x)


def _relinked(rows: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Links that thinning took and without which a node can't be reached, or reaches nothing, from its nearest node."""
    for turned in (False, True):
        links = dict(enumerate(r.tolist() for r in rows))
        links = _turned(links) if turned else links
        reached = np.zeros(len(rows), bool)
        reached[list(_reach(links, 0))] = True
        while not reached.all():
            k = int(np.flatnonzero(~reached)[0])
            known = np.flatnonzero(reached)
            j = int(known[np.argmax(x[known] @ x[k])])
            a, b = (k, j) if turned else (j, k)
            rows[a] = np.union1d(rows[a], [b]).astype(np.int32)
            links[j].append(k)
            reached[list(_reach(links, k))] = True
    return rows


def _turned(links: dict[int, list[int]]) -> dict[int, list[int]]:
    back: dict[int, list[int]] = {j: [] for j in links}
    for j, own in links.items():
        for other in own:
            back[other].append(j)
    return back


def _reach(links: dict[int, list[int]], start: int) -> set[int]:
    seen, todo = {start}, [start]
    while todo:
        new = [j for j in links[todo.pop()] if j not in seen]
        seen.update(new)
        todo += new
    return seen


def _join_parts(linked: list[set[int]], x: np.ndarray) -> None:
    """Links every part of the graph that can't be reached from its first vector to the nearest one that can."""
    reached = np.zeros(len(linked), bool)

    def reach(start: int) -> None:
        todo = [start]
        reached[start] = True
        while todo:
            for j in linked[todo.pop()]:
                if not reached[j]:
                    reached[j] = True
                    todo.append(j)

    reach(0)
    while not reached.all():
        k = int(np.flatnonzero(~reached)[0])
        known = np.flatnonzero(reached)
        j = int(known[np.argmax(x[known] @ x[k])])
        linked[k].add(j)
        linked[j].add(k)
        reach(k)


def _packed(rows: list[np.ndarray], members: np.ndarray) -> dict:
    ends = np.cumsum([len(r) for r in rows]).astype(np.int32)
    links = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return {"members": members.astype(np.int32).tobytes(), "ends": ends.tobytes(), "links": links.tobytes()}


def _built(shard: int, ids: list, vectors: np.ndarray, config: GraphConfig) -> dict:
    """One shard's graph. Layers above the bottom hold every m-th vector of the layer below by a mix of its place."""
    x, owners = np.unique(vectors, axis=0, return_inverse=True)
    rng = np.random.default_rng(len(x))  # the same shard gives the same graph
    height = np.floor(-np.log(rng.uniform(1e-12, 1, len(x))) / math.log(config.m)).astype(int)
    layers = []
    for level in range(int(height.max()) + 1):
        members = np.flatnonzero(height >= level)
        most = 2 * config.m if level == 0 else config.m
        rows = [members[r] for r in _layer(x[members], config.m, most, config.ef_construct)]
        layers.append(_packed(rows, members))
    return {"shard": shard, "dimensions": x.shape[1], "nodes": len(x), "ids": ids, "owners": owners.astype(np.int32).tobytes(), "vectors": x.tobytes(), "layers": layers}


def build(vectors: DataFrame, config: GraphConfig | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each shard's graph (see ``GRAPH``) over all vectors that are not null or zero.

    Rows are dealt to shards by a hash of their id; a shard holds about
    ``shard_rows`` of them, fewer if they have many dimensions. Vectors must share one
    size. An empty table gives no shards.
    """
    config = config or GraphConfig()
    rows = vectors.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("u")).where("u IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("u")).alias("d"), F.min(F.size("u")).alias("least")).first()
    if size["d"] != size["least"]:
        raise ValueError("vectors differ in size")
    shards = max(1, -(-size["n"] // config.rows(size["d"] or 1)))
    kind = rows.schema["id"].dataType
    if kind.typeName() not in ("long", "integer", "string"):
        raise ValueError("ids are whole numbers or strings")
    arrow = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}[kind.typeName()]

    def made(key, part):
        part = part.sort_by("id")
        x = np.array(part.column("u").combine_chunks().flatten()).reshape(part.num_rows, -1)
        row = _built(key[0].as_py(), part.column("id").to_pylist(), x, config)
        kinds = pa.struct([("members", pa.binary()), ("ends", pa.binary()), ("links", pa.binary())])
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(arrow), pa.binary(), pa.binary(), pa.list_(kinds)]
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), types, strict=True)})

    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard").applyInArrow(made, GRAPH.format(id=kind.simpleString()))


class Graph:
    """A shard's graph, ready to be searched."""

    def __init__(self, row):
        self.dimensions, n = row["dimensions"], row["nodes"]
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(n, self.dimensions)
        owners = np.frombuffer(row["owners"], np.int32)
        rows = sorted(zip(owners.tolist(), list(row["ids"]), strict=True))  # ids are in order within a node
        self.ids, self.ends = [i for _, i in rows], np.cumsum(np.bincount(owners, minlength=n))
        self._linked: bool | None = None
        self.layers = []
        for layer in row["layers"]:
            members, ends, links = (np.frombuffer(layer[k], np.int32) for k in ("members", "ends", "links"))
            rows = np.split(links, ends[:-1]) if len(ends) else []
            self.layers.append(dict(zip(members.tolist(), (r.tolist() for r in rows), strict=True)))

    def linked(self) -> bool:
        """Whether every node can be reached from every other one at the bottom."""
        bottom = self.layers[0]
        start = next(iter(bottom))
        if self._linked is None:
            self._linked = all(len(_reach(links, start)) == len(bottom) for links in (bottom, _turned(bottom)))
        return self._linked

    def search_all(self, asked: np.ndarray, k: int, ef: int):
        """:meth:`search` for each row of ``asked``: arrays of scores and ids, and the number of vectors scored.

        A beam that holds all nodes of a linked graph scores them all, whatever way it
        goes, so they are scored as products of matrices. Other beams go query by query.
        """
        if ef < len(self.x) or not self.linked():
            for q in asked:
                hits, scored = self.search(q, k, ef)
                yield [s for s, _ in hits], [i for _, i in hits], scored
            return
        node = np.repeat(np.arange(len(self.x)), np.diff(self.ends, prepend=0))
        order = np.array(sorted(range(len(self.ids)), key=self.ids.__getitem__), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # ids in their order, whatever their type
        for at in range(0, len(asked), 256):
            for rows, score in best_rows((asked[at : at + 256] @ self.x.T)[:, node], place, k):
                yield score.tolist(), [self.ids[j] for j in rows], len(self.x)

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[list[tuple[float, int]], int]:
        """Up to ``k`` (score, id), best first, and how many vectors were scored."""
        at = next(iter(self.layers[-1]))
        best, scored = float(self.x[at] @ q), 1
        seen = {at}
        for layer in self.layers[:0:-1]:
            while True:
                new = [j for j in layer[at] if j not in seen]
                seen.update(new)
                scored += len(new)
                score = self.x[new] @ q
                if not len(new) or score.max() <= best:
                    break
                at, best = new[int(score.argmax())], float(score.max())
        # what was scored on the way down is not scored again, but may be met at the bottom
        known = {at: best}
        todo, beam, met = [(-best, at)], [(best, -at)], {at}
        bottom = self.layers[0]
        while todo:
            score, node = heapq.heappop(todo)
            if -score < beam[0][0] and len(beam) >= ef:
                break
            new = [j for j in bottom[node] if j not in met]
            met.update(new)
            fresh = [j for j in new if j not in known]
            scored += sum(j not in seen for j in fresh)
            known.update(zip(fresh, (self.x[fresh] @ q).tolist(), strict=True))
            for j in new:
                if len(beam) < ef:
                    heapq.heappush(beam, (known[j], -j))
                elif known[j] > beam[0][0]:
                    heapq.heapreplace(beam, (known[j], -j))
                else:
                    continue
                heapq.heappush(todo, (-known[j], j))
        found = []
        for score, node in ((s, -j) for s, j in beam):
            begin = self.ends[node - 1] if node else 0
            found += [(round(min(1.0, max(-1.0, score)), DIGITS) + 0.0, i) for i in self.ids[begin : self.ends[node]][:k]]
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k], scored


def top_k(queries: DataFrame, graphs: DataFrame, k: int, ef_search: int = 64, query_id: str = "query_id", query_vector: str = "query_vector", id_col: str = "vec_id", block: int = 512) -> DataFrame:
    """``<query_id>, <id>, score, rank, n_scored``: approximately the ``k`` best of all shards.

    Scores are exact cosines of those found, ranked by score, then id; ``n_scored``
    counts the vectors that the query was compared with in all shards. A query of
    another size than the vectors, null or zero finds nothing.
    """
    if k < 1 or ef_search < 1:
        raise ValueError("top_k and ef_search must be positive")
    asked = queries.select(F.col(query_id).cast("long").alias("_q"), unit(F.col(query_vector)).alias("_v")).where("_v IS NOT NULL")
    n = asked.count()
    blocks = max(1, -(-n // block))
    packed = asked.groupBy(F.pmod(F.xxhash64("_q"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("_q", "_v")).alias("_asked"))
    beam = max(ef_search, k)

    def found(batches):
        shard, graph = None, None
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if graph is None or row["shard"] != shard:  # a shard's blocks follow each other
                    shard, graph = row["shard"], Graph(row)
                out = []
                asks = [ask for ask in row["_asked"] if len(ask["_v"]) == graph.dimensions]
                found = graph.search_all(np.array([ask["_v"] for ask in asks]), k, beam) if asks else ()
                for ask, (scores, ids, scored) in zip(asks, found, strict=True):
                    out += [(ask["_q"], i, s, scored if not r else 0) for r, (s, i) in enumerate(zip(scores, ids, strict=True))]
                yield pd.DataFrame(out, columns=[query_id, id_col, "score", "n_scored"])

    # the stated queries, block by block, against every shard, which is made once
    hits = graphs.crossJoin(bounded(packed, n)).mapInPandas(found, f"{query_id} long, {id_col} {graphs.schema['ids'].dataType.elementType.simpleString()}, score double, n_scored long")
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    total = F.sum("n_scored").over(Window.partitionBy(query_id)).alias("n_scored")
    return hits.select(query_id, id_col, "score", F.row_number().over(order).alias("rank"), total).where(F.col("rank") <= k)
