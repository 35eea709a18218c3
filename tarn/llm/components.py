"""Connected components of links between keys, without gathering any of them.

Each task first contracts the links that it holds to a star forest. Up to ``SMALL``
links that are left are a bounded table, which one task contracts at one go; of
more, alternating large-star and small-star rounds hook every key to the smallest
key it can reach. Rounds grow with the logarithm of the longest path. Minima are
pre-aggregated and the joins may be split, so a key with many links is no
bottleneck. Every round is written to the shared checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut

#: Links that one task may contract, 16 bytes each.
SMALL = 1_000_000


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star forest of the links (a, b): each key that isn't a root, and its root.

    The root is the smallest key of the component.
    """
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(keys))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = np.minimum(new, new[root])
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(keys))
    return keys[own], keys[root[own]]


def _contracted(links: DataFrame) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("u", "v")))
            size += batch.num_rows
            if size > 1_000_000:  # bounds what a task holds; more links are contracted again
                held, size = [local_components(*map(np.concatenate, zip(*held, strict=True)))], 0
                size = len(held[0][0]) // 2
        if held:
            u, v = local_components(*map(np.concatenate, zip(*held, strict=True)))
            for k in range(0, len(u), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 65_536]), pa.array(v[k : k + 65_536])], schema=schema)

    return links.mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame, max_rounds: int = 60, contracted: bool = False, small: int = SMALL) -> DataFrame:
    """``node, root`` of every key that has a link to another; root: smallest reachable.

    ``links``: columns ``u, v`` (long); ``contracted`` says that each task's links
    are a star forest already, which saves a second Python worker a task. Links of a
    key with itself or with null say nothing; repeated links count once. Roots
    themselves are not listed. Empty links give an empty result. ``small`` changes
    no result.
    """
    u, v = F.col("u"), F.col("v")
    links = links.select("u", "v").where(u.isNotNull() & v.isNotNull() & (u != v))
    state = cut((links if contracted else _contracted(links)).distinct())
    rows = state.count()
    if rows <= small:
        return cut(_contracted(state.coalesce(1)), rows).select(u.alias("node"), v.alias("root"))
    seen = None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        state = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), 2 * rows)
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return state.select(u.alias("node"), v.alias("root"))
        seen, rows = now, now[0]
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
