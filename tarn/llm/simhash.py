"""SimHash near-dedup (operator 10): segment-popcount embedding and a grid join.

A fingerprint's 64 bits are cut into segments of two bits; its embedding is the
number of set bits in each. The Manhattan distance of two embeddings is at most
the Hamming distance of the fingerprints, so it is a lower bound that can't lose
a link. The segments are dealt into bands; if the whole distance is at most
``d``, some band's distance is at most ``d // bands``, which is 0 or 1 here.
Each band is a grid of unit cells over its counts: a fingerprint is at home in
its own cell and probes the cells one step up in one segment, so every pair
within one step meets in exactly one cell. Pairs that meet are verified exactly.

Equal fingerprints are one key from the start, and a task passes on only a
spanning forest of the links it verified, so a group of copies of any size costs
rows in proportion to its members, not pairs. In a cell of many fingerprints those
reached are compared only with those not reached yet. A cell in which over
``HOT_CELL`` fingerprints are at home is split by a finer grid over the other bits,
as these are within the distance as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.bloom import mix
from tarn.llm.common import cut, document_columns, emit, pairs
from tarn.llm.components import connected_components, local_components

_ODD = 0x5555555555555555
#: Fingerprints at home in one cell that are compared in one task.
HOT_CELL = 20_000


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words joined by spaces, repeats included.

    Fewer words are one run; no words have none.
    """
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Number whose bits are those that are set in over half the hashes."""
    counts, data = np.zeros(64, np.int64), hashes.astype(">u8")
    for k in range(0, len(data), 16_384):
        bits = np.unpackbits(data[k : k + 16_384].view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(data)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text, unsigned; zero for a text without words.

    A-Z are lower-cased, words split at ASCII white space, shingles taken with
    repeats. A bit is set if it is set in over half the shingles' XXH64.
    """
    return majority(shingle_hashes((text or "").encode("utf-8").lower().split(), shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (long: the fingerprint's 64 bits) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        rows = (
            (i, x - (1 << 64) if (x := fingerprint(t, shingle, seed)) >> 63 else x)
            for batch in batches
            for i, t in pairs(batch)
        )
        yield from emit(rows, schema)

    return document_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def bands_of(max_distance: int, width: int = 64) -> list[tuple[int, int]]:
    """(first bit, bits) of each band of ``width`` bits; bands of whole two-bit segments."""
    n = max(1, (max_distance + 2) // 2)
    if not 0 <= max_distance < 32:
        raise ValueError("max_distance must be from 0 to 31")
    edges = [width // 2 * k // n * 2 for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _grid(x: np.ndarray, bits: int, radius: int):
    """Cells of numbers of so many bits: (cell, which numbers, if at home there)."""
    counts = x - ((x >> np.uint64(1)) & np.uint64(_ODD))
    yield counts, np.ones(len(x), bool), True
    for s in range(0, bits, 2) if radius else ():
        up = (counts >> np.uint64(s)) & np.uint64(3) < 2
        if up.any():
            yield counts[up] + np.uint64(1 << s), up, False


def _part(x: np.ndarray, first: int, bits: int) -> np.ndarray:
    return (x >> np.uint64(first)) & np.uint64((1 << bits) - 1)


def _others(x: np.ndarray, first: int, bits: int) -> np.ndarray:
    """The numbers without the ``bits`` bits from ``first`` on."""
    low = x & np.uint64((1 << first) - 1)
    high = x >> np.uint64(first + bits) if first + bits < 64 else np.zeros_like(x)
    return low | high << np.uint64(first)


def _cells(fps: DataFrame, max_distance: int, hot_cell: int) -> DataFrame:
    """``cell, fp, home``: where each fingerprint is at home or probes; cells of all bands have hashed names."""
    bands = bands_of(max_distance)
    radius = max_distance // len(bands)
    homes = []
    for first, bits in bands:
        x = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        cell = x - F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_ODD))
        # no more than a row for every ``hot_cell`` fingerprints
        found = fps.groupBy(cell.alias("cell")).count().where(F.col("count") > hot_cell).select("cell").collect() if len(bands) > 1 else []
        homes.append(np.sort(np.array([r["cell"] for r in found], np.int64).view(np.uint64)))
    hot = fps.sparkSession.sparkContext.broadcast(homes)
    schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def batch_of(names, fp, home):
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), home))], schema=schema)

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for band, (first, bits) in enumerate(bands):
                for cell, which, home in _grid(_part(fp, first, bits), bits, radius):
                    own, name = fp[which], mix(cell + np.uint64(band) * np.uint64(_ODD))
                    split = np.isin(cell, hot.value[band]) if len(hot.value[band]) else np.zeros(len(cell), bool)
                    if not split.all():
                        yield batch_of(name[~split], own[~split], home)
                    if split.any():
                        rest, width = _others(own[split], first, bits), 64 - bits
                        for k, (a, n) in enumerate(bands_of(max_distance, width)):
                            for finer, some, at_home in _grid(_part(rest, a, n), n, radius):
                                yield batch_of(mix(finer ^ mix(name[split][some] + np.uint64(k + 1))), own[split][some], at_home)

    return fps.mapInArrow(run, "cell long, fp long, home boolean")


def _forest(fp: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of all numbers within the distance."""
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[i]) <= max_distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found.tolist())
                a.append(np.full(len(found), fp[i]))
                b.append(fp[found])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _cell_links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, max_distance: int, large: int = 512):
    """Links in whole cells: those of one home and another row of a cell, or a forest of them."""
    order = np.lexsort((~home, cell))
    cell, fp, home = cell[order], fp[order], home[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    n = np.diff(np.append(first, len(fp)))
    end = np.repeat(first + n, n)
    for a, m in zip(first[n > large].tolist(), n[n > large].tolist(), strict=True):
        yield _forest(fp[a : a + m], max_distance)
    at = np.flatnonzero(home & (np.repeat(n, n) <= large))  # home rows come first in a cell
    step = 1
    while len(at := at[at + step < end[at]]):
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= max_distance
        if near.any():
            yield fp[at[near]], fp[at[near] + step]
        step += 1


def links(fps: DataFrame, max_distance: int = 3, hot_cell: int = HOT_CELL) -> DataFrame:
    """``u, v``: links that span the same components as all pairs within the distance.

    ``fps``: distinct fingerprints in column ``fp``. Cells come to a task in order
    and are looked at about half a million rows at a time.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held, size, found, links_held = [], 0, [], 0

        def looked():
            nonlocal found, links_held
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            for a, b in _cell_links(columns[0], columns[1].view(np.uint64), columns[2], max_distance):
                found.append((a.view(np.int64), b.view(np.int64)))
                links_held += len(a)
                if links_held > 1_000_000:  # bounds what a task holds
                    found = [local_components(*map(np.concatenate, zip(*found, strict=True)))]
                    links_held = 0

        for batch in batches:
            part = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "home"))
            if size > 500_000 and (new := np.flatnonzero(part[0] != held[-1][0][-1])).size:
                k = int(new[0])
                held.append(tuple(x[:k] for x in part))
                looked()
                held, size, part = [], 0, tuple(x[k:] for x in part)
            if len(part[0]):
                held.append(part)
                size += len(part[0])
        if held:
            looked()
        if found:
            u, v = local_components(*map(np.concatenate, zip(*found, strict=True)))
            for k in range(0, len(u), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 65_536]), pa.array(v[k : k + 65_536])], schema=schema)

    dealt = _cells(fps, max_distance, hot_cell).repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """``doc_id, fp, component_id``, one row per input row.

    Fingerprints link at ``max_distance`` or fewer differing bits; a component
    is what links reach, and its id the smallest doc_id in it. Null and empty
    texts have fingerprint zero and link like others. A null id never names a
    component unless all its ids are null (then the id is null). Whole texts are
    read, however long. Repeated rows stay repeated; extra columns are ignored; an
    empty table stays empty.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle, seed), narrow=True)
    keys = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(keys.select("fp"), max_distance)
    reached = connected_components(found, contracted=True).withColumnRenamed("node", "fp")
    rooted = keys.join(reached, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
