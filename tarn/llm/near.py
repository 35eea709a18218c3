"""SimHash near-dedup at a Jaccard similarity: the grid join of operator 10, completed.

Texts link if their SimHash fingerprints over five-word shingles differ in at most
three bits (the grid join of :mod:`tarn.llm.simhash`), or if the Jaccard similarity
of their sets of shingles is 0.8 or more. The grid alone can't reach that similarity:
64 bits differ in some ten places then, and a grid that finds such pairs compares
nearly all with all. So MinHash proposes further pairs: sets that are alike share
the least values of ``rows`` hash functions in some of ``bands`` bands; at a
similarity of 0.8 a pair is missed in 5 of 100,000 cases, above it less. Texts
that share a band's bucket are compared exactly. Texts of equal words are one key
from the start.

Only texts that share a bucket with some that the grid hasn't joined them to are read
again, and a bucket passes on a spanning forest of its links, so a group of copies costs
rows in proportion to its members, and one that the grid has joined none. A bucket is
compared within one task, which holds its sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.bloom import bits_for, pair_filter
from tarn.llm.common import carried, cut, document_columns, emit, pairs, slices
from tarn.llm.components import connected_components, local_components
from tarn.llm.simhash import links as fingerprint_links
from tarn.llm.simhash import majority, shingle_hashes


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(words: list[bytes]) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(words), 7))


def key(text: str | None) -> int:
    """64 bits (signed) of a text's words, A-Z lower-cased; texts of equal words share them."""
    return _key(_words(text))


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of the runs of so many words, in order; a shorter text is one run."""
    return np.unique(shingle_hashes(_words(text), shingle))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    draw = lambda: rng.integers(0, 1 << 64, (n, 1), dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def buckets(hashes: np.ndarray, functions: tuple[np.ndarray, np.ndarray], rows: int) -> list[int]:
    """A bucket for each band; none for an empty set."""
    if not len(hashes):
        return []
    a, b = functions
    least = np.full(len(a), np.uint64((1 << 64) - 1))
    for k in range(0, len(hashes), 2048):
        np.minimum(least, (a * hashes[k : k + 2048] + b).min(axis=1), out=least)
    least = least.reshape(-1, rows)
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), k)) for k, x in enumerate(least)]


def similar(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked sets: a spanning forest of all pairs of at least that similarity.

    A set that is reached is compared once with those not reached yet.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    places, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    own, ends = np.repeat(np.arange(n), size), np.cumsum(size)
    mark, left, rest = np.zeros(len(places), bool), np.ones(n, bool), n
    live, live_own, held = tokens, own, n
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(n):
        if not left[first]:
            continue
        left[first], rest, queue = False, rest - 1, [first]
        while queue and rest:
            i = queue.pop()
            if 2 * rest < held:
                keep = left[live_own]
                live, live_own, held = live[keep], live_own[keep], rest
            mine = tokens[ends[i] - size[i] : ends[i]]
            mark[mine] = True
            common = np.bincount(live_own[mark[live]], minlength=n)
            mark[mine] = False
            near = np.flatnonzero(left & (common / (size + size[i] - common) >= least))
            left[near], rest = False, rest - len(near)
            queue.extend(near.tolist())
            a.append(np.full(len(near), i))
            b.append(near)
    return np.concatenate(a), np.concatenate(b)


def _links(members: DataFrame, least: float) -> DataFrame:
    """``u, v`` of ``members``: one row a bucket, key and set."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        bucket, keys, sets, found, size = None, [], [], [], 0

        def closed():
            if len(keys) < 2:
                return 0
            a, b = similar(sets, least)
            own = np.array(keys)
            found.append((own[a], own[b]))
            return len(a)

        for batch in batches:
            for x, k, s in zip(*(batch.column(c) for c in ("bucket", "key", "hashes")), strict=True):
                if x.as_py() != bucket:
                    size += closed()
                    bucket, keys, sets = x.as_py(), [], []
                keys.append(k.as_py())
                sets.append(np.frombuffer(s.as_py(), np.uint64))
            if size > 1_000_000:  # bounds what a task holds
                found = [local_components(*map(np.concatenate, zip(*found, strict=True)))]
                size = 0
        closed()
        if found:
            u, v = local_components(*map(np.concatenate, zip(*found, strict=True)))
            for k in range(0, len(u), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 65_536]), pa.array(v[k : k + 65_536])], schema=schema)

    dealt = members.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "key", "hashes")
    return dealt.mapInArrow(run, "u long, v long")


def near_copies(
    docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bands: int = 25, rows: int = 5, max_distance: int = 3
) -> DataFrame:
    """``doc_id, key, root, component_id``, one row per input row.

    Texts link if their fingerprints differ in ``max_distance`` bits or fewer, or if
    the Jaccard similarity of their sets of shingles is ``least`` or more; ``root``
    is the smallest key that links reach and names the component;
    ``component_id`` is the smallest doc_id in it. Null and empty texts are copies
    of each other alone. A null id never names a component unless all its ids are
    null. Repeated rows stay repeated; extra columns are ignored; an empty table
    stays empty.
    """
    own = document_columns(docs, id_col, text_col)
    functions = _functions(bands * rows)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("buckets", pa.list_(pa.int64()))])

    def marks(batches):
        def rows_of():
            for batch in batches:
                for i, t in pairs(batch):
                    words = _words(t)
                    hashes = shingle_hashes(words, shingle)
                    yield i, _key(words), _signed(majority(hashes)), buckets(np.unique(hashes), functions, rows)

        yield from emit(rows_of(), schema, lambda r: 40 + 8 * bands)

    marked = cut(own.mapInArrow(marks, "doc_id long, key long, fp long, buckets array<long>"), narrow=True)
    reached = connected_components(fingerprint_links(marked.select("fp").distinct(), max_distance), contracted=True)
    reached = reached.select(F.col("node").alias("fp"), F.col("root").alias("part"))
    texts = marked.select("key", "fp", "buckets").dropDuplicates(["key"]).join(reached, "fp", "left")
    texts = cut(texts.select("key", F.coalesce("part", "fp").alias("part"), "buckets"))
    least_key = texts.groupBy("part").agg(F.min("key").alias("first"))
    linked = texts.select("key", "part").join(least_key, "part").where("key > first").select(F.col("key").alias("u"), F.col("first").alias("v"))

    # a bucket whose texts the grid has joined already can't add a link
    cells = texts.select("key", "part", F.explode("buckets").alias("bucket"))
    shared = cells.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("bucket")
    members = cut(cells.select("key", "bucket").join(shared, "bucket"))
    asked = members.select("key").distinct()
    among = pair_filter(asked, lambda batches: (b.column("key").to_numpy().view(np.uint64) for b in batches), bits_for(asked.count()))
    seen = docs.sparkSession.sparkContext.broadcast(among)  # a filter of stated bound; false hits fall out in the join
    set_schema = pa.schema([("key", pa.int64()), ("hashes", pa.binary())])

    def sets(batches):
        def rows_of():
            for batch in batches:
                for part in slices([batch]):
                    words = [_words(t) for t in part.column("text").to_pylist()]
                    keys = [_key(w) for w in words]
                    for k, w, hit in zip(keys, words, seen.value.seen_once(np.array(keys, np.int64).view(np.uint64)), strict=True):
                        if hit and w:
                            yield k, np.unique(shingle_hashes(w, shingle)).tobytes()

        yield from emit(rows_of(), set_schema, lambda r: 32 + len(r[1]))

    held = own.mapInArrow(sets, "key long, hashes binary").dropDuplicates(["key"])
    found = _links(members.join(held, "key"), least).unionByName(linked)
    reached = connected_components(found, contracted=True).withColumnRenamed("node", "key")
    named = marked.groupBy("key").agg(F.min("doc_id").alias("least")).join(reached, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = cut(named)
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "key").join(named.join(component, "root").select("key", "root", "component_id"), "key")


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """``doc_id, text``, carried columns and ``_key`` of every row."""
    own = document_columns(docs, id_col, text_col, carry)
    _, ddl = carried(own, carry, ("doc_id", "text", "_key"))

    def run(batches):
        for part in slices(batches):
            keys = pa.array([key(t) for t in part.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, keys], names=["doc_id", "text", *carry, "_key"])

    return own.mapInArrow(run, f"doc_id long, text string{ddl}, _key long")


def representatives(docs: DataFrame, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``doc_id, text`` and the carried columns: one row of each component of near copies.

    The row of the smallest id stays, null ids last; of several rows of that id in
    the component the one of the smallest key, and of rows whose words are equal
    too the one of the smallest text and carried columns. So copies that all lack
    an id leave one row, a repeated row stays once, and a text stays if it is like
    no other, whatever other texts have its id. ``more``: see ``near_copies``.
    """
    marked = near_copies(docs, id_col=id_col, text_col=text_col, **more)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    chosen = marked.groupBy("root").agg(first.alias("m")).select(F.col("m.doc_id").alias("_id"), F.col("m.key").alias("_chosen"))
    rows = _keyed(docs, id_col, text_col, carry)
    kept = rows.join(chosen, (F.col("_key") == F.col("_chosen")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    order = Window.partitionBy("_key").orderBy(*(F.asc_nulls_last(c) for c in ("text", *carry)))
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", "text", *carry)
