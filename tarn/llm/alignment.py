"""Cross-tokenizer alignment (operator 11): interval index, bisect queries, unspanned gaps.

Two tokenizers cut one text into bytes A and bytes B. The B tokens' byte intervals
are a static sorted index; each A token stabs it with two bisections and lists the
B tokens that it overlaps. A gap between B tokens that no A token spans is a group
boundary: both tokenizers end a token there.

A space between two characters that aren't white space starts a token of either
tokenizer whatever stands around it, so a text falls into segments that are aligned
apart, and a segment that comes again is not aligned again.

Counts of id pairs over the corpus need every document's links, and every link
needs its count. Documents are worked on in chunks of bounded text: a chunk names
its distinct segments and pairs once, its documents name segments by number. Only
a chunk's distinct pairs are shuffled, counted, and sent back to their chunk.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import document_columns, slices, table

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A pair (a, b) is the number a * 2^24 + b.
_SHIFT = 24


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last B token that each A token overlaps; both rows cover the same bytes."""
    starts = np.concatenate([[0], a_ends[:-1]])
    return np.searchsorted(b_ends, starts, "right"), np.searchsorted(b_ends, a_ends, "left")


def group_numbers(first: np.ndarray, last: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A and of each B token: B gaps that no A token spans are boundaries."""
    steps = np.bincount(first, minlength=n_b + 1) - np.bincount(last, minlength=n_b + 1)
    spanned = np.cumsum(steps)[: n_b - 1] > 0  # gap j lies between B tokens j and j + 1
    of_b = np.concatenate([[0], np.cumsum(~spanned)])
    return of_b[first], of_b


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Length of each row, and all their numbers."""
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    return n, np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum()))


class Aligner:
    """Both tokenizers of a worker, and a table of the segments that it has aligned.

    A segment's number is its place in the table. ``n_a``, ``n_b`` and ``n_groups`` hold
    its counts (no tokens if a tokenizer changes it), ``groups`` its groups as text,
    ``pairs[ends[n - 1]:ends[n]]`` its links.
    """

    #: The table is emptied between chunks when it has so many segments or characters.
    most, most_chars = 600_000, 12_000_000

    def __init__(self, a_file: str, b_file: str):
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        back = {c: i for i, c in byte_letters().items()}
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size(True)
        for token, i in self.a.get_vocab(True).items():
            self.a_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self._parts: list[tuple[np.ndarray, ...]] = []
        self.n_a = self.n_b = self.n_groups = self.ends = self.pairs = np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.index) >= self.most or self.chars >= self.most_chars

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the segments of each text; new segments are aligned together."""
        index, new = self.index, []
        found = []
        for text in texts:
            parts = _CUT.split(text)
            for part in parts:
                if part not in index:
                    index[part] = len(index)
                    new.append(part)
            found.append(np.fromiter(map(index.__getitem__, parts), np.int64, len(parts)))
        if new:
            self._align(new)
        return found

    def _align(self, new: list[str]) -> None:
        """Adds the alignments of new segments (given without their first space) to the table."""
        self.chars += sum(map(len, new))
        a = [e.ids for e in self.a.encode_batch_fast([" " + x for x in new], add_special_tokens=False)]
        b = self.b.encode(new, num_threads=1)
        want = [b" " + x.encode() for x in new]
        sound = self._spelt(a, self.a_bytes, self.a_sizes, want) & self._spelt(b, self.b_bytes, self.b_sizes, want)
        if not sound.all():
            a, b = ([x if ok else [] for x, ok in zip(rows, sound.tolist(), strict=True)] for rows in (a, b))
        (n_a, a_ids), (n_b, b_ids) = _flat(a), _flat(b)
        n_groups = n_links = np.zeros(len(new), np.int64)
        pairs, texts = np.zeros(0, np.int64), [""] * len(new)
        if len(a_ids):
            first, last = overlaps(np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids]))
            of_a, of_b = group_numbers(first, last, len(b_ids))
            sizes = last - first + 1
            pairs = (np.repeat(a_ids, sizes) << _SHIFT) + b_ids[_ranges(first, sizes)]
            segment_of_a = np.repeat(np.arange(len(new)), n_a)
            n_links = np.bincount(segment_of_a, sizes, len(new)).astype(np.int64)
            opens = np.diff(of_a, prepend=-1) > 0  # the first A token of each group
            n_groups = np.bincount(segment_of_a[opens], minlength=len(new))
            texts = self._texts(a_ids, b_ids, np.flatnonzero(opens), np.flatnonzero(np.diff(of_b, prepend=-1)), n_groups)
        self.groups += texts
        before = int(self.ends[-1]) if len(self.ends) else 0
        old = (self.n_a, self.n_b, self.n_groups, self.ends, self.pairs)
        self.n_a, self.n_b, self.n_groups, self.ends, self.pairs = (np.concatenate(x) for x in zip(old, (n_a, n_b, n_groups, before + np.cumsum(n_links), pairs), strict=True))

    def _spelt(self, rows: list[list[int]], table: list[bytes], sizes: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Whether the tokens of each segment spell it byte for byte."""
        n, ids = _flat(rows)
        made = np.bincount(np.repeat(np.arange(len(rows)), n), sizes[ids], len(rows)).astype(np.int64)
        same = made == np.fromiter(map(len, want), np.int64, len(want))
        if same.all() and b"".join([table[i] for i in ids.tolist()]) == b"".join(want):
            return same
        return np.fromiter((b"".join([table[i] for i in x]) == w for x, w in zip(rows, want, strict=True)), bool, len(rows))

    def _texts(self, a_ids, b_ids, a_starts, b_starts, n_groups) -> list[str]:
        a, b = ([self.names[i] for i in ids.tolist()] for ids in (a_ids, b_ids))
        a_cuts, b_cuts = [*a_starts.tolist(), len(a)], [*b_starts.tolist(), len(b)]
        made = [",".join(a[i:j]) + "|" + ",".join(b[k:m]) for i, j, k, m in zip(a_cuts, a_cuts[1:], b_cuts, b_cuts[1:], strict=False)]
        cuts = [0, *np.cumsum(n_groups).tolist()]
        return [";".join(made[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def links(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of links of each of these segments, and the pairs of them all."""
        sizes = self.ends[segments] - np.where(segments > 0, self.ends[segments - 1], 0)
        return sizes, self.pairs[_ranges(self.ends[segments] - sizes, sizes)]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printing characters of Latin-1 stand for themselves, all other bytes, in order,
    for the characters from U+0100 on (a fixed public format).
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (i for i in range(256) if i not in set(own))
    return {i: chr(i) for i in own} | {i: chr(0x100 + k) for k, i in enumerate(rest)}


@functools.cache
def _aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
     ("groups_sha256", pa.string()), ("segments", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())), ("ends", pa.binary()), ("places", pa.binary())]
)
_DDL = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, segments binary, pairs array<long>, holders array<long>, ends binary, places binary"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32 in few bytes."""
    return len(values).to_bytes(8, "little") + pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64) if n else np.zeros(0, np.int64)


class _Chunk:
    """Documents of one chunk; their segments by number in the aligner's table."""

    def __init__(self, number: int, aligner: Aligner):
        self.number, self.aligner, self.weight = number, aligner, 0
        self.rows: list[tuple] = []
        self.own: list[np.ndarray] = []  # of each document with tokens, its segments in order of number
        self.pairs: list[np.ndarray] = []  # of each such document, its distinct pairs

    def add(self, ids: list, texts: list[str | None]) -> None:
        t = self.aligner
        found = iter(t.numbers([x for x in texts if x]))
        for doc_id, text in zip(ids, texts, strict=True):
            self.weight += len(text or "")
            numbers = next(found) if text else np.zeros(0, np.int64)
            if not len(numbers) or not t.n_a[numbers].all():  # a segment without tokens: changed by a tokenizer
                self.rows.append((doc_id, 0, 0, 0, 0, "", False))
                continue
            digest = hashlib.sha256(";".join(map(t.groups.__getitem__, numbers.tolist())).encode()).hexdigest()
            numbers.sort()
            distinct = numbers[np.diff(numbers, prepend=-1) > 0]
            self.pairs.append(np.unique(t.links(distinct)[1]))
            self.own.append(numbers)
            links = int((t.ends[numbers] - np.where(numbers > 0, t.ends[numbers - 1], 0)).sum())
            self.rows.append((doc_id, *(int(x[numbers].sum()) for x in (t.n_a, t.n_b, t.n_groups)), links, digest, True))

    def batches(self) -> Iterator[pa.RecordBatch]:
        every = np.unique(np.concatenate(self.own)) if self.own else np.zeros(0, np.int64)
        own, made = iter(self.own), []
        for *row, linked in self.rows:
            data = b""
            if linked:
                data = _packed(np.diff(np.searchsorted(every, next(own)), prepend=0))
            made.append((self.number, *row, data, None, None, None, None))
        for k in range(0, len(made), 4096):
            yield _batch(made[k : k + 4096])
        pairs, holders = np.unique(np.concatenate(self.pairs), return_counts=True) if self.pairs else (np.zeros(0, np.int64),) * 2
        sizes, links = self.aligner.links(every)
        yield _batch([(self.number, None, 0, 0, 0, 0, None, None, pairs, holders, _packed(sizes), _packed(np.searchsorted(pairs, links)))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def chunks(docs: DataFrame, a_file: str, b_file: str, chunk_chars: int = 4_000_000) -> DataFrame:
    """Rows of documents and, for each chunk of them, a row of its segments and pairs."""

    def run(batches):
        aligner = _aligner(a_file, b_file)
        held = _Chunk(TaskContext.get().partitionId() << 32, aligner)
        for part in slices(batches, rows=1024, weight=chunk_chars):
            held.add(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
            if held.weight >= chunk_chars or len(held.rows) >= 16_384 or aligner.full:
                yield from held.batches()
                held = _Chunk(held.number + 1, aligner)
                if aligner.full:
                    aligner.clear()
        if held.rows:
            yield from held.batches()

    return docs.mapInArrow(run, _DDL)


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over each document's links, from its chunk's segments and counted pairs."""
    docs = docs.combine_chunks()
    key = next((r for r in docs.select(["ends", "places"]).to_pylist() if r["ends"] is not None), None)
    rows = docs.filter(pc.is_valid(docs.column("groups_sha256")))
    best, total = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
    if answers.num_rows:
        place = answers.column("place").to_numpy()
        value = np.zeros((2, answers.num_rows + 1), np.int64)
        value[0, place], value[1, place] = answers.column("n_docs").to_numpy(), answers.column("best").to_numpy()
        at = np.concatenate([[0], np.cumsum(_unpacked(key["ends"]))])
        sums = np.cumsum(np.concatenate([np.zeros((2, 1), np.int64), value[:, _unpacked(key["places"])]], axis=1), axis=1)
        by_segment = sums[:, at[1:]] - sums[:, at[:-1]]
        for k, data in enumerate(rows.column("segments").to_pylist()):
            if data:
                own = by_segment[:, np.cumsum(_unpacked(data))].sum(axis=1)
                total[k], best[k] = int(own[0]), int(own[1])
    made = {n: rows.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(made | {"n_best": pa.array(best), "count_sum": pa.array(total), "groups_sha256": rows.column("groups_sha256")})


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 4_000_000) -> DataFrame:
    """Token groups and links of every whole text under two tokenizers, one row per input row.

    ``a_file``: a byte-level vocabulary of the tokenizers library, given a space and
    the text; ``b_file``: a sentencepiece model, which adds that space itself.
    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
    A pair's count is the number of rows that hold it linked; ``n_best`` counts links
    whose pair has the highest count of its A id; ``groups_sha256`` digests
    ``a1,a2|b1;a3|b2,b3``.

    Texts that are null, empty, or changed by a tokenizer have no tokens: zeros and
    an empty string. Whole texts are aligned, however long: a longer one is a chunk of
    its own. Ties for the highest count all count; repeated rows each count and stay
    repeated; a null id stays null; extra columns are ignored, whatever their names; an
    empty table gives an empty result. ``chunk_chars`` bounds what a chunk gathers and
    changes no result.
    """
    made = table(chunks(document_columns(docs, id_col, text_col), a_file, b_file, chunk_chars))
    held = made.where(F.col("pairs").isNotNull()).select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "x"))
    held = held.select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("n_docs"))
    a_id = F.shiftright("pair", _SHIFT)
    top = counts.groupBy(a_id.alias("a")).agg(F.max("n_docs").alias("top"))  # a row for each id of A's vocabulary at most
    marked = counts.join(F.broadcast(top), a_id == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("top")).cast("long").alias("best"))
    answers = held.join(marked, "pair")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    rows, answers = made.drop("pairs", "holders"), answers.select(F.col("chunk").alias("of"), "place", "n_docs", "best")
    return rows.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_scored, schema)
