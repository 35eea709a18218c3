"""Quality classifier (operator 4): a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Learned filters of ``WIDTH`` bytes slide over it in
steps of two; chunks of four blocks, overlapping by one, cover the whole
document. Each filter is max-pooled in each chunk; the greatest and the mean of
a filter's chunk maxima pass through one hidden layer to one probability.

The network is trained on the driver on a bounded sample of labelled rows
(``TrainingBound``); scoring is one narrow pass that holds one text at a time.
For scoring, neighbouring bytes are looked up as pairs, which is the same sum.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import carried, document_columns, slices

WIDTH, STEP, FILTERS, HIDDEN = 8, 2, 24, 16
BLOCK = 32  # positions
CHUNK, HOP = 4, 3  # blocks of a chunk, blocks from one chunk to the next
_LOW = np.float32(-1e4)


@dataclass(frozen=True)
class TrainingBound:
    """Rows, and bytes of a text, that training takes at most; passes over them."""

    rows: int = 4000
    text_bytes: int = 16_384
    epochs: int = 8
    seed: int = 7


@dataclass
class Network:
    """Weights: filters (WIDTH, 256, FILTERS), then two dense layers."""

    table: np.ndarray
    shift: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    pair_tables: list[np.ndarray] | None = field(default=None, repr=False)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(
            normal(WIDTH, 256, FILTERS, scale=0.1), np.zeros(FILTERS, np.float32),
            normal(2 * FILTERS, HIDDEN, scale=0.2), np.zeros(HIDDEN, np.float32),
            normal(HIDDEN, 1, scale=0.3), np.zeros(1, np.float32),
        )

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.table, self.shift, self.w1, self.b1, self.w2, self.b2]

    def __getstate__(self):
        return {**self.__dict__, "pair_tables": None}

    # scoring -------------------------------------------------------------

    def _pairs(self) -> list[np.ndarray]:
        if self.pair_tables is None:
            t = self.table
            self.pair_tables = [
                (t[j][None, :, :] + t[j + 1][:, None, :]).reshape(65_536, FILTERS) for j in range(0, WIDTH, 2)
            ]
        return self.pair_tables

    def chunk_maxima(self, text: bytes, at_once: int = 1024) -> np.ndarray:
        """(chunks, FILTERS): each filter's greatest response in each chunk."""
        codes = pair_codes(text)
        n = len(codes) - WIDTH // 2 + 1
        blocks = -(-n // BLOCK)
        out = np.full((blocks, FILTERS), _LOW)
        tables = self._pairs()
        for b in range(0, blocks, at_once):
            first, last = b * BLOCK, min(n, (b + at_once) * BLOCK)
            value = tables[0][codes[first:last]]
            for j in range(1, WIDTH // 2):
                value += tables[j][codes[first + j : last + j]]
            whole = (last - first) // BLOCK
            out[b : b + whole] = value[: whole * BLOCK].reshape(whole, BLOCK, FILTERS).max(axis=1, initial=_LOW)
            if whole * BLOCK < last - first:
                out[b + whole] = value[whole * BLOCK :].max(axis=0)
        starts = chunk_starts(blocks)
        value = out[starts]
        for k in range(1, CHUNK):
            value = np.maximum(value, out[np.minimum(starts + k, blocks - 1)])
        return value

    def score(self, text: bytes) -> float:
        """Probability of label 1."""
        chunks = np.maximum(self.chunk_maxima(text) + self.shift, 0)
        x = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])
        hidden = np.maximum(x @ self.w1 + self.b1, 0)
        return float(_sigmoid(hidden @ self.w2 + self.b2)[0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(np.asarray(x, np.float64), -40, 40)))


def pair_codes(text: bytes) -> np.ndarray:
    """A text's byte pairs, with zeros after it up to one filter's width at least."""
    n = max(WIDTH, len(text) + len(text) % 2)
    return np.frombuffer(text.ljust(n, b"\0"), "<u2")


def chunk_starts(blocks: int) -> np.ndarray:
    """First block of each chunk; the chunks cover all blocks."""
    return np.arange(0, max(1, blocks - CHUNK + HOP), HOP)


def train(texts: list[bytes], labels: list[int], bound: TrainingBound) -> Network:
    """Adam on log loss over batches of texts, in a fixed order for a seed."""
    net = Network.fresh(bound.seed)
    if not texts:
        return net
    rng = np.random.default_rng(bound.seed)
    y_all = np.asarray(labels, np.float32)
    prior = np.clip(y_all.mean(), 0.02, 0.98)
    net.b2[:] = np.log(prior / (1 - prior))
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights]
    step, size = 0, 32
    total = bound.epochs * -(-len(texts) // size)
    for _ in range(bound.epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), size):
            batch = order[k : k + size]
            gradients = _gradients(net, [texts[i] for i in batch], y_all[batch])
            step += 1
            rate = 0.004 * (1 - step / (total + 1))
            for w, g, (m, v) in zip(net.weights, gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def _gradients(net: Network, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    # the positions of all texts, padded to whole blocks
    codes, places, chunk_rows, chunk_of, base = [], [], [], [], 0
    for d, text in enumerate(texts):
        c = pair_codes(text)
        n = len(c) - WIDTH // 2 + 1
        blocks = -(-n // BLOCK)
        place = np.full(blocks * BLOCK, -1, np.int64)
        place[:n] = np.arange(n) + sum(map(len, codes))
        codes.append(c)
        starts = chunk_starts(blocks)
        rows = np.minimum(starts[:, None] + np.arange(CHUNK), blocks - 1) + base
        chunk_rows.append(rows)
        chunk_of.append(np.full(len(starts), d))
        base += blocks
        places.append(place)
    place, flat = np.concatenate(places), np.concatenate(codes)
    chunk_rows, chunk_of = np.concatenate(chunk_rows), np.concatenate(chunk_of)
    data = flat.view(np.uint8)
    real = np.maximum(place, 0)
    value = net.table[0][data[2 * real]]
    for j in range(1, WIDTH):
        value += net.table[j][data[2 * real + j]]
    value[place < 0] = _LOW
    value = value.reshape(-1, BLOCK, FILTERS)
    where = value.argmax(axis=1)  # (blocks, FILTERS)
    top = np.take_along_axis(value, where[:, None, :], 1)[:, 0]
    options = top[chunk_rows]  # (chunks, CHUNK, FILTERS)
    pick = options.argmax(axis=1)
    chunk = np.take_along_axis(options, pick[:, None, :], 1)[:, 0] + net.shift
    active = np.maximum(chunk, 0)

    n_docs = len(y)
    counts = np.bincount(chunk_of, minlength=n_docs).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(counts[:-1])]).astype(np.int64)
    greatest = np.maximum.reduceat(active, first, axis=0)
    mean = np.add.reduceat(active, first, axis=0) / counts[:, None]
    x = np.concatenate([greatest, mean], axis=1)
    before = x @ net.w1 + net.b1
    hidden = np.maximum(before, 0)
    p = _sigmoid(hidden @ net.w2 + net.b2)[:, 0].astype(np.float32)

    d_out = ((p - y) / n_docs)[:, None]
    g_w2, g_b2 = hidden.T @ d_out, d_out.sum(axis=0)
    d_hidden = (d_out @ net.w2.T) * (before > 0)
    g_w1, g_b1 = x.T @ d_hidden, d_hidden.sum(axis=0)
    d_x = d_hidden @ net.w1.T
    d_chunk = (d_x[:, FILTERS:] / counts[:, None])[chunk_of]
    is_top = active == greatest[chunk_of]
    ties = np.add.reduceat(is_top.astype(np.float32), first, axis=0)
    d_chunk = d_chunk + is_top * (d_x[:, :FILTERS] / ties)[chunk_of]
    d_chunk *= chunk > 0
    row = np.take_along_axis(chunk_rows[:, :, None].repeat(FILTERS, 2), pick[:, None, :], 1)[:, 0]
    at = real.reshape(-1, BLOCK)[row, where[row, np.arange(FILTERS)]]
    g_table = np.empty_like(net.table)
    columns = np.broadcast_to(np.arange(FILTERS), at.shape)
    for j in range(WIDTH):
        index = data[2 * at + j].astype(np.int64) * FILTERS + columns
        g_table[j] = np.bincount(index.ravel(), d_chunk.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return [g_table, d_chunk.sum(axis=0), g_w1, g_b1, g_w2, g_b2]


def fold(id_col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; 0 is held out."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bound: TrainingBound | None = None) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels of the labelled rows, not held out, with the least hashed ids.

    At most ``bound.rows`` rows, of texts of at most ``bound.text_bytes``. An id that
    is labelled both ways counts as 0; null ids and labels other than 0 and 1 don't
    count; a null text is an empty one.
    """
    bound = bound or TrainingBound()
    label = F.col(f"`{label_col}`")
    usable = labels.where((fold() != 0) & label.isin(0, 1)).groupBy("doc_id").agg(F.min(label.cast("int")).alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    chosen = usable.orderBy(*order).limit(bound.rows)
    own = document_columns(docs)
    own = own.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= bound.text_bytes)
    rows = own.join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").limit(bound.rows).collect()
    return [(r["text"] or "").encode() for r in rows], [r["label"] for r in rows]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bound: TrainingBound | None = None) -> Network:
    """A network trained on :func:`training_rows`; without any, an untrained one."""
    bound = bound or TrainingBound()
    return train(*training_rows(docs, labels, label_col, bound), bound)


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score`` (double, 0 to 1) of every whole text and ``carry``, one row per input row.

    Null texts score as empty ones; whole texts are read, however long; repeated
    rows stay repeated and score alike; a null id stays null. Nothing but the text
    enters the score. Other columns are ignored, whatever their names; a carried
    column that has a name of the result is an error; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a fixed number of weights
    own = document_columns(docs, id_col, text_col, carry)
    names, more = carried(own, carry, ("doc_id", "score"))

    def run(batches):
        net = shared.value
        for part in slices(batches):
            scores = [net.score((x or "").encode()) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores, pa.float64()), *[part.column(c) for c in names]],
                names=["doc_id", "score", *carry],
            )

    return own.mapInArrow(run, "doc_id long, score double" + more)
