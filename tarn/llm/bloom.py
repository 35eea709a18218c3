"""Two Bloom filters: keys seen at least once, and keys seen at least twice.

Filters of parts of the data merge: what either part has seen twice, or both
have seen once, the whole may have seen twice. So every task fills filters of its
own, and segments of the bit arrays, not keys, are shuffled to be merged. The
filters never miss a key; a false hit only sends it to an exact check.

The bit arrays have a stated bound (``MAX_BITS`` unless the caller gives another),
so they may be broadcast at any size of the input. With more keys than a sixteenth of
it a key gets fewer probes, which rejects most with the bits there are; far beyond, the
filters fill up, all keys become suspects, and the exact check that follows carries the
whole load: slower, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BITS = 1 << 28
_SEGMENT = 1 << 19
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def bits_for(keys: int, per_key: int = 16, max_bits: int = MAX_BITS) -> int:
    """Bits of a filter for so many keys: a power of two, one segment unless ``max_bits`` is less."""
    if max_bits < 8 or max_bits & (max_bits - 1):
        raise ValueError("max_bits is a power of two, 8 at least")
    return min(max_bits, max(_SEGMENT, 1 << max(0, keys * per_key - 1).bit_length()))


def probes_for(keys: int, bits: int) -> int:
    """Probes that reject the most keys: 0.69 times the bits a key, from 1 to 5."""
    return min(5, max(1, round(0.69 * bits / max(1, keys))))


class PairFilter:
    """The two bit arrays; ``bits`` is a power of two."""

    def __init__(self, bits: int, probes: int = 5):
        self.bits, self.probes = bits, probes
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        a = mix(keys)
        b = (a >> np.uint64(32)) | np.uint64(1)
        for k in range(self.probes):
            yield (a + np.uint64(k) * b) & np.uint64(self.bits - 1)

    def _hit(self, array: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left = np.arange(len(keys))
        a = mix(keys)
        b = (a >> np.uint64(32)) | np.uint64(1)
        for k in range(self.probes):
            p = (a + np.uint64(k) * b) & np.uint64(self.bits - 1)
            on = array[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1 != 0
            left, a, b = left[on], a[on], b[on]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out

    def seen_once(self, keys: np.ndarray) -> np.ndarray:
        return self._hit(self.once, keys)

    def seen_twice(self, keys: np.ndarray) -> np.ndarray:
        return self._hit(self.twice, keys)

    def _set(self, array: np.ndarray, keys: np.ndarray) -> None:
        for p in self._places(keys):
            np.bitwise_or.at(array, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def add(self, keys: np.ndarray) -> None:
        """Adds sights of keys; equal keys in one call are as many sights."""
        keys, n = np.unique(keys, return_counts=True)
        again = (n > 1) | self.seen_once(keys)
        self._set(self.twice, keys[again])
        self._set(self.once, keys)

    @property
    def segment_bytes(self) -> int:
        return min(_SEGMENT, self.bits) // 8

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = self.segment_bytes
        for k in range(len(self.once) // size):
            once, twice = self.once[k * size : (k + 1) * size], self.twice[k * size : (k + 1) * size]
            if once.any():
                yield k, _packed(once), _packed(twice)


def _packed(bits: np.ndarray) -> bytes:
    """The bytes that aren't zero with their places, or all bytes, whichever is shorter."""
    at = np.flatnonzero(bits)
    if 3 * len(at) < len(bits):
        return b"s" + at.astype("<u2").tobytes() + bits[at].tobytes()
    return b"d" + bits.tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    if data[:1] == b"d":
        return np.frombuffer(data, np.uint8, offset=1)
    n = (len(data) - 1) // 3
    out = np.zeros(size, np.uint8)
    out[np.frombuffer(data, "<u2", n, 1)] = np.frombuffer(data, np.uint8, n, 1 + 2 * n)
    return out


def pair_filter(df: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int, probes: int = 5) -> PairFilter:
    """The filters over all keys that ``keys_of`` makes of the batches of ``df``."""
    whole = PairFilter(bits, probes)
    size = whole.segment_bytes
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    ddl = "segment int, once binary, twice binary"

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def fill(batches):
        own = PairFilter(bits, probes)
        for keys in keys_of(batches):
            own.add(keys)
        for row in own.segments():
            yield batch([row])

    def merge(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, once, twice in zip(*(b.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                once, twice = _unpacked(once, size), _unpacked(twice, size)
                if k in held:
                    first = held[k]
                    first[1] |= twice | (first[0] & once)
                    first[0] |= once
                else:
                    held[k] = [once.copy(), twice.copy()]
        for k, (once, twice) in held.items():
            yield batch([(k, _packed(once), _packed(twice))])

    merged = df.mapInArrow(fill, ddl).repartition("segment").mapInArrow(merge, ddl)
    for k, once, twice in merged.toLocalIterator():  # at most 2 * MAX_BITS bits in all
        whole.once[k * size : (k + 1) * size] = _unpacked(bytes(once), size)
        whole.twice[k * size : (k + 1) * size] = _unpacked(bytes(twice), size)
    return whole
