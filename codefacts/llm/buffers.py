"""Whole-buffer text helpers for Arrow batches: words, and hashes of any span, without a Python loop per character."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES, LONG_SPAN = 2 << 20, 512
_RNG = np.random.default_rng(20_011)
_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; one longer text is a run of its own."""
    data, offsets = utf8(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(length, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Spans:
    """64-bit hashes of spans of one buffer: equal bytes have equal hashes, wherever they stand.

    Sums modulo 2 ** 64 tell spans of up to LONG_SPAN bytes apart, but not all simple patterns of 1024 and more; so longer ones
    are hashed one by one, by another function.
    """

    def __init__(self, data: np.ndarray):
        self._data = data
        size = CHUNK_BYTES + 1
        while size < len(data) + 1:
            size *= 2
        up, self._down = _powers(size)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * up[: len(data)], out=self._sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
        for i in np.flatnonzero(ends - starts > LONG_SPAN):
            out[i] = int.from_bytes(blake2b(self._data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out

    def windows(self, length: int) -> np.ndarray:
        """The hash of each run of `length` bytes."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = self._sums[length:] - self._sums[:n]
        raw *= self._down[:n]
        raw += np.uint64((length * _BASE) & (2**64 - 1))
        return mix(raw)


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words of each row in a buffer; no word crosses rows. between: which bytes part words."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~between[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
