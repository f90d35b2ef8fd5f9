"""The 64-bit text hash that names of anonymous types and method disambiguators carry, value for value.

It is a public hash (wyhash, seed 0) made of 64 x 64 to 128-bit products. A batch of texts is hashed together: numbers are read at all texts' places
at once from the buffer that Arrow hands over, and texts go through their rounds in step, 48 bytes a round, as long as they last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the hash.
SECRET = tuple(map(np.uint64, (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)))
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)
ROUND = 48


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low and the high 64 bits of a * b."""
    a0, a1, b0, b1 = a & _LOW, a >> _HALF, b & _LOW, b >> _HALF
    low, mid, other, high = a0 * b0, a1 * b0, a0 * b1, a1 * b1
    carry = (low >> _HALF) + (mid & _LOW) + (other & _LOW)
    return a * b, high + (mid >> _HALF) + (other >> _HALF) + (carry >> _HALF)


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = _product(a, b)
    return low ^ high


class _Bytes:
    """Little-endian numbers at any places of a buffer."""

    def __init__(self, data: np.ndarray):
        whole = np.concatenate((data, np.zeros(8, np.uint8)))
        self.one, self._eight = whole.astype(np.uint64), np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))

    def eight(self, at: np.ndarray) -> np.ndarray:
        return self._eight[at]

    def four(self, at: np.ndarray) -> np.ndarray:
        return self._eight[at] & _LOW


def _ends_of_short(read: _Bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    few = np.flatnonzero((size > 0) & (size < 4))
    p, n = at[few], size[few]
    a[few] = (read.one[p] << np.uint64(16)) | (read.one[p + (n >> 1)] << np.uint64(8)) | read.one[p + n - 1]
    more = np.flatnonzero(size >= 4)
    p, n = at[more], size[more]
    step, last = (n >> 3) << 2, p + n - 4
    a[more] = (read.four(p) << _HALF) | read.four(p + step)
    b[more] = (read.four(last) << _HALF) | read.four(last - step)
    return a, b


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of each text of a buffer."""
    with np.errstate(over="ignore"):
        read, at, size = _Bytes(data), offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
        state = np.full(len(at), _fold(np.array([SECRET[0]]), np.array([SECRET[1]]))[0])
        a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        short, long = np.flatnonzero(size <= 16), np.flatnonzero(size > 16)
        a[short], b[short] = _ends_of_short(read, at[short], size[short])
        left, place = size.copy(), at.copy()
        lanes = [state, state.copy(), state.copy()]
        wide = go = np.flatnonzero(size > ROUND)
        while len(go):
            p = place[go]
            for i, lane in enumerate(lanes):
                lane[go] = _fold(read.eight(p + 16 * i) ^ SECRET[i + 1], read.eight(p + 16 * i + 8) ^ lane[go])
            place[go], left[go] = p + ROUND, left[go] - ROUND
            go = go[left[go] > ROUND]
        state[wide] ^= lanes[1][wide] ^ lanes[2][wide]
        go = long[left[long] > 16]
        while len(go):
            p = place[go]
            state[go] = _fold(read.eight(p) ^ SECRET[1], read.eight(p + 8) ^ state[go])
            place[go], left[go] = p + 16, left[go] - 16
            go = go[left[go] > 16]
        end = at[long] + size[long]
        a[long], b[long] = read.eight(end - 16), read.eight(end - 8)
        low, high = _product(a ^ SECRET[1], b ^ state)
        return _fold(low ^ SECRET[0] ^ size.astype(np.uint64), high ^ SECRET[1])


@F.pandas_udf(StringType())
def _hex(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for own in texts:
        column = pa.array(own, pa.large_string(), from_pandas=True).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2] if len(column) else None
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        yield pd.Series([f"{x:x}" for x in text_hashes(data, offsets).tolist()], dtype=object).where(own.notna().to_numpy(), None)


def exact_hash(text: Column) -> Column:
    """The hash of a text in lower-case hex without leading zeros, as names carry it; null for null. Batches of texts go through Arrow."""
    return _hex(text)
