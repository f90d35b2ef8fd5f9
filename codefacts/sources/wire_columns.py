"""Many protobuf messages at once: columns of fields to bytes and back, by the same descriptions of fields as in wire.

A column of N messages is a dict of its fields: numbers for INT and BOOL, a pa.StringArray for TEXT, (numbers, counts) for INTS, (pa.StringArray, counts) for
repeated texts, (dict, counts) for messages, whether they are repeated or not; counts say how many of them each message has. Work goes by steps over all messages: the first
fields of all, the second ones, and so on. A few long messages that are left are read one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from codefacts.sources import wire
from codefacts.sources.wire import _EIGHT, _FOUR, _LENGTH, _VARINT, BOOL, INT, INTS, TEXT, Fields

#: So many messages are worth a step over all of them.
FEW = 16


def _starts(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of pieces, one piece after another."""
    return np.repeat(starts - _starts(lengths)[:-1], lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


def _grouped(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The lengths of groups of so many pieces each."""
    return np.diff(_starts(lengths)[_starts(counts)])


def _array(data: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """What stands between places of data that follow one another."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(pieces: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (bytes, lengths) of n messages, put together message by message."""
    if not pieces or not n:
        return np.empty(0, np.uint8), np.zeros(n, np.int64)
    out, ends = own_bytes(pc.binary_join_element_wise(*[_array(data, _starts(lengths)) for data, lengths in pieces], pa.scalar(b"", pa.large_binary())))
    return out, np.diff(ends)


def _cut(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes of pieces, one piece after another. Pieces that stand in order, as fields do, are copied whole."""
    none = low == high
    last = np.maximum.accumulate(high) if len(high) else high
    ends = np.stack([np.where(none, last, low), np.where(none, last, high)], axis=1).ravel()
    if not len(ends) or (ends[1:] < ends[:-1]).any():
        return data[_spread(low, high - low)]
    return own_bytes(_array(data, ends).take(pa.array(np.arange(0, len(ends), 2))))[0]


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.asarray(values).astype(np.int64).view(np.uint64)
    lengths = np.ones(len(v), np.int64)
    for shift in range(7, 64, 7):
        more = (v >> np.uint64(shift)) > 0
        if not more.any():
            break
        lengths += more
    starts, out = _starts(lengths), np.empty(int(lengths.sum()), np.uint8)
    for k in range(int(lengths.max(initial=0))):
        own = np.flatnonzero(lengths > k)
        low = ((v[own] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8)
        out[starts[own] + k] = low | np.where(lengths[own] > k + 1, 0x80, 0).astype(np.uint8)
    return out, lengths


def _tagged(number: int, data: np.ndarray, lengths: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces as fields of a stated length; those that aren't there (which have no bytes) stay empty."""
    tag = np.frombuffer(wire._varint(number << 3 | _LENGTH), np.uint8)
    sizes, n_sizes = _varints(lengths[there])
    head = np.zeros(len(lengths), np.int64)
    head[there] = n_sizes
    return _joined([(np.tile(tag, int(there.sum())), np.where(there, len(tag), 0)), (sizes, head), (data, lengths)], len(lengths))


def own_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts or of binary values one after another, and where each begins and the last one ends; nulls are empty."""
    own = pc.fill_null(values.cast(pa.large_binary()), b"")
    _, offsets, data = own.buffers()
    if not len(own):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[own.offset : own.offset + len(own) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = own_bytes(texts)
    return data, np.diff(at)


def encode(fields: Fields, columns: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of n messages, as wire.encode() writes each."""
    pieces = []
    for number, (name, kind) in sorted(fields.items()):
        value = columns.get(name)
        if value is None:
            continue
        if kind in (INT, BOOL):
            own = np.asarray(value).astype(np.int64)
            there = own != 0
            tag = np.frombuffer(wire._varint(number << 3), np.uint8)
            data, lengths = _varints(own[there])
            sizes = np.zeros(n, np.int64)
            sizes[there] = lengths
            pieces += [(np.tile(tag, int(there.sum())), np.where(there, len(tag), 0)), (data, sizes)]
        elif kind == TEXT:
            data, lengths = _bytes_of(value)
            pieces.append(_tagged(number, data, lengths, lengths > 0))
        elif kind == INTS:
            data, lengths = _varints(value[0])
            lengths = _grouped(lengths, value[1])
            pieces.append(_tagged(number, data, lengths, value[1] > 0))
        else:
            (of, counts), one = value, kind[0] if isinstance(kind, list) else kind
            m = int(counts.sum())
            data, lengths = _bytes_of(of) if one == TEXT else encode(one, of, m)
            data, lengths = _tagged(number, data, lengths, np.ones(m, bool))
            pieces.append((data, _grouped(lengths, counts)))
    return _joined(pieces, n)


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(_starts(lengths).astype(np.int32)), pa.py_buffer(data)])


def _read(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number from each place on, and where it ends."""
    value, at, open_ = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for shift in range(0, 70, 7):
        if (at[open_] >= end[open_]).any():
            raise ValueError("a number doesn't end")
        byte = data[at[open_]]
        value[open_] |= (byte & 0x7F).astype(np.uint64) << np.uint64(shift)
        at[open_] += 1
        open_ = open_[byte >= 0x80]
        if not len(open_):
            return value, at
    raise ValueError("a number doesn't end")


def _one_by_one(raw: memoryview, message: int, at: int, end: int, out: list) -> None:
    while at < end:
        tag, at = wire._read_varint(raw, at, end)
        low, form = at, tag & 7
        if form == _VARINT:
            at = wire._read_varint(raw, at, end)[1]
        elif form == _LENGTH:
            size, low = wire._read_varint(raw, at, end)
            at = low + size
        elif form in (_EIGHT, _FOUR):
            at = low + (8 if form == _EIGHT else 4)
        else:
            raise ValueError(f"no field begins with {tag}")
        if at > end:
            raise ValueError(f"field {tag >> 3} goes beyond the end of its message")
        out.append((message, tag >> 3, form, low, at))


def _fields(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of message, number, form, first and last byte (of what the field holds) for all fields of messages, in the order of bytes."""
    at, steps, own = starts.astype(np.int64), [], np.flatnonzero(starts < ends)
    while len(own) > FEW:
        tag, low = _read(data, at[own], ends[own])
        form, number = (tag & np.uint64(7)).astype(np.int64), (tag >> np.uint64(3)).astype(np.int64)
        if not np.isin(form, (_VARINT, _EIGHT, _LENGTH, _FOUR)).all():
            raise ValueError("no field begins with such a number")
        high = low + np.where(form == _EIGHT, 8, np.where(form == _FOUR, 4, 0))
        which = np.flatnonzero((form == _VARINT) | (form == _LENGTH))
        value, after = _read(data, low[which], ends[own][which])
        long = form[which] == _LENGTH
        if (value[long] > (ends[own][which] - after)[long].astype(np.uint64)).any():
            raise ValueError("a field goes beyond the end of its message")
        high[which] = after + np.where(long, value, np.uint64(0)).astype(np.int64)
        low[which] = np.where(long, after, low[which])
        if (high > ends[own]).any():
            raise ValueError("a field goes beyond the end of its message")
        steps.append(np.stack([own, number, form, low, high]))
        at[own] = high
        own = own[high < ends[own]]
    rest: list = []
    raw = memoryview(data)
    for i in own.tolist():
        _one_by_one(raw, i, int(at[i]), int(ends[i]), rest)
    steps.append(np.array(rest, np.int64).reshape(-1, 5).T)
    out = np.concatenate(steps, axis=1)
    if (out[1] == 0).any():
        raise ValueError("no field has number 0")
    return out[:, np.argsort(out[3], kind="stable")]


def _texts(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    lengths = high - low
    own = _cut(data, low, high)
    out = pa.StringArray.from_buffers(len(low), pa.py_buffer(_starts(lengths).astype(np.int32)), pa.py_buffer(own))
    out.validate(full=True)  # a ValueError where the bytes aren't UTF-8
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32).view(np.int32)


def _packed(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in pieces, and how many each piece has."""
    own, lengths = _cut(data, low, high), high - low
    last = own < 0x80
    ends = _starts(lengths)[1:]
    if (~last[ends[lengths > 0] - 1]).any():
        raise ValueError("a number doesn't end")
    after = np.flatnonzero(last) + 1
    before = np.concatenate([[0], after[:-1]]).astype(np.int64)[: len(after)]
    values, _ = _read(own, before, after)
    return _signed(values), np.diff(np.searchsorted(after, np.concatenate([[0], ends]), side="right"))


def decode(fields: Fields, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict:
    """The messages in data[start:end], in ascending places, as a column. Raises ValueError where the bytes aren't messages."""
    n, (message, number, form, low, high) = len(starts), _fields(data, starts, ends)
    out = {}
    for nr, (name, kind) in fields.items():
        own = np.flatnonzero(number == nr)
        of, one = message[own], kind[0] if isinstance(kind, list) else kind
        right = form[own] == (_VARINT if one in (INT, BOOL) else _LENGTH)
        if not (right | ((kind == INTS) & (form[own] == _VARINT))).all():
            raise ValueError(f"{name} is of another kind")
        if kind in (INT, BOOL):
            value = np.zeros(n, np.uint64)
            value[of] = _read(data, low[own], high[own])[0]  # the last one of a message stays
            out[name] = value != 0 if kind == BOOL else _signed(value)
        elif kind == TEXT:
            first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first[of], last[of] = low[own], high[own]
            out[name] = _texts(data, first, last)
        elif kind == INTS:
            values, counts = _packed(data, low[own], high[own])
            out[name] = values, np.bincount(of, counts, n).astype(np.int64)
        else:
            inner = _texts(data, low[own], high[own]) if one == TEXT else decode(one, data, low[own], high[own])
            out[name] = inner, np.bincount(of, minlength=n)  # of a message that isn't repeated, a reader takes the last one
    return out


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_starts(counts).astype(np.int32)), values)
