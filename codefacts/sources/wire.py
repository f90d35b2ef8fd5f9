"""Protobuf messages of stored indexes, by their wire format: varints, and fields of a stated length.

A message is described by its fields: number, name, and kind. Unknown fields are passed over, absent ones have their kind's empty value, and
concatenated messages are one message, as the format has it.
"""

from __future__ import annotations

from typing import Any

#: Kinds of fields besides messages (given by their fields) and repeated fields (a list of one kind).
INT, BOOL, TEXT, INTS = "int", "bool", "text", "ints"
Fields = dict[int, tuple[str, Any]]

#: The numbers of the fields, without which other tools couldn't read an index.
RELATIONSHIP: Fields = {1: ("symbol", TEXT), 2: ("is_reference", BOOL), 3: ("is_implementation", BOOL), 4: ("is_type_definition", BOOL), 5: ("is_definition", BOOL)}
SYMBOL: Fields = {1: ("symbol", TEXT), 3: ("documentation", [TEXT]), 4: ("relationships", [RELATIONSHIP])}
OCCURRENCE: Fields = {1: ("range", INTS), 2: ("symbol", TEXT), 3: ("roles", INT)}
DOCUMENT: Fields = {1: ("relative_path", TEXT), 2: ("occurrences", [OCCURRENCE]), 3: ("symbols", [SYMBOL]), 4: ("language", TEXT)}
TOOL: Fields = {1: ("name", TEXT), 2: ("version", TEXT)}
METADATA: Fields = {2: ("tool_info", TOOL), 3: ("project_root", TEXT), 4: ("text_document_encoding", INT)}
INDEX: Fields = {1: ("metadata", METADATA), 2: ("documents", [DOCUMENT]), 3: ("external_symbols", [SYMBOL])}
REFERENCE: Fields = {1: ("range", INTS), 2: ("relative_path", TEXT)}
FORWARD: Fields = {1: ("suffix", TEXT), 2: ("documentation", TEXT), 3: ("references", [REFERENCE])}
FORWARD_INDEX: Fields = {1: ("forward_decls", [FORWARD])}

_VARINT, _EIGHT, _LENGTH, _FOUR = 0, 1, 2, 5


def _varint(value: int) -> bytes:
    value &= 2**64 - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _tagged(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | _LENGTH) + _varint(len(payload)) + payload


def encode(fields: Fields, message: dict) -> bytes:
    """A message (names to values; what isn't there or is empty isn't written) as bytes, fields in the order of their numbers."""
    out = []
    for number, (name, kind) in sorted(fields.items()):
        value = message.get(name)
        if not value:
            continue
        if kind in (INT, BOOL):
            out.append(_varint(number << 3) + _varint(int(value)))
        elif kind == INTS:
            out.append(_tagged(number, b"".join(map(_varint, value))))
        elif isinstance(kind, list):
            out += [_tagged(number, x.encode() if kind[0] == TEXT else encode(kind[0], x)) for x in value]
        else:
            out.append(_tagged(number, value.encode() if kind == TEXT else encode(kind, value)))
    return b"".join(out)


def _read_varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= end or shift > 63:
            raise ValueError("a number doesn't end")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _signed(value: int) -> int:
    """A 32-bit number; negative ones are written with 64 bits."""
    value &= 2**32 - 1
    return value - 2**32 if value >> 31 else value


def _empty(kind: Any) -> Any:
    if kind == INTS or isinstance(kind, list):
        return []
    return {INT: 0, BOOL: False, TEXT: ""}[kind] if isinstance(kind, str) else None


def _numbers(data: bytes, at: int, end: int) -> list[int]:
    out = []
    while at < end:
        value, at = _read_varint(data, at, end)
        out.append(_signed(value))
    return out


def decode(fields: Fields, data: bytes, at: int = 0, end: int | None = None) -> dict:
    """The message in data[at:end]. Raises ValueError where the bytes aren't one."""
    end = len(data) if end is None else end
    out = {name: _empty(kind) for name, kind in fields.values()}
    while at < end:
        tag, at = _read_varint(data, at, end)
        number, form = tag >> 3, tag & 7
        if form == _VARINT:
            value, at = _read_varint(data, at, end)
        elif form in (_EIGHT, _FOUR, _LENGTH):
            size, at = (8 if form == _EIGHT else 4, at) if form != _LENGTH else _read_varint(data, at, end)
            if at + size > end:
                raise ValueError(f"field {number} goes beyond the end of its message")
            value, at = (at, at + size), at + size
        else:
            raise ValueError(f"no field begins with {tag}")
        if not number:
            raise ValueError("no field has number 0")
        if number not in fields:
            continue
        name, kind = fields[number]
        one = kind[0] if isinstance(kind, list) else kind
        if kind == INTS:
            out[name] += [_signed(value)] if form == _VARINT else _numbers(data, *value)
        elif (form == _VARINT) != (one in (INT, BOOL)) or form in (_EIGHT, _FOUR):
            raise ValueError(f"{name} is of another kind")
        elif one in (INT, BOOL):
            out[name] = bool(value) if one == BOOL else _signed(value)
        else:
            read = data[value[0] : value[1]].decode() if one == TEXT else decode(one, data, *value)
            if isinstance(kind, list):
                out[name].append(read)
            else:
                out[name] = read
    return out
