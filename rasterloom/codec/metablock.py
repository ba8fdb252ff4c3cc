"""The binary form of metadata: a version, a count, and typed entries."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from . import CodecError, Reader

MAX_DEPTH = 16
# Struct formats of the types of fixed size.
FIXED = {1: "<B", 2: "<H", 3: "<I", 4: "<Q", 5: "<i", 6: "<f", 7: "<d", 8: "<ii", 14: "<q"}
LSTR, STR, BYTES, ARRAY, STRUCT, UUID = 9, 10, 11, 12, 13, 15


@dataclass
class Entry:
    """value: a number, (numerator, denominator), (lang, text), text, bytes, (type, list) of an array, entries of a struct,
    or 16 bytes. opaque: the bytes of a type that isn't known."""

    ns: int
    tag: int
    type_id: int
    value: object = None
    opaque: bytes | None = None


def pack_value(kind: int, v) -> bytes:
    if kind in FIXED:
        return struct.pack(FIXED[kind], *(v if isinstance(v, tuple) else (v,)))
    if kind == LSTR:
        lang, text = v[0].encode(), v[1].encode()
        if len(lang) > 255:
            raise CodecError("MetaError", "language is too long")
        return bytes([len(lang)]) + lang + text
    if kind == STR:
        return v.encode()
    if kind in (BYTES, UUID):
        return bytes(v)
    if kind == ARRAY:
        of, items = v
        return struct.pack("<HB", len(items), of) + b"".join(pack_value(of, x) for x in items)
    if kind == STRUCT:
        return struct.pack("<H", len(v)) + b"".join(map(pack_entry, v))
    raise CodecError("MetaError", f"type {kind}")


def pack_entry(e: Entry) -> bytes:
    body = e.opaque if e.opaque is not None else pack_value(e.type_id, e.value)
    return struct.pack("<BHBI", e.ns, e.tag, e.type_id, len(body)) + body


def pack(entries: list[Entry]) -> bytes:
    return struct.pack("<BH", 1, len(entries)) + b"".join(map(pack_entry, entries))


def parse_value(kind: int, data: bytes, depth: int = 0):
    if depth > MAX_DEPTH:
        raise CodecError("MetaError", "nested too deep")
    if kind in FIXED:
        if len(data) != struct.calcsize(FIXED[kind]):
            raise CodecError("MetaError", f"{len(data)} bytes for type {kind}")
        v = struct.unpack(FIXED[kind], data)
        return v if len(v) > 1 else v[0]
    if kind == LSTR:
        if not data or 1 + data[0] > len(data):
            raise CodecError("MetaError", "language string")
        return data[1 : 1 + data[0]].decode("utf-8", "replace"), data[1 + data[0] :].decode("utf-8", "replace")
    if kind == STR:
        return data.decode("utf-8", "replace")
    if kind == BYTES:
        return data
    if kind == UUID:
        if len(data) != 16:
            raise CodecError("MetaError", "identifier")
        return data
    if kind == ARRAY:
        r = Reader(data)
        n, of = r.number(2), r.number(1)
        if n and r.left % n:  # elements have no length: they share the bytes equally
            raise CodecError("MetaError", "array elements differ in size")
        size = r.left // n if n else 0
        return of, [parse_value(of, r.take(size), depth + 1) for _ in range(n)]
    if kind == STRUCT:
        r = Reader(data)
        return [_entry(r, depth + 1) for _ in range(r.number(2))]
    raise CodecError("TypeMismatch", f"type {kind}")


def _entry(r: Reader, depth: int = 0) -> Entry:
    ns, tag, kind, size = r.number(1), r.number(2), r.number(1), r.number(4)
    body = r.take(size)  # the reader is behind the entry whatever its value is
    try:
        return Entry(ns, tag, kind, parse_value(kind, body, depth))
    except CodecError:
        return Entry(ns, tag, kind, opaque=body)


def parse(data: bytes) -> list[Entry]:
    r = Reader(data)
    if r.left < 3 or r.number(1) != 1:
        raise CodecError("MetaError", "not a metadata block")
    return [_entry(r) for _ in range(r.number(2))]


def _short(v: float) -> str:
    """At least six digits, and as many more as tell v from others: from other floats of 32 bits, if it is one with a
    fraction."""
    single = lambda x: struct.pack("<f", x)
    try:
        same = single if v % 1 and struct.unpack("<f", single(v))[0] == v else float
    except OverflowError:
        same = float
    for digits in range(6, 17):
        text = f"{v:.{digits}g}"
        if not math.isfinite(v) or same(float(text)) == same(v):
            return text
    return f"{v:.17g}"


def text_of(e: Entry) -> tuple[str | None, str | None]:
    """The text form of a value, and its language."""
    v = e.value
    if e.opaque is not None:
        return None, None
    if e.type_id == LSTR:
        return v[1], v[0]
    if e.type_id == 8:
        return f"{v[0]}/{v[1]}", None
    if e.type_id == 6:
        return _short(v), None
    if e.type_id == 7:
        return repr(v), None
    if e.type_id == BYTES:
        return f"<{len(v)} bytes>", None
    if e.type_id == UUID:
        h = v.hex()
        return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", None
    if e.type_id == ARRAY:
        return "[" + ", ".join(str(x) for x in v[1]) + "]", None
    if e.type_id == STRUCT:
        import json

        return json.dumps([{"tag": x.tag, "type": x.type_id, "value": text_of(x)[0]} for x in v]), None
    return str(v), None
