"""The chunked container: a header, metadata, tiles, an end."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ..schemas import CHUNK_FLAGS, MAGIC, VERSION
from . import CodecError

HEADER = struct.Struct("<IIBBBBHBHH")
TILE = struct.Struct("<HHBI")
CHUNK, VERSION_OF = struct.Struct("<4sBI"), struct.Struct("<H")
ANIMATION, FRAME = struct.Struct("<IHI"), struct.Struct("<HBBHHHHI")
# Chunk types with the flags they are written with, in their order in a file.
TYPES = {"FHDR": 0, "META": CHUNK_FLAGS["optional"] | CHUNK_FLAGS["meta_only"], "ICCP": CHUNK_FLAGS["optional"], "PROV": CHUNK_FLAGS["optional"], "ANIM": 0, "TILE": CHUNK_FLAGS["repeatable"], "FEND": 0}
BEFORE_TILES = ("META", "ICCP", "PROV", "ANIM")


@dataclass
class Header:
    width: int
    height: int
    bit_depth: int = 8
    primaries: int = 1
    transfer: int = 13
    matrix: int = 1
    flags: int = 0
    tile_size_log2: int = 10
    max_cll: int = 0
    max_fall: int = 0

    def pack(self) -> bytes:
        return HEADER.pack(self.width, self.height, self.bit_depth, self.primaries, self.transfer, self.matrix, self.flags, self.tile_size_log2, self.max_cll, self.max_fall)

    @classmethod
    def parse(cls, data: bytes) -> Header:
        if len(data) < HEADER.size:
            raise CodecError("TruncatedInput", "header")
        h = cls(*HEADER.unpack_from(data))
        if not h.width or not h.height:
            raise CodecError("InvalidHeader", "a dimension is zero")
        if h.bit_depth not in (8, 10, 12):
            raise CodecError("InvalidBitDepth", str(h.bit_depth))
        if not 6 <= h.tile_size_log2 <= 10:
            raise CodecError("InvalidHeader", f"tile size 2 to the power {h.tile_size_log2}")
        return h


@dataclass
class Animation:
    loop_count: int = 0
    background: int = 0
    frames: list[tuple] = field(default_factory=list)  # delay, blend, disposal, x, y, w, h, tile offset

    def pack(self) -> bytes:
        return ANIMATION.pack(len(self.frames), self.loop_count, self.background) + b"".join(FRAME.pack(*f) for f in self.frames)

    @classmethod
    def parse(cls, data: bytes) -> Animation:
        if len(data) < ANIMATION.size:
            raise CodecError("TruncatedInput", "animation")
        n, loops, background = ANIMATION.unpack_from(data)
        if len(data) - ANIMATION.size < n * FRAME.size:  # before anything is made for n frames
            raise CodecError("TruncatedInput", f"{n} animation frames")
        return cls(loops, background, [FRAME.unpack_from(data, ANIMATION.size + i * FRAME.size) for i in range(n)])


@dataclass
class Tile:
    x: int
    y: int
    layer_flags: int
    payload: bytes

    def pack(self) -> bytes:
        return TILE.pack(self.x, self.y, self.layer_flags, len(self.payload)) + self.payload

    @classmethod
    def parse(cls, data: bytes) -> Tile:
        if len(data) < TILE.size:
            raise CodecError("InvalidChunkSize", "tile chunk is too short")
        x, y, flags, size = TILE.unpack_from(data)
        if len(data) - TILE.size != size:
            raise CodecError("InvalidChunkSize", "tile size doesn't match its chunk")
        return cls(x, y, flags, data[TILE.size :])


def write_chunks(chunks: list[tuple[str, int, bytes]]) -> bytes:
    out = [MAGIC, struct.pack("<H", VERSION)]
    for kind, flags, payload in chunks:
        out += [kind.encode("latin-1"), struct.pack("<BI", flags, len(payload)), payload]
    return b"".join(out)


def write(header: Header, tiles: list[Tile], meta: bytes = b"", icc: bytes = b"", provenance: bytes = b"", animation: Animation | None = None) -> bytes:
    parts = [("FHDR", header.pack()), ("META", meta), ("ICCP", icc), ("PROV", provenance), ("ANIM", animation.pack() if animation else b"")]
    chunks = [(k, TYPES[k], p) for k, p in parts if p] + [("TILE", TYPES["TILE"], t.pack()) for t in tiles] + [("FEND", 0, b"")]
    return write_chunks(chunks)


def read_chunks(data: bytes) -> list[tuple[str, int, bytes]]:
    """(type, flags, payload) in order, after the checks of order and size that a whole file must pass."""
    at, end = len(MAGIC) + VERSION_OF.size, len(data)
    if data[: len(MAGIC)] != MAGIC:
        raise CodecError("InvalidMagic", "not a container")
    if end < at:
        raise CodecError("TruncatedInput", "version")
    if (version := VERSION_OF.unpack_from(data, len(MAGIC))[0]) != VERSION:
        raise CodecError("InvalidVersion", str(version))
    out: list[tuple[str, int, bytes]] = []
    tiles = False
    while at < end:
        if end - at < CHUNK.size:
            raise CodecError("TruncatedInput", f"a chunk's head at {at} of {end}")
        name, flags, size = CHUNK.unpack_from(data, at)
        at += CHUNK.size + size
        if at > end:
            raise CodecError("TruncatedInput", f"a chunk of {size} bytes up to {at} of {end}")
        kind, payload = name.decode("latin-1"), bytes(data[at - size : at])
        if not out and kind != "FHDR":
            raise CodecError("InvalidHeader", "the header isn't first")
        if out and out[-1][0] == "FEND":
            raise CodecError("InvalidChunkType", "a chunk behind the end")
        if out and kind == "FHDR":
            raise CodecError("InvalidHeader", "a second header")
        if kind in BEFORE_TILES and tiles:
            raise CodecError("InvalidChunkType", f"{kind} behind a tile")
        if kind == "FHDR":
            Header.parse(payload)
        elif kind == "ANIM":
            Animation.parse(payload)
        elif kind == "TILE":
            Tile.parse(payload)
            tiles = True
        elif kind == "FEND" and payload:
            raise CodecError("InvalidChunkSize", "the end holds something")
        elif kind not in TYPES and not flags & CHUNK_FLAGS["optional"]:
            raise CodecError("InvalidChunkType", f"unknown required chunk {kind!r}")
        out.append((kind, flags, payload))
    if not out:
        raise CodecError("InvalidHeader", "no header")
    if out[-1][0] != "FEND":
        raise CodecError("InvalidChunkType", "no end")
    return out


def rewrite_meta(data: bytes, meta: bytes) -> bytes:
    """The file with other metadata (none if empty), and the header's flag to match."""
    from ..schemas import FLAGS

    chunks = [c for c in read_chunks(data) if c[0] != "META"]
    h = Header.parse(chunks[0][2])
    h.flags = h.flags | FLAGS["has_meta"] if meta else h.flags & ~FLAGS["has_meta"]
    return write_chunks([("FHDR", 0, h.pack()), *([("META", TYPES["META"], meta)] if meta else []), *chunks[1:]])
