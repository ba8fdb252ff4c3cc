"""EXIF: the block in a file, and the entries that it holds."""

from __future__ import annotations

import datetime as dt

from . import CodecError
from .metablock import Entry

# Bytes of each TIFF type, and the tags that are read.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
MAKE, MODEL, SOFTWARE, EXIF_IFD, GPS_IFD, ISO = 0x010F, 0x0110, 0x0131, 0x8769, 0x8825, 0x8827
GPS = {"lat_ref": 1, "lat": 2, "lon_ref": 3, "lon": 4, "alt_ref": 5, "alt": 6, "time": 7, "date": 29}


def find(data: bytes) -> bytes | None:
    """The TIFF block: the data itself, behind an Exif mark, or in a JPEG's APP1 segment."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:6] == b"Exif\0\0":
        return data[6:]
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind in (0xD9, 0xDA) or size < 2:
            return None
        body = data[at + 4 : at + 2 + size]
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            return body[6:]
        at += 2 + size
    return None


class Tiff:
    def __init__(self, data: bytes):
        if data[:2] not in (b"II", b"MM") or len(data) < 8:
            raise CodecError("MetaError", "not a TIFF block")
        self.data, self.order = data, "little" if data[:2] == b"II" else "big"
        if self.number(2, 2) != 42:
            raise CodecError("MetaError", "not a TIFF block")

    def number(self, at: int, n: int, signed: bool = False) -> int:
        if at < 0 or at + n > len(self.data):
            raise CodecError("TruncatedInput", f"{n} bytes at {at}")
        return int.from_bytes(self.data[at : at + n], self.order, signed=signed)

    def directory(self, at: int) -> dict[int, tuple[int, int, int]]:
        """tag -> type, count, place of the value."""
        out = {}
        for i in range(self.number(at, 2)):
            e = at + 2 + 12 * i
            tag, kind, count = self.number(e, 2), self.number(e + 2, 2), self.number(e + 4, 4)
            size = SIZES.get(kind, 1) * count
            out[tag] = (kind, count, e + 8 if size <= 4 else self.number(e + 8, 4))
        return out

    def values(self, entry: tuple[int, int, int]) -> list:
        kind, count, at = entry
        n = SIZES.get(kind, 1)
        if at + n * count > len(self.data):
            raise CodecError("TruncatedInput", "value")
        if kind == 2:
            return [self.data[at : at + count].split(b"\0")[0].decode("utf-8", "replace")]
        if kind in (5, 10):
            pairs = [(self.number(at + 8 * i, 4, kind == 10), self.number(at + 8 * i + 4, 4, kind == 10)) for i in range(count)]
            return [a / b if b else 0.0 for a, b in pairs]
        return [self.number(at + n * i, n, kind == 9) for i in range(count)]


def micros(date: str, time: list[float]) -> int | None:
    try:
        day = dt.datetime.strptime(date, "%Y:%m:%d").replace(tzinfo=dt.UTC)
    except ValueError:
        return None
    us = int(day.timestamp()) * 1_000_000 + int((time[0] * 3600 + time[1] * 60 + time[2]) * 1_000_000 + 0.5)
    return us if us >= 0 else None


def entries(tiff: bytes) -> list[Entry]:
    """Make, model, software, sensitivity, position, altitude and time; what can't be read is left out."""
    t = Tiff(tiff)
    root = t.directory(t.number(4, 4))
    out = [Entry(1, tag, 10, t.values(root[k])[0]) for k, tag in ((MAKE, 1), (MODEL, 2), (SOFTWARE, 18)) if k in root and root[k][0] == 2]
    for k in (EXIF_IFD, GPS_IFD):
        if k not in root:
            continue
        try:
            d = t.directory(t.values(root[k])[0])
            if k == EXIF_IFD:
                if ISO in d:
                    out.append(Entry(1, 10, 3, t.values(d[ISO])[0]))
                continue
            have = {name: t.values(d[tag]) for name, tag in GPS.items() if tag in d}
            for name, tag in (("lat", 1), ("lon", 2)):
                if len(v := have.get(name, [])) == 3:
                    deg = v[0] + v[1] / 60 + v[2] / 3600
                    out.append(Entry(2, tag, 7, -deg if have.get(f"{name}_ref", [""])[0] in ("S", "W") else deg))
            if "alt" in have:
                out.append(Entry(2, 3, 6, -have["alt"][0] if have.get("alt_ref", [0])[0] == 1 else have["alt"][0]))
            if len(have.get("time", [])) == 3 and "date" in have and (us := micros(have["date"][0], have["time"])) is not None:
                out.append(Entry(2, 17, 14, us))
        except CodecError:
            continue
    return out
