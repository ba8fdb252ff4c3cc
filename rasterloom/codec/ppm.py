"""Binary PPM of 8 bits."""

from __future__ import annotations

import re

import numpy as np

from . import CodecError

_HEAD = re.compile(rb"P6(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def parse(data: bytes) -> np.ndarray:
    """height x width x 3. One white-space character ends the head; what follows is samples, exactly as many as needed."""
    m = _HEAD.match(data)
    if not m:
        raise CodecError("InvalidHeader", "not a binary PPM")
    w, h, top = map(int, m.groups())
    if not w or not h or top != 255:
        raise CodecError("InvalidHeader", f"{w} x {h}, largest sample {top}")
    if len(data) - m.end() != 3 * w * h:
        raise CodecError("InvalidChunkSize", f"{len(data) - m.end()} bytes for {w} x {h}")
    return np.frombuffer(data, np.uint8, offset=m.end()).reshape(h, w, 3)


def write(image: np.ndarray) -> bytes:
    """Without alpha, if there is one."""
    h, w = image.shape[:2]
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image[:, :, :3], dtype=np.uint8).tobytes()


def write_png(image: np.ndarray) -> bytes:
    import struct
    import zlib

    h, w, n = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * n)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if n == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
