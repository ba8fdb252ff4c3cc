"""The lossless tile: a palette with back references, or predicted channels in range-ANS streams."""

from __future__ import annotations

import struct

import numpy as np

from . import CodecError, Reader
from .rans import Table, decode, encode

SELECT = 11
# How far and how long a back reference may be.
WINDOW, SHORTEST, LONGEST = 4096, 3, 258


def predictors(mode: int, l_, t, tr, tl):
    """What a mode foretells from whole numbers or arrays of them."""
    if mode == SELECT:
        dl, dt, dd = abs(t - tl), abs(l_ - tl), abs(l_ + t - 2 * tl)
        return np.where((dl <= dt) & (dl <= dd), l_, np.where(dt <= dd, t, tl))
    simple = [lambda: 0 * l_, lambda: l_, lambda: t, lambda: tr, lambda: tl, lambda: (l_ + t + 1) // 2, lambda: (l_ + t + tr + 1) // 3, lambda: (l_ + tl + 1) // 2, lambda: (t + tr + 1) // 2, lambda: (t + tl + 1) // 2, lambda: (l_ + t + tr + tl + 2) // 4, None, lambda: np.clip(l_ + t - tl, 0, 255)]
    if not 0 <= mode < len(simple):
        raise CodecError("PredictionError", f"mode {mode}")
    return simple[mode]()


def _neighbours(c: np.ndarray) -> tuple[np.ndarray, ...]:
    l_, t, tl = (np.zeros_like(c) for _ in range(3))
    l_[:, 1:], t[1:], tl[1:, 1:] = c[:, :-1], c[:-1], c[:-1, :-1]
    tr = t.copy()
    tr[1:, :-1] = c[:-1, 1:]
    return l_, t, tr, tl


def references(indices: bytes) -> list[tuple[int, int] | int]:
    """Greedy: the longest match in the window, the nearest of equals; a literal where there is none of 3 or more."""
    out: list = []
    i, n = 0, len(indices)
    while i < n:
        best, far = 0, 0
        size = min(LONGEST, n - i)
        while best < size:
            # the nearest earlier place that matches one character more than the best so far
            at = indices.rfind(indices[i : i + best + 1], max(0, i - WINDOW), i + best)
            if at < 0:
                break
            far, best = i - at, best + 1
            while best < size and indices[i + best] == indices[at + best]:
                best += 1
        if best >= SHORTEST:
            out.append((far, best))
            i += best
        else:
            out.append(indices[i])
            i += 1
    return out


def expand(tokens: list, n: int) -> bytes:
    out = bytearray()
    for tok in tokens:
        if isinstance(tok, tuple):
            far, size = tok
            if not 0 < far <= len(out) or len(out) + size > n:
                raise CodecError("DecodeFailed", "back reference out of range")
            for _ in range(size):
                out.append(out[-far])
        else:
            if len(out) >= n:
                raise CodecError("DecodeFailed", "too many literals")
            out.append(tok)
    if len(out) != n:
        raise CodecError("DecodeFailed", f"{len(out)} of {n} indices")
    return bytes(out)


def encode_tile(rgba: np.ndarray, mode: int = SELECT) -> bytes:
    """height x width x 4 bytes."""
    h, w = rgba.shape[:2]
    flat = np.ascontiguousarray(rgba, dtype=np.uint8).view("<u4").ravel()
    colours, first, index = np.unique(flat, return_index=True, return_inverse=True)
    if len(colours) <= 256:
        order = np.argsort(first)  # colours by first place
        rank = np.empty(len(order), np.uint8)
        rank[order] = np.arange(len(order))
        tokens = references(rank[index].tobytes())
        body = b"".join(struct.pack("<BHH", 1, *t) if isinstance(t, tuple) else struct.pack("<BB", 0, t) for t in tokens)
        return struct.pack("<BBH", 1, mode, len(colours)) + colours[order].astype("<u4").tobytes() + struct.pack("<I", len(tokens)) + body
    c = rgba.astype(np.int32)
    c[:, :, 0] = (c[:, :, 0] - c[:, :, 1]) & 255
    c[:, :, 2] = (c[:, :, 2] - c[:, :, 1]) & 255
    out = [struct.pack("<BB", 0, mode)]
    for k in range(4):
        residual = ((c[:, :, k] - predictors(mode, *_neighbours(c[:, :, k]))) & 255).ravel()
        table = Table.of_counts(np.bincount(residual, minlength=256).tolist())
        data = encode(residual.tolist(), table)
        out += [np.array(table.freq, "<u2").tobytes(), struct.pack("<I", len(data)), data]
    return b"".join(out)


def _unpredict(residual: list[int], h: int, w: int, mode: int) -> np.ndarray:
    """Each sample needs those before it, so this goes one by one; modes that need one neighbour alone go at once."""
    r = np.array(residual, np.int64).reshape(h, w)
    if mode == 0:
        return r
    if mode in (1, 2):
        return np.cumsum(r, axis=2 - mode) & 255
    if not 0 <= mode <= 12:
        raise CodecError("PredictionError", f"mode {mode}")
    rows, above = [], [0] * w
    for y in range(h):
        row, l_, tl = [], 0, 0
        line = residual[y * w : (y + 1) * w]
        for x in range(w):
            t = above[x]
            if mode == SELECT:
                dl, dt = abs(t - tl), abs(l_ - tl)
                dd = abs(l_ + t - 2 * tl)
                p = l_ if dl <= dt and dl <= dd else t if dt <= dd else tl
            elif mode == 12:
                p = min(255, max(0, l_ + t - tl))
            else:
                tr = above[x + 1] if y and x + 1 < w else t
                p = int(predictors(mode, l_, t, tr, tl))
            l_ = (line[x] + p) & 255
            row.append(l_)
            tl = t
        rows.append(row)
        above = row
    return np.array(rows)


def decode_tile(data: bytes, width: int, height: int) -> np.ndarray:
    r = Reader(data)
    palette, mode = r.number(1), r.number(1)
    n = width * height
    if palette:
        count = r.number(2)
        if not 0 < count <= 256:
            raise CodecError("DecodeFailed", f"palette of {count}")
        colours = np.frombuffer(r.take(4 * count), "<u4")
        tokens: list = []
        for _ in range(min(r.number(4), n + 1)):
            if r.number(1):
                tokens.append((r.number(2), r.number(2)))
            else:
                tokens.append(r.number(1))
        index = np.frombuffer(expand(tokens, n), np.uint8)
        if len(index) and index.max() >= count:
            raise CodecError("DecodeFailed", "index behind the palette")
        return colours[index].view(np.uint8).reshape(height, width, 4)
    out = np.empty((height, width, 4), np.int64)
    for k in range(4):
        freqs = np.frombuffer(r.take(512), "<u2").tolist()
        table = Table.of_counts(freqs)
        residual = decode(r.take(r.number(4)), n, table)
        out[:, :, k] = _unpredict(residual, height, width, mode)
    out[:, :, 0] = (out[:, :, 0] + out[:, :, 1]) & 255
    out[:, :, 2] = (out[:, :, 2] + out[:, :, 1]) & 255
    return out.astype(np.uint8)
