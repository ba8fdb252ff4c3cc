"""The lossy tile: closed-loop prediction, transform and quantisation of 8 x 8 blocks. Each block is foretold from what
a decoder has of its neighbours, so a tile goes block by block; tiles don't know of each other."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions.quality import dead_zones, steps
from ..schemas import LAYERS, ZIGZAG
from . import CodecError, Reader
from .streams import Plan, Syntax, plan_planes, read_modes, read_planes, read_spans, with_flags, write_modes, write_spans

# Layout tags of the six versions of the tile syntax, and the names of the flags of the last.
TAGS = {1: 0x314D4843, 2: 0x324D4843, 3: 0x334D4843, 4: 0x344D4843, 5: 0x354D4843, 6: 0x364D4843}
SPANS, EXTENTS, SPLIT, SHARED, BANK, ELIDE, SIGNIFICANCE, SIGNS = (1 << i for i in range(8))

_K = np.arange(8)
COSINE = (np.where(_K == 0, math.sqrt(1 / 8), 0.5)[:, None] * np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:, None] / 16)).astype(np.float32)
_ZZ = np.array(ZIGZAG)

# --- prediction: each mode picks its 64 samples from a list of values made of the neighbours -----------------------------
# places in the list: above 0-7, left 8-15, corner 16, then means: above with the one before 17-24, left 25-32; above with
# the next 33-40, left 41-48; of both edges 49, of left 50, of above 51; the middle of the range 52
_R, _C = np.divmod(np.arange(64), 8)


def _steep(r: np.ndarray, c: np.ndarray, main: int, side: int, mean: int) -> np.ndarray:
    i = c - r // 2
    return np.where(i < 0, side + np.minimum(r + 2 * (-i - 1), 7), np.where(r % 2 == 1, mean + np.maximum(i, 0), main + np.maximum(i, 0)))


def _flat(r: np.ndarray, c: np.ndarray, main: int, mean: int) -> np.ndarray:
    i = r + c // 2
    return np.where(i >= 8, main + 7, np.where(c % 2 == 1, mean + np.minimum(i, 7), main + np.minimum(i, 7)))


_D = _C - _R
PICK = np.stack([
    np.full(64, 49), _C, 8 + _R, np.zeros(64, int), np.full(64, 50), np.full(64, 51), np.full(64, 52), np.minimum(_C + _R + 1, 7),
    np.where(_D > 0, _D - 1, np.where(_D == 0, 16, 8 + np.maximum(-_D - 1, 0))), _steep(_R, _C, 0, 8, 17), _steep(_C, _R, 8, 0, 25), _flat(_R, _C, 8, 41), _flat(_C, _R, 0, 33),
])
TRUE_MOTION = 3


def _sources(above: np.ndarray | None, left: np.ndarray | None, corner: int, top: int) -> np.ndarray:
    mid = (top + 1) // 2
    a = np.full(8, mid) if above is None else above
    b = np.full(8, mid) if left is None else left
    before = lambda e: (np.concatenate([e[:1], e[:-1]]) + e + 1) // 2
    after = lambda e: (e + np.concatenate([e[1:], e[-1:]]) + 1) // 2
    sa, sb = int(a.sum()), int(b.sum())
    return np.concatenate([a, b, [corner], before(a), before(b), after(a), after(b), [(sa + sb + 8) // 16, (sb + 4) // 8, (sa + 4) // 8, mid]])


def predictions(above: np.ndarray | None, left: np.ndarray | None, corner: int, top: int) -> np.ndarray:
    """13 x 64."""
    s = _sources(above, left, corner, top)
    p = s[PICK]
    p[TRUE_MOTION] = np.clip(s[8 + _R] + s[_C] - corner, 0, top)
    return p


def prediction(mode: int, above: np.ndarray | None, left: np.ndarray | None, corner: int, top: int) -> np.ndarray:
    s = _sources(above, left, corner, top)
    return np.clip(s[8 + _R] + s[_C] - corner, 0, top) if mode == TRUE_MOTION else s[PICK[mode]]


def _half_away(x: np.ndarray) -> np.ndarray:
    return np.trunc(x + np.copysign(np.float32(0.5), x)).astype(np.int64)


def dct(block: np.ndarray) -> np.ndarray:
    return COSINE @ block.reshape(8, 8).astype(np.float32) @ COSINE.T


def idct(f: np.ndarray) -> np.ndarray:
    return COSINE.T @ f.astype(np.float32) @ COSINE


class Quantizer:
    def __init__(self, quality: float, chroma: bool, bit_depth: int):
        self.steps = np.array(steps(quality, chroma, bit_depth), np.int64)
        self.dead = (self.steps * np.array(dead_zones(quality, chroma))).astype(np.float32)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        """Within 1024 of 0, which is what the symbols can say; encoder and decoder see the same."""
        v = f.ravel()[_ZZ]
        q = _half_away(v / self.steps.astype(np.float32))
        return np.clip(np.where(np.abs(v) < self.dead, 0, q), -1024, 1024)


def _samples(q: np.ndarray, step: np.ndarray) -> np.ndarray:
    f = np.zeros(64, np.float32)
    f[_ZZ] = q * step
    return _half_away(idct(f.reshape(8, 8))).ravel()


class Plane:
    """What is known of a plane so far, and the edges of the next block."""

    def __init__(self, width: int, height: int, top: int, corner: int):
        self.w, self.h, self.top, self.corner = width, height, top, corner
        self.bx, self.by = -(-width // 8), -(-height // 8)
        self.v = np.zeros((self.by * 8, self.bx * 8), np.int64)

    def edges(self, by: int, bx: int):
        y, x = by * 8, bx * 8
        above = self.v[y - 1, x : x + 8] if by else None
        left = self.v[y : y + 8, x - 1] if bx else None
        return above, left, int(self.v[y - 1, x - 1]) if by and bx else self.corner

    def put(self, by: int, bx: int, block: np.ndarray) -> None:
        out = np.clip(block, 0, self.top).reshape(8, 8)
        # past the tile's edge there is nothing
        out[max(0, self.h - by * 8) :], out[:, max(0, self.w - bx * 8) :] = 0, 0
        self.v[by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8] = out

    def image(self) -> np.ndarray:
        return self.v[: self.h, : self.w]


def _blocks(plane: np.ndarray, by: int, bx: int) -> np.ndarray:
    out = np.zeros((by * 8, bx * 8), np.int64)
    out[: plane.shape[0], : plane.shape[1]] = plane
    return out.reshape(by, 8, bx, 8).transpose(0, 2, 1, 3).reshape(by, bx, 64)


def _code(originals: list[np.ndarray], top: int, corner: int, quantizer: Quantizer, weight: float) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Planes that share their modes -> modes, coefficients of each, reconstruction of each."""
    h, w = originals[0].shape
    known = [Plane(w, h, top, corner) for _ in originals]
    by, bx = known[0].by, known[0].bx
    source = [_blocks(o, by, bx) for o in originals]
    modes, out = [], [np.zeros((by * bx, 64), np.int64) for _ in originals]
    for y in range(by):
        for x in range(bx):
            p = [predictions(*k.edges(y, x), top) for k in known]
            cost = np.zeros(len(PICK))
            for s, guess in zip(source, p, strict=True):
                r = s[y, x] - guess
                bits = 5 + np.where(r != 0, np.log2(np.abs(r) + 1.0) + 1, 0).sum(axis=1)
                cost += (r * r).sum(axis=1) + weight * bits
            mode = int(np.argmin(cost))
            modes.append(mode)
            for i, k in enumerate(known):
                q = quantizer(dct(source[i][y, x] - p[i][mode]))
                out[i][y * bx + x] = q
                k.put(y, x, _samples(q, quantizer.steps) + p[i][mode])
    return modes, out, [k.image() for k in known]


def _spans(planes: list[np.ndarray]) -> np.ndarray:
    """One more than the last rank at which a plane isn't 0."""
    live = np.zeros(planes[0].shape, bool)
    for p in planes:
        live |= p != 0
    return np.where(live.any(axis=1), 64 - np.argmax(live[:, ::-1], axis=1), 0)


def _lambda(quality: float) -> float:
    return 0.85 * 2 ** ((int(100 - min(100.0, max(0.0, quality))) - 12) / 3)


@dataclass
class Coded:
    """A plane, or the two of chroma, before it is written."""

    steps: np.ndarray
    modes: list[int]
    planes: list[np.ndarray]
    spans: np.ndarray
    memos: dict[tuple[int, ...], dict] = field(default_factory=dict)

    def plans(self, s: Syntax, together: bool = False) -> list[Plan]:
        """The planes, each by itself or all together."""
        groups = [tuple(range(len(self.planes)))] if together else [(i,) for i in range(len(self.planes))]
        return [plan_planes([self.planes[i] for i in g], self.spans, self.extent, s, self.memos.setdefault(g, {})) for g in groups]

    @property
    def extent(self) -> int:
        return int(self.spans.max(initial=0))


def _parts(y: Coded, c: Coded, alpha: Coded | None, dims: tuple[int, int, int, int], flags: int) -> list[bytes | Plan]:
    """As version 4 without flags, 5 if the only flag is the extents', else 6."""
    version = 4 if not flags else 5 if flags == EXTENTS else 6
    s = with_flags(flags)
    out = [np.concatenate([y.steps, c.steps]).astype("<u2").tobytes(), struct.pack("<4HI", *dims, TAGS[version])]
    if version == 6:
        out.append(bytes([flags]))
    out += [write_modes(y.modes), write_modes(c.modes), write_spans(y.spans, flags & SPANS), write_spans(c.spans, flags & SPANS)]
    if s.extents:
        out.append(bytes([y.extent, c.extent]))
    out += [*y.plans(s), *c.plans(s, bool(flags & SHARED))]
    if alpha is not None:
        out += [alpha.steps.astype("<u2").tobytes(), write_modes(alpha.modes), write_spans(alpha.spans, flags & SPANS)]
        if s.extents:
            out.append(bytes([alpha.extent]))
        out += alpha.plans(s)
    return out


def _size(parts: list[bytes | Plan]) -> int:
    return sum(p.size if isinstance(p, Plan) else len(p) for p in parts)


def _payload(parts: list[bytes | Plan], flags: int) -> bytes:
    return b"".join(p.bytes(with_flags(flags)) if isinstance(p, Plan) else p for p in parts)


def encode_tile(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, alpha: np.ndarray | None, quality: float, luma_quality: float, chroma_quality: float, bit_depth: int = 8, flags: int | None = None) -> tuple[bytes, float]:
    """Planes of a tile (chroma may be halved) -> payload, score. flags: as given, or each in order if it makes the
    tile smaller."""
    top = (1 << bit_depth) - 1
    qy, qc = Quantizer(luma_quality, False, bit_depth), Quantizer(chroma_quality, True, bit_depth)
    modes, coeffs, seen = _code([y], top, top // 2, qy, _lambda(luma_quality))
    luma = Coded(qy.steps, modes, coeffs, _spans(coeffs))
    modes, coeffs, _ = _code([cb, cr], top, (top + 1) // 2, qc, _lambda(chroma_quality))
    chroma = Coded(qc.steps, modes, coeffs, _spans(coeffs))
    extra = None
    if alpha is not None:
        qa = Quantizer(min(100.0, quality + 10), False, bit_depth)
        modes, coeffs, _ = _code([alpha], top, top, qa, _lambda(min(100.0, quality + 10)))
        extra = Coded(qa.steps, modes, coeffs, _spans(coeffs))
    dims = (-(-y.shape[1] // 8), -(-y.shape[0] // 8), -(-cb.shape[1] // 8), -(-cb.shape[0] // 8))
    mse = float(((y - seen[0]) ** 2).mean())
    score = 100.0 if mse < 1e-10 else min(100.0, max(0.0, (10 * math.log10(top * top / mse) - 20) * 2.5))
    if flags is not None:
        return _payload(_parts(luma, chroma, extra, dims, flags), flags), score
    chosen, best = 0, _parts(luma, chroma, extra, dims, 0)
    for flag in (EXTENTS, SPANS, SPLIT, SHARED, BANK, ELIDE, SIGNIFICANCE, SIGNS):
        if flag == SIGNS and not chosen & SPLIT:
            continue
        if _size(parts := _parts(luma, chroma, extra, dims, chosen | flag)) < _size(best):
            chosen, best = chosen | flag, parts
    return _payload(best, chosen), score


def geometry(tile_x: int, tile_y: int, size: int, width: int, height: int, dims: tuple[int, int, int, int], wanted: str | None = None) -> tuple[int, int, str]:
    """The tile's width and height, and how its chroma is sampled: where both fit, as wanted, else 444."""
    if tile_x * size >= width or tile_y * size >= height:
        raise CodecError("DecodeFailed", "tile outside of the image")
    w, h = min(size, width - tile_x * size), min(size, height - tile_y * size)
    up = lambda n: -(-n // 8)
    if dims[:2] != (up(w), up(h)):
        raise CodecError("DecodeFailed", "luma blocks don't fit the tile")
    fits = [k for k, d in (("444", (up(w), up(h))), ("420", (up((w + 1) // 2), up((h + 1) // 2)))) if dims[2:] == d]
    if not fits:
        raise CodecError("DecodeFailed", "chroma blocks don't fit the tile")
    return w, h, wanted if wanted in fits else fits[0]


def sampling(payload: bytes, tile_x: int, tile_y: int, size: int, width: int, height: int) -> str:
    r = Reader(payload, 256)
    return geometry(tile_x, tile_y, size, width, height, struct.unpack("<4H", r.take(8)))[2]


def _rebuild(modes: list[int], coeffs: np.ndarray, step: np.ndarray, w: int, h: int, top: int, corner: int) -> np.ndarray:
    plane = Plane(w, h, top, corner)
    for n, mode in enumerate(modes):
        y, x = divmod(n, plane.bx)
        plane.put(y, x, _samples(coeffs[n], step) + prediction(mode, *plane.edges(y, x), top))
    return plane.image()


def decode_tile(payload: bytes, tile_x: int, tile_y: int, size: int, width: int, height: int, bit_depth: int, wanted: str | None, has_alpha: bool, tile_alpha: bool) -> dict[str, np.ndarray]:
    """Y, Cb, Cr (and A) of a tile."""
    top = (1 << bit_depth) - 1
    r = Reader(payload)
    step_y, step_c = (np.frombuffer(r.take(128), "<u2").astype(np.int64) for _ in range(2))
    dims = struct.unpack("<4H", r.take(8))
    tag = r.number(4)
    version = next((v for v, t in TAGS.items() if t == tag), None)
    if version is None:
        raise CodecError("DecodeFailed", "unknown tile layout")
    flags = r.number(1) if version == 6 else EXTENTS if version == 5 else 0
    s = with_flags(flags) if version >= 4 else Syntax(adaptive_tables=False)
    w, h, how = geometry(tile_x, tile_y, size, width, height, dims, wanted)
    n_y, n_c = dims[0] * dims[1], dims[2] * dims[3]

    def modes(n: int) -> list[int]:
        if version > 1:
            return read_modes(r, n)
        found = list(r.take(n))
        if any(m > 12 for m in found):
            raise CodecError("PredictionError", "mode out of range")
        return found

    spans = lambda n: read_spans(r, n, bool(flags & SPANS)) if version > 2 else np.full(n, 64)

    def extent(span: np.ndarray) -> int:
        most = r.number(1) if s.extents else 64
        if most > 64 or span.max(initial=0) > most:
            raise CodecError("DecodeFailed", "a span passes its plane's extent")
        return most

    modes_y, modes_c = modes(n_y), modes(n_c)
    span_y, span_c = spans(n_y), spans(n_c)
    most_y, most_c = (r.number(1), r.number(1)) if s.extents else (64, 64)
    if max(most_y, most_c) > 64 or span_y.max(initial=0) > most_y or span_c.max(initial=0) > most_c:
        raise CodecError("DecodeFailed", "a span passes its plane's extent")
    (q_y,) = read_planes(r, 1, span_y, most_y, s)
    q_c = read_planes(r, 2, span_c, most_c, s) if flags & SHARED else [read_planes(r, 1, span_c, most_c, s)[0] for _ in range(2)]
    cw, ch = (w, h) if how == "444" else ((w + 1) // 2, (h + 1) // 2)
    out = {"Y": _rebuild(modes_y, q_y, step_y, w, h, top, top // 2)}
    for name, q in zip(("Cb", "Cr"), q_c, strict=True):
        out[name] = _rebuild(modes_c, q, step_c, cw, ch, top, (top + 1) // 2)
    if has_alpha != tile_alpha:
        raise CodecError("DecodeFailed", "alpha of tile and image differ")
    if has_alpha:
        step_a = np.frombuffer(r.take(128), "<u2").astype(np.int64)
        modes_a, span_a = modes(n_y), spans(n_y)
        (q_a,) = read_planes(r, 1, span_a, extent(span_a), s)
        out["A"] = _rebuild(modes_a, q_a, step_a, w, h, top, top)
    if r.left:
        raise CodecError("InvalidChunkSize", "bytes behind the tile")
    return out


def layer_flags(alpha: bool) -> int:
    return LAYERS["base"] | (LAYERS["alpha"] if alpha else 0)
