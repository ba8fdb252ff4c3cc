"""Colour transforms of one sample or pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import RGB, YCBCR


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def _ranges(bit_depth: int, full_range: bool) -> tuple[float, float, float, float]:
    """Luma offset and span, chroma offset and span."""
    top = float((1 << bit_depth) - 1)
    if full_range:
        return 0.0, top, top / 2, top
    low, y_top, c_top = 16 * top / 255, 235 * top / 255, 240 * top / 255
    return low, y_top - low, (low + c_top) / 2, c_top - low


def _weigh(w: tuple[float, float, float], r: Column, g: Column, b: Column) -> Column:
    return F.lit(w[0]) * r + F.lit(w[1]) * g + F.lit(w[2]) * b


def rgb_to_ycbcr(r: Column, g: Column, b: Column, matrix: int = 1, bit_depth: int = 8, full_range: bool = True) -> tuple[Column, Column, Column]:
    """Whole-numbered Y, Cb, Cr; unknown matrices count as 1."""
    top = float((1 << bit_depth) - 1)
    y_off, y_span, c_off, c_span = _ranges(bit_depth, full_range)
    r, g, b = (x.cast("double") / F.lit(top) for x in (r, g, b))
    out = []
    for w, off, span in zip(YCBCR.get(matrix, YCBCR[1]), (y_off, c_off, c_off), (y_span, c_span, c_span), strict=True):
        out.append(F.round(clamp(_weigh(w, r, g, b) * F.lit(span) + F.lit(off), 0, top)).cast("int"))
    return tuple(out)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, matrix: int = 1, bit_depth: int = 8, full_range: bool = True) -> tuple[Column, Column, Column]:
    top = float((1 << bit_depth) - 1)
    y_off, y_span, c_off, c_span = _ranges(bit_depth, full_range)
    y = (y - F.lit(y_off)) / F.lit(y_span)
    cb, cr = ((c - F.lit(c_off)) / F.lit(c_span) for c in (cb, cr))
    r_cr, g_cb, g_cr, b_cb = (F.lit(x) for x in RGB.get(matrix, RGB[1]))
    return tuple(F.floor(clamp(x, 0, 1) * F.lit(top) + F.lit(0.5)).cast("int") for x in (y + r_cr * cr, y + g_cb * cb + g_cr * cr, y + b_cb * cb))


def alpha_to_8bit(a: Column, top: int) -> Column:
    """A sample of 0..top as 0..255, by whole division."""
    return scale_to_8bit(a, top)


def ycbcr_exact(r: Column, g: Column, b: Column, top: float = 255.0) -> tuple[Column, Column, Column]:
    """Y, Cb, Cr as metrics take them: matrix 1, clamped, not rounded."""
    r, g, b = (x.cast("double") / F.lit(top) for x in (r, g, b))
    y, cb, cr = (_weigh(w, r, g, b) for w in YCBCR[1])
    return clamp(y * F.lit(top), 0, top), clamp(cb * F.lit(top) + F.lit(top / 2), 0, top), clamp(cr * F.lit(top) + F.lit(top / 2), 0, top)


def subtract_green(r: Column, g: Column, b: Column, modulus: int = 256) -> tuple[Column, Column, Column]:
    return F.pmod(r - g, F.lit(modulus)), g, F.pmod(b - g, F.lit(modulus))


def add_green(r: Column, g: Column, b: Column, modulus: int = 256) -> tuple[Column, Column, Column]:
    return F.pmod(r + g, F.lit(modulus)), g, F.pmod(b + g, F.lit(modulus))


def decorrelate(r: Column, g: Column, b: Column, g_r: Column, g_b: Column, r_b: Column) -> tuple[Column, Column, Column]:
    """Factors are in 32nds; shifts are arithmetic, samples modulo 256."""
    byte = lambda c: c.bitwiseAND(F.lit(255))
    return byte(r - F.shiftright(g * g_r, 5)), g, byte(b - F.shiftright(g * g_b, 5) - F.shiftright(r * r_b, 5))


def recorrelate(r: Column, g: Column, b: Column, g_r: Column, g_b: Column, r_b: Column) -> tuple[Column, Column, Column]:
    byte = lambda c: c.bitwiseAND(F.lit(255))
    red = byte(r + F.shiftright(g * g_r, 5))
    return red, g, byte(b + F.shiftright(g * g_b, 5) + F.shiftright(red * r_b, 5))


def pack_argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    wide = [x.cast("bigint") for x in (a, r, g, b)]
    return F.shiftleft(wide[0], 24).bitwiseOR(F.shiftleft(wide[1], 16)).bitwiseOR(F.shiftleft(wide[2], 8)).bitwiseOR(wide[3])


def unpack_argb(p: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.shiftright(p, n).bitwiseAND(F.lit(255)).cast("int") for n in (24, 16, 8, 0))


def luma_77(r: Column, g: Column, b: Column) -> Column:
    """Luma in whole numbers, by weights of 256ths."""
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def scale_to_8bit(sample: Column, top: int) -> Column:
    return F.floor((sample * 255 + top // 2) / top).cast("int")


def le16(data: Column, at: Column) -> Column:
    """The unsigned 16-bit number of two bytes, the low one first, at a place from 0 of a binary column."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")
    return byte(at + 1) + byte(at + 2) * 256


# --- transfer functions; constants are fixed values ----------------------------------------------------------------

PQ = {"m1": 0.1593017578125, "m2": 78.84375, "c1": 0.8359375, "c2": 18.8515625, "c3": 18.6875, "peak": 10000.0}
HLG = {"a": 0.17883277, "b": 0.28466892, "c": 0.55991073}


def pq_eotf(v: Column) -> Column:
    p = F.pow(v, F.lit(1 / PQ["m2"]))
    above, below = F.greatest(p - PQ["c1"], F.lit(0.0)), F.lit(PQ["c2"]) - F.lit(PQ["c3"]) * p
    return F.when((v <= 0) | (below <= 0), 0.0).otherwise(F.lit(PQ["peak"]) * F.pow(above / F.when(below > 0, below), F.lit(1 / PQ["m1"])))


def pq_oetf(y: Column) -> Column:
    p = F.pow(y / F.lit(PQ["peak"]), F.lit(PQ["m1"]))
    return F.when(y <= 0, 0.0).otherwise(F.pow((F.lit(PQ["c1"]) + F.lit(PQ["c2"]) * p) / (1 + F.lit(PQ["c3"]) * p), F.lit(PQ["m2"])))


def hlg_oetf(e: Column) -> Column:
    return F.when(e <= 0, 0.0).when(e <= 1 / 12, F.sqrt(3 * e)).otherwise(F.lit(HLG["a"]) * F.ln(12 * F.greatest(e, F.lit(1 / 12)) - HLG["b"]) + HLG["c"])


def hlg_inverse_oetf(v: Column) -> Column:
    return F.when(v <= 0, 0.0).when(v <= 0.5, v * v / 3).otherwise((F.exp((v - HLG["c"]) / HLG["a"]) + HLG["b"]) / 12)


def hlg_ootf(y: Column, gamma: float = 1.2) -> Column:
    return F.pow(y, F.lit(gamma))


def bt709_oetf(v: Column) -> Column:
    return F.when(v < 0.018, 4.5 * v).otherwise(1.099 * F.pow(v, F.lit(0.45)) - 0.099)


def bt709_eotf(v: Column) -> Column:
    return F.when(v < 0.081, v / 4.5).otherwise(F.pow((v + 0.099) / 1.099, F.lit(1 / 0.45)))


def srgb_oetf(v: Column) -> Column:
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def srgb_eotf(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_linear(v: Column, transfer: Column) -> Column:
    """By transfer code: 1 BT.709, 16 PQ, 18 HLG, 13 and any other sRGB."""
    return F.when(transfer == 1, bt709_eotf(v)).when(transfer == 16, pq_eotf(v)).when(transfer == 18, hlg_inverse_oetf(v)).otherwise(srgb_eotf(v))


def from_linear(v: Column, transfer: Column) -> Column:
    return F.when(transfer == 1, bt709_oetf(v)).when(transfer == 16, pq_oetf(v)).when(transfer == 18, hlg_oetf(v)).otherwise(srgb_oetf(v))
