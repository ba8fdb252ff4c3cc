"""Scores of one value: distortion, buckets, quantiser arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ZIGZAG
from .colour import clamp

PERFECT = 100.0


def psnr(mse: Column, top: float = 255.0) -> Column:
    """In dB; 100 where the error is (next to) nothing."""
    return F.when(mse <= 1e-12, PERFECT).otherwise(10 * F.log10(F.lit(top * top) / F.when(mse > 1e-12, mse)))


def tile_score(mse: Column, top: float = 255.0) -> Column:
    """0..100, by PSNR from 20 to 60 dB."""
    db = 10 * F.log10(F.lit(top * top) / F.when(mse >= 1e-10, mse))
    return F.when(mse < 1e-10, PERFECT).otherwise(clamp((db - 20) * 2.5, 0, 100))


def ssim(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, top: float = 255.0) -> Column:
    """Of one window, from its sums."""
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    mx, my = sx / n, sy / n
    vx, vy = F.greatest(F.lit(0.0), sxx / n - mx * mx), F.greatest(F.lit(0.0), syy / n - my * my)
    cov = sxy / n - mx * my
    under = (mx * mx + my * my + c1) * (vx + vy + c2)
    return F.when(under > 0, (2 * mx * my + c1) * (2 * cov + c2) / F.when(under > 0, under)).otherwise(1.0)


def lighting_bucket(mean_luma: Column, dark: Column, bright: Column) -> Column:
    """dark is tested before bright."""
    return F.when((dark >= 0.40) | (mean_luma <= 0.33), "dark").when((bright >= 0.35) | (mean_luma >= 0.62), "bright").otherwise("balanced")


def size_ratio(candidate: Column, reference: Column) -> Column:
    return F.when(reference == 0, 0.0).otherwise(candidate / F.when(reference != 0, reference))


def qp_of(quality: Column) -> Column:
    return (100 - clamp(quality, 0, 100)).cast("int")


def lambda_of(qp: Column) -> Column:
    return 0.85 * F.pow(F.lit(2.0), (qp - 12) / 3.0)


# Quantiser bases, in row-major order.
LUMA_BASE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA_BASE = [
    15, 16, 19, 26, 36, 48, 58, 66,
    16, 18, 21, 30, 40, 54, 64, 72,
    19, 21, 26, 36, 48, 60, 70, 78,
    26, 30, 36, 46, 58, 70, 80, 88,
    36, 40, 48, 58, 70, 82, 90, 96,
    48, 54, 60, 70, 82, 92, 98, 102,
    58, 64, 70, 80, 90, 98, 104, 108,
    66, 72, 78, 88, 96, 102, 108, 112,
]
# Chroma step factors by quality, for zigzag rank 0, under 8, under 24, and the rest.
CHROMA_BANDS = [(90, (0.58, 0.56, 0.58, 0.72)), (85, (0.64, 0.62, 0.63, 0.78)), (75, (0.72, 0.68, 0.64, 0.76)), (1, (0.82, 0.78, 0.74, 0.86))]
# Dead zones: rank 0 and the rest; what quality from 85 and from 75 adds; what ranks from 20 and from 8 add.
DEAD = {False: (0.5, 0.52, 0.03, 0.01, 0.06, 0.03, 0.5), True: (0.44, 0.46, 0.02, 0.0, 0.035, 0.02, 0.42)}


def steps(quality: float, chroma: bool = False, bit_depth: int = 8) -> list[int]:
    """The quantiser step of each zigzag rank."""
    q = min(100.0, max(1.0, quality))
    scale = 5000 / q if q < 50 else 200 - 2 * q
    scale = max(scale, 1.0)
    base = CHROMA_BASE if chroma else LUMA_BASE
    bands = next(b for least, b in CHROMA_BANDS if q >= least) if chroma else (1.0,) * 4
    deep = {8: 1, 10: 4, 12: 16}[bit_depth]
    band = lambda k: bands[0 if k == 0 else 1 if k < 8 else 2 if k < 24 else 3]
    one = np.float32  # steps are cut to whole numbers in single precision
    return [max(1, int(one(base[ZIGZAG[k]]) * one(band(k)) * one(scale) / one(100) * one(deep))) for k in range(64)]


def dead_zones(quality: float, chroma: bool = False) -> list[float]:
    """The share of a step below which a coefficient of each rank is 0."""
    first, rest, by85, by75, by20, by8, low = DEAD[chroma]
    more = by85 if quality >= 85 else by75 if quality >= 75 else 0.0
    return [first] + [min(0.69, max(low, rest + more + (by20 if k >= 20 else by8 if k >= 8 else 0.0))) for k in range(1, 64)]


def quantize(v: Column, step: Column, dead: Column) -> Column:
    """Half away from zero outside of the dead zone, 0 in it."""
    return F.when(F.abs(v) < step * dead, 0).otherwise(F.signum(v) * F.floor(F.abs(v) / step + 0.5)).cast("int")


def signed_symbol(q: Column) -> Column:
    return F.least(F.greatest(q + 1024, F.lit(0)), F.lit(2048))


def magnitude_symbol(q: Column) -> Column:
    return F.least(F.abs(q), F.lit(1024))
