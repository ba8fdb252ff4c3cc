"""Little-endian numbers in binary columns, and hashes of neighbouring samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def le_bytes(value: Column, size: int) -> Column:
    """A whole number as `size` bytes, the lowest first; what doesn't fit is cut off."""
    byte = lambda i: F.unhex(F.lpad(F.hex(F.shiftrightunsigned(value.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))), 2, "0"))
    return F.concat(*[byte(i) for i in range(size)])


def le_number(data: Column, at: Column | int, size: int, signed: bool = False) -> Column:
    """The number of `size` bytes from place `at` (from 0); null where the data end before. Eight bytes are always signed."""
    start = F.lit(at) if isinstance(at, int) else at
    byte = lambda i: F.shiftleft(F.conv(F.hex(F.substring(data, start + i + 1, F.lit(1))), 16, 10).cast("bigint"), 8 * i)
    number = reduce(lambda a, b: a.bitwiseOR(b), [byte(i) for i in range(size)])
    if signed and size < 8:
        top = 1 << (8 * size)
        number = F.when(number >= top // 2, number - top).otherwise(number)
    return F.when(F.octet_length(data) >= start + size, number)


# What the samples above, on the left, and above left are multiplied by.
FACTORS = (2654435761, 2246822519, 3266489917)


def sample_hash(above: Column, left: Column, corner: Column) -> Column:
    """A hash of the neighbouring samples, of 32 bits; a missing one (null) takes no part."""
    parts = [F.coalesce((c.cast("bigint") * F.lit(f)).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0).cast("bigint")) for c, f in zip((above, left, corner), FACTORS, strict=True)]
    return reduce(lambda a, b: a.bitwiseXOR(b), parts)


def rank_context(rank: Column, plane: Column) -> Column:
    """The context of a coefficient: 64 for each plane."""
    return plane * 64 + rank
