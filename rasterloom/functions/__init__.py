"""Scalar functions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once for each row. Inside a lambda a column's expression is made again at each step;
    the element of an array of one isn't."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
