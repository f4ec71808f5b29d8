"""The three bin arithmetics, as Columns.  They differ on purpose and are never mixed.

* `hist_bin`   one-dimensional histograms: epsilon inside the floor, clamped at both ends
* `grid_bin`   two-dimensional histograms: the same, with a widened span
* `axis_bin`   shared axes of envelopes and cubes: plain floor, no clamp; callers filter to the domain first
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tolerance inside the floor, widening of a 2-D span, widening of a 1-D upper bound.
ROUND_EPS, SPAN_EPS, EDGE_EPS = 1e-9, 1e-10, 1e-10


def has_value(column: Column, kind: T.DataType | None = None) -> Column:
    """Neither null nor NaN.  The NaN test is left out where the type can't hold one."""
    if kind is not None and not isinstance(kind, (T.FloatType, T.DoubleType)):
        return column.isNotNull()
    return column.isNotNull() & ~F.isnan(column.cast("double"))


def _check(lo: float, hi: float, n: int) -> None:
    if n < 1:
        raise ValueError("the number of bins must be at least 1")
    if hi < lo:
        raise ValueError("the upper bound lies below the lower bound")


def _clamped(scaled: Column, n: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.floor(scaled + F.lit(ROUND_EPS)), F.lit(n - 1).cast("long"))).cast("int")


def hist_bin(value: Column, lo: float, hi: float, n: int) -> Column:
    _check(lo, hi, n)
    if hi == lo:
        return F.lit(0)
    return _clamped((value.cast("double") - F.lit(float(lo))) * F.lit(n / (hi - lo)), n)


def grid_bin(value: Column, lo: float, hi: float, n: int) -> Column:
    _check(lo, hi, n)
    return _clamped((value.cast("double") - F.lit(float(lo))) * F.lit(n / (hi - lo + SPAN_EPS)), n)


def axis_bin(value: Column, lo: float, hi: float, n: int) -> Column:
    _check(lo, hi, n)
    span = (hi - lo) or 1.0
    return F.floor((value.cast("double") - F.lit(float(lo))) / F.lit(float(span)) * F.lit(n)).cast("int")


def day_grid(lo: float, hi: float, p: int) -> tuple[int, int]:
    """Whole-day width and number of bins that cover lo..hi with at most p bins."""
    width = max(1, math.ceil((hi - lo) / p))
    return width, max(0, math.ceil((hi - lo) / width))


def day_bin(value: Column, lo: float, width: int) -> Column:
    return F.floor((value.cast("double") - F.lit(float(lo))) / F.lit(float(width))).cast("int")


def edges(lo: float, hi: float, n: int) -> list[tuple[float, float]]:
    step = (hi - lo) / n if hi > lo else 0.0
    return [(lo + i * step, lo + (i + 1) * step) for i in range(n)]


def within(value: Column, lo: float, hi: float) -> Column:
    return (value >= F.lit(lo)) & (value <= F.lit(hi))
