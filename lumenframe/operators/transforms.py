"""The kernels as one-line transforms: df.transform(fixed_hist("x", 0, 10, 20)).

Each call returns a function from DataFrame to DataFrame in long format, so the
kernels chain with any other DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import downsample, envelope, histogram

Transform = Callable[[DataFrame], DataFrame]


def every_nth(n_points: int, order: list[str], by: tuple[str, ...] = ()) -> Transform:
    """Rows at every stride-th place."""
    return lambda df: downsample.every_nth(df, order, n_points, by)


def arg_min_max(y: str, n_points: int, order: list[str], by: tuple[str, ...] = ()) -> Transform:
    """by…, ri: places of the first extremes of n_points / 2 equal runs."""
    return lambda df: downsample.min_max(df, order[0], y, order, n_points, by).select(*by, "ri")


def fpcs(y: str, n_points: int, order: list[str], by: tuple[str, ...] = ()) -> Transform:
    """by…, ri: places kept by feature-preserving compensated sampling."""
    return lambda df: downsample.fpcs(df, order[0], y, order, n_points, by).select(*by, "ri")


def fpcs_line(x: str, y: str, n_points: int, order: list[str] | None = None, names: tuple[str, str] | None = None) -> Transform:
    """The kept points themselves, in order, under the columns' names or the given ones."""
    a, b = names or (x, y)
    return lambda df: downsample.fpcs(df, x, y, order or [x], n_points).orderBy("ri").select(F.col("x").alias(a), F.col("y").alias(b))


def fixed_hist(column: str, lo: float | None, hi: float | None, n_bins: int, by: tuple[str, ...] = ()) -> Transform:
    """by…, breakpoint (upper edge), count for every bin; missing bounds are 0 and 1."""
    bounds = (0.0 if lo is None else float(lo), 1.0 if hi is None else float(hi))
    return lambda df: histogram.histogram(df, column, n_bins, bounds, by).select(*by, "bin", F.col("hi").alias("breakpoint"), "count")


def fixed_hist2d(x: str, y: str, x_bounds: tuple[float, float], y_bounds: tuple[float, float], nx: int, ny: int) -> Transform:
    """xb, yb, value: counts of a grid."""
    return lambda df: histogram.histogram2d(df, x, y, nx, ny, x_bounds, y_bounds)


def fixed_hist2d_reduce(x: str, y: str, z: str, x_bounds: tuple[float, float], y_bounds: tuple[float, float], nx: int, ny: int, func: str) -> Transform:
    """xb, yb, value: a reduction of z in each cell of a grid."""
    if func not in histogram.REDUCERS_2D:
        raise ValueError(f"func must be one of {histogram.REDUCERS_2D}")
    return lambda df: histogram.histogram2d(df, x, y, nx, ny, x_bounds, y_bounds, z, func)


def fixed_line_envelope2d(x: str, y: str, free: str, x_bounds: tuple[float, float], free_bounds: tuple[float, float], n_buckets: int, p: int, order: list[str] | None = None) -> Transform:
    """free_bin, bucket, y_min, x_at_ymin, y_max, x_at_ymax, sorted by cell."""
    return lambda df: envelope.envelope2d(df, x, y, free, x_bounds, free_bounds, n_buckets, p, order or [x]).orderBy("free_bin", "bucket")
