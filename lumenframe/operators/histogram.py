"""Histograms in one and two dimensions, in long format with every bin present.

One partial-then-final aggregation on small integer keys; the empty bins come
from a sequence over the collected counts, so nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import EDGE_EPS, grid_bin, has_value, hist_bin, within
from ..functions.typing import kind_of, physical
from .ordering import pick_ranks

REDUCERS_2D = ("sum", "mean", "min", "max", "median", "n_unique")
NORMS = ("count", "percent", "probability", "density", "probability density")


def value_of(df: DataFrame, column: str) -> tuple[Column, T.DataType]:
    kind = kind_of(df.schema, column)
    if kind is None:
        raise ValueError(f"there is no column {column!r}")
    return physical(F.col(column), kind), kind


def domain(df: DataFrame, *columns: str) -> tuple[float | None, float | None]:
    """Least and greatest physical value over the columns, without NaN; (None, None) if there is none."""
    parts = []
    for c in columns:
        v, kind = value_of(df, c)
        v = F.when(has_value(v, kind), v.cast("double"))
        parts += [F.min(v), F.max(v)]
    row = df.agg(*[p.alias(f"m{i}") for i, p in enumerate(parts)]).first()
    lows, highs = [v for v in row[0::2] if v is not None], [v for v in row[1::2] if v is not None]
    return (min(lows), max(highs)) if lows else (None, None)


def padded(bounds: tuple[float | None, float | None]) -> tuple[float, float]:
    """Bounds of a 1-D histogram: 0..1 where there is no data, and room for the greatest value in the last bin."""
    lo, hi = bounds
    return (0.0 if lo is None else float(lo)), (1.0 if hi is None else float(hi)) + EDGE_EPS


def _spread(counted: DataFrame, by: tuple[str, ...], n: int, columns: tuple[str, ...], empty: dict[str, Column]) -> DataFrame:
    """Every bin 0..n-1 of every group, from rows (by, bin, columns)."""
    cells = F.map_from_entries(F.collect_list(F.struct("bin", F.struct(*columns))))
    grouped = counted.groupBy(*by).agg(cells.alias("cells")).select(*by, "cells", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    cell = F.try_element_at("cells", F.col("bin"))
    return grouped.select(*by, "bin", *(F.coalesce(cell[c], empty[c]).alias(c) if c in empty else cell[c].alias(c) for c in columns))


def histogram(df: DataFrame, column: str, n: int, bounds: tuple[float, float], by: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """by…, bin, lo, hi, count; with `where` also fg_count, the rows of each bin that pass it: both layers in one scan.

    Null and NaN are left out; values beyond the bounds count in the end bins.
    """
    lo, hi = bounds
    v, kind = value_of(df, column)
    counts = [F.count(F.lit(1)).alias("count")] + ([F.count_if(where).alias("fg_count")] if where is not None else [])
    names = tuple("count fg_count".split()[: len(counts)])
    found = df.where(has_value(v, kind)).groupBy(*by, hist_bin(v, lo, hi, n).alias("bin")).agg(*counts)
    step = (hi - lo) / n if hi > lo else 0.0
    full = _spread(found, by, n, names, {c: F.lit(0).cast("long") for c in names})
    return full.select(*by, "bin", (F.lit(lo) + F.col("bin") * F.lit(step)).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(step)).alias("hi"), *names)


def histograms(df: DataFrame, wanted: list[tuple[str, str, int, tuple[float, float]]]) -> DataFrame:
    """trace, bin, count of several histograms (trace, column, bins, bounds) in one scan and one shuffle.

    Each row becomes one (trace, bin) pair for each histogram; the pairs combine before the shuffle.
    """
    pairs = []
    for trace, column, n, (lo, hi) in wanted:
        v, kind = value_of(df, column)
        pairs.append(F.struct(F.lit(trace).alias("trace"), F.when(has_value(v, kind), hist_bin(v, lo, hi, n)).alias("bin")))
    counted = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("bin is not null").groupBy("trace", "bin").agg(F.count(F.lit(1)).alias("count"))
    # The empty bins are few and known beforehand.
    grid = df.sparkSession.createDataFrame([(t, i) for t, _, n, _ in wanted for i in range(n)], "trace string, bin int")
    return grid.join(counted, ["trace", "bin"], "left").select("trace", "bin", F.coalesce("count", F.lit(0)).alias("count"))


def normalised(binned: DataFrame, norm: str, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `value`: the count, its share (percent or probability), or either by bin width.  A zero total gives NaN."""
    if norm not in NORMS:
        raise ValueError(f"histnorm must be one of {NORMS}")
    from pyspark.sql.window import Window

    count = F.col("count").cast("double")
    total = F.sum("count").over(Window.partitionBy(*[F.col(c) for c in by])).cast("double")
    share = F.coalesce(F.try_divide(count, total), F.lit(float("nan")))
    value = {"count": count, "percent": share * 100, "probability": share, "density": count / F.lit(width), "probability density": share / F.lit(width)}[norm]
    return binned.withColumn("value", value)


def reducer(func: str, v: Column, kind: T.DataType) -> Column:
    """A cell's reduction of a value column; NaN counts as missing."""
    v = F.when(has_value(v, kind), v)
    if func == "n_unique":
        return F.count_distinct(v)
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[func](v.cast("double"))


def histogram2d(df: DataFrame, x: str, y: str, nx: int, ny: int, xb: tuple[float, float], yb: tuple[float, float], z: str | None = None, func: str = "count", by: tuple[str, ...] = ()) -> DataFrame:
    """by…, xb, yb, value for every cell, in row-major order of (yb, xb).

    Without z the value is the count (0 where empty); with z a reduction, null where no row has a value.
    """
    vx, kx = value_of(df, x)
    vy, ky = value_of(df, y)
    rows = df.where(has_value(vx, kx) & has_value(vy, ky))
    cell = grid_bin(vy, *yb, ny) * F.lit(nx) + grid_bin(vx, *xb, nx)
    if z is None:
        agg = F.count(F.lit(1)).cast("double")
    else:
        if func not in REDUCERS_2D:
            raise ValueError(f"histfunc must be one of {REDUCERS_2D}")
        vz, kz = value_of(df, z)
        rows = rows.where(has_value(vz, kz))
        if func == "median":
            # Ranks within the cells, so that no aggregate holds a cell's values.
            middle = {"below": lambda n: F.floor((n - 1) / 2), "above": lambda n: F.floor(n / 2)}
            rows = pick_ranks(rows.select(*by, cell.alias("bin"), vz.cast("double").alias("__z")), "__z", (*by, "bin"), middle)
            agg, cell = F.max((F.col("below") + F.col("above")) / 2), F.col("bin")
        else:
            agg = reducer(func, vz, kz).cast("double")
    found = rows.groupBy(*by, cell.alias("bin")).agg(agg.alias("value"))
    full = _spread(found, by, nx * ny, ("value",), {"value": F.lit(0.0)} if z is None else {})
    return full.select(*by, (F.col("bin") % nx).cast("int").alias("xb"), F.floor(F.col("bin") / nx).cast("int").alias("yb"), "value")


def viewport2d(df: DataFrame, x: str, y: str, xb: tuple[float, float], yb: tuple[float, float]) -> DataFrame:
    """The rows inside both ranges, ends included."""
    vx, _ = value_of(df, x)
    vy, _ = value_of(df, y)
    return df.where(within(vx, *xb) & within(vy, *yb))
