"""Group aggregations: bars, pies, treemaps, quantile boxes.

Order statistics (medians, quartiles) are picked by `pick_ranks`, so a group of
any size is counted into bins and neither sorted nor held in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import has_value
from .histogram import value_of
from .ordering import pick_ranks

REDUCERS = ("count", "sum", "mean", "median", "min", "max", "n_unique")


def simple_reducer(func: str, v: Column | None, kind: T.DataType | None) -> Column:
    """Reductions with map-side partials.

    A sum over nothing is 0, a mean, least or greatest over nothing is null; NaN
    is passed over by least and greatest; null is one of the distinct values.
    """
    if func == "count" or v is None:
        return F.count(F.lit(1))
    if func == "sum":
        return F.coalesce(F.sum(v), F.lit(0).cast("double" if isinstance(kind, (T.FloatType, T.DoubleType)) else "long"))
    if func == "mean":
        return F.avg(v)
    if func in ("min", "max"):
        w = F.when(has_value(v, kind), v)
        return F.min(w) if func == "min" else F.max(w)
    if func == "n_unique":
        return F.count_distinct(v) + F.max(v.isNull().cast("long"))
    raise ValueError(f"agg must be one of {REDUCERS}")


#: Places of the middle values: two of an even number, one and the same of an odd one.
MIDDLE = {"below": lambda n: F.floor((n - 1) / 2), "above": lambda n: F.floor(n / 2)}


def median(df: DataFrame, by: tuple[str, ...], column: str, method: str = "auto") -> DataFrame:
    """by…, value: the middle value of each group, or the mean of the two middle ones; null where a group has none."""
    v, kind = value_of(df, column)
    rows = df.select(*by, v.alias("__v"))
    found = pick_ranks(rows.where(has_value(F.col("__v"), kind)), "__v", by, MIDDLE, method)
    found = found.select(*by, ((F.col("below").cast("double") + F.col("above").cast("double")) / 2).alias("value"))
    if not by:
        return found
    groups = rows.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]).distinct()
    same: Column = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(f"__by{i}").eqNullSafe(F.col(c))
    return groups.join(found, same, "left").select(*[F.col(f"__by{i}").alias(c) for i, c in enumerate(by)], "value")


def aggregate(df: DataFrame, by: tuple[str, ...], func: str = "count", column: str | None = None) -> DataFrame:
    """by…, value for each group; null is a group of its own."""
    if func not in REDUCERS:
        raise ValueError(f"agg must be one of {REDUCERS}")
    if column is not None and func == "median":
        return median(df, by, column)
    v, kind = value_of(df, column) if column is not None else (None, None)
    return df.groupBy(*by).agg(simple_reducer(func if column is not None else "count", v, kind).alias("value"))


def treemap(df: DataFrame, path: tuple[str, ...], func: str = "count", column: str | None = None) -> DataFrame:
    """level, path…, value: leaves as aggregated, every parent the sum of its leaves' final values, the root at level 0."""
    leaves = aggregate(df, path, func, column)
    # grouping_id counts the rolled-up columns as trailing ones, so it also tells a real null from a rolled-up one.
    rolled = leaves.rollup(*path).agg(F.sum("value").alias("value"), F.grouping_id().alias("__g"))
    level = F.lit(len(path)) - F.bit_count(F.col("__g"))
    return rolled.select(level.cast("int").alias("level"), *path, "value")


#: The quantiles of a box, and its whiskers' reach in interquartile ranges.
QUANTILES, REACH = (0.0, 0.25, 0.5, 0.75, 1.0), 1.5


def box(df: DataFrame, column: str, by: tuple[str, ...] = (), method: str = "auto") -> DataFrame:
    """by…, q0…q4, lower, upper: nearest-rank quartiles and whiskers; groups without a value are absent."""
    v, kind = value_of(df, column)
    rows = df.select(*by, v.alias("__v")).where(has_value(F.col("__v"), kind))
    ranks = {f"q{i}": lambda n, q=q: F.floor((n - 1) * F.lit(q) + F.lit(0.5)) for i, q in enumerate(QUANTILES)}
    found = pick_ranks(rows, "__v", by, ranks, method)
    spread = (F.col("q3") - F.col("q1")) * F.lit(REACH)
    out = found.withColumn("lower", F.greatest(F.col("q1") - spread, F.col("q0").cast("double"))).withColumn("upper", F.least(F.col("q3") + spread, F.col("q4").cast("double")))
    return out if by else out.where("q0 is not null")
