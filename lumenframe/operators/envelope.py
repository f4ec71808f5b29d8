"""The exact envelope of a line on a fixed grid: least and greatest y of every (x bucket, free bin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import axis_bin, has_value, within
from ..functions.typing import is_numeric, kind_of, physical


def envelope2d(df: DataFrame, x: str, y: str, free: str, x_bounds: tuple[float, float], free_bounds: tuple[float, float], buckets: int, bins: int, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by…, free_bin, bucket, y_min, x_at_ymin, y_max, x_at_ymax, for cells that hold a row.

    Rows outside either domain drop out, a value at its upper end has a bin of its
    own; of equal extremes the first row along `order` (numbers or times) counts.
    """
    if buckets < 1 or bins < 1:
        raise ValueError("buckets and bins must be at least 1")
    for lo, hi in (x_bounds, free_bounds):
        if hi < lo:
            raise ValueError("a domain's upper end lies below its lower end")
    kinds = {c: kind_of(df.schema, c) for c in (x, y, free, *order)}
    v = {c: physical(F.col(c), k) for c, k in kinds.items()}
    if not is_numeric(kinds[y]):
        raise ValueError(f"{y!r} is not numeric")
    rows = df.where(has_value(v[x], kinds[x]) & has_value(v[y], kinds[y]) & has_value(v[free], kinds[free]) & within(v[x], *x_bounds) & within(v[free], *free_bounds))
    first: list[Column] = [v[c].alias(f"o{i}") for i, c in enumerate(order)]
    last: list[Column] = [(-v[c]).alias(f"o{i}") for i, c in enumerate(order)]
    at = v[x].cast("double").alias("x")
    height = v[y].cast("double").alias("y")
    low, high = F.min(F.struct(height, *first, at)), F.max(F.struct(height, *last, at))
    cells = rows.groupBy(*by, axis_bin(v[free], *free_bounds, bins).alias("free_bin"), axis_bin(v[x], *x_bounds, buckets).alias("bucket")).agg(low.alias("lo"), high.alias("hi"))
    return cells.select(*by, "free_bin", "bucket", F.col("lo.y").alias("y_min"), F.col("lo.x").alias("x_at_ymin"), F.col("hi.y").alias("y_max"), F.col("hi.x").alias("x_at_ymax"))
