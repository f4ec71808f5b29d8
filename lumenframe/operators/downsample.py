"""Downsampling of ordered rows to a bounded number of points.

All operators work on rows with a place (`with_position`), for the whole table or
for each group, in one aggregation by (group, bucket).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import has_value
from ..functions.typing import kind_of
from .ordering import settled, with_position

GAP_FACTOR = 4.1


def _positive(n_points: int, least: int = 1) -> None:
    if n_points < least:
        raise ValueError(f"n_points must be at least {least}")


def every_nth(df: DataFrame, order: list[str], n_points: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows at every stride-th place, at most n_points of each group; adds ri."""
    _positive(n_points)
    placed = with_position(df, order, by)
    stride = F.greatest(F.lit(1), F.floor(F.col("n_rows") / n_points))
    count = F.least(F.ceil(F.col("n_rows") / stride), F.lit(n_points))
    return settled(placed.where((F.col("ri") % stride == 0) & (F.col("ri") < count * stride)).drop("n_rows"), placed)


def bucket_of(ri: Column, rows: Column, buckets: Column) -> Column:
    """The bucket of a place when `rows` places form `buckets` runs whose first rows % buckets are one longer."""
    base, extra = F.floor(rows / buckets), rows % buckets
    split = extra * (base + 1)
    return F.when(ri < split, F.floor(ri / (base + 1))).otherwise(extra + F.floor((ri - split) / F.greatest(base, F.lit(1))))


def _extremes(placed: DataFrame, x: str, y: str, by: tuple[str, ...], buckets: Column, ri: Column, rows: Column) -> DataFrame:
    """by…, bucket, lo, hi: structs (y, ri, x) of the first least and the first greatest value of each bucket."""
    valid = has_value(F.col(y), kind_of(placed.schema, y))
    found = placed.withColumn("bucket", bucket_of(ri, rows, buckets)).where(valid)
    lo = F.min(F.struct(F.col(y).alias("y"), F.col("ri").alias("ri"), F.col(x).alias("x")))
    hi = F.max(F.struct(F.col(y).alias("y"), (-F.col("ri")).alias("ri"), F.col(x).alias("x")))
    out = found.groupBy(*by, "bucket").agg(lo.alias("lo"), hi.alias("hi"))
    return out.withColumn("hi", F.struct(F.col("hi.y").alias("y"), (-F.col("hi.ri")).alias("ri"), F.col("hi.x").alias("x")))


def min_max(df: DataFrame, x: str, y: str, order: list[str], n_points: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by…, ri, x, y: first least and first greatest y of n_points / 2 equal runs of rows.

    Buckets count all rows; null and NaN are then passed over, and a bucket of nothing else gives no point.
    """
    _positive(n_points)
    placed = with_position(df.select(*dict.fromkeys([*by, x, y, *order])), order, by)
    buckets = F.greatest(F.lit(1), F.least(F.lit(max(1, n_points // 2)), F.col("n_rows")))
    both = _extremes(placed, x, y, by, buckets, F.col("ri"), F.col("n_rows"))
    points = both.select(*by, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("p"))
    return settled(points.select(*by, F.col("p.ri").alias("ri"), F.col("p.x").alias("x"), F.col("p.y").alias("y")), placed)


def compensated(first: tuple[int, float], pairs: list[tuple[int, float, int, float]], last: int) -> list[int]:
    """Places kept by feature-preserving compensated sampling.

    As the method is defined: of each bucket's two extremes, the later may still be
    outdone by the next bucket, so it is only pending.  It enters the next bucket
    as a candidate for its extremes; of these the earlier is kept and the later is
    pending in turn.  A pending point that two buckets in a row running the same way
    pass over is a feature of its own, and is kept before them.

    pairs: for each bucket in order, place and value of its least and its greatest
    point.  Comparisons with NaN are false, so NaN takes the place of an extreme.
    """
    kept, pending, rose = [first[0]], first, None
    for lo_at, lo_y, hi_at, hi_y in pairs:
        least, greatest = ((hi_at, hi_y), (lo_at, lo_y)) if lo_y > hi_y else ((lo_at, lo_y), (hi_at, hi_y))
        if pending[1] <= least[1]:
            least = pending
        if pending[1] > greatest[1]:
            greatest = pending
        rises = least[0] < greatest[0]
        now, later = (least, greatest) if rises else (greatest, least)
        kept += [pending[0], now[0]] if rises is rose and now != pending else [now[0]]
        pending, rose = later, rises
    kept += [last] if rose is None else [pending[0], last]
    return [p for i, p in enumerate(kept) if not i or kept[i - 1] != p]


def fpcs(df: DataFrame, x: str, y: str, order: list[str], n_points: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by…, ri, x, y: feature-preserving compensated sampling, up to about twice n_points points of each group.

    Buckets are reduced in one aggregation; the fold over them, which is sequential,
    sees at most n_points rows of a group.
    """
    _positive(n_points, 3)
    columns = list(dict.fromkeys([*by, x, y, *order]))
    placed = with_position(df.select(*columns), order, by)
    n, ri = F.col("n_rows"), F.col("ri")
    whole = (n <= n_points) | (n - 2 <= 2 * (n_points - 2))
    point = F.struct(F.col(y).cast("double").alias("y"), F.col("ri").alias("ri"), F.col(x).alias("x"))
    all_rows = placed.where(whole).select(*by, ri, F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    rest = placed.where(~whole).withColumn(y, F.col(y).cast("double"))
    ends = rest.where((ri == 0) | (ri == n - 1)).select(*by, F.when(ri == 0, F.lit(-1)).otherwise(F.lit(n_points)).cast("long").alias("bucket"), point.alias("lo"), point.alias("hi"))
    inner = _extremes(rest.where((ri > 0) & (ri < n - 1)), x, y, by, F.lit(n_points - 2), ri - 1, n - 2)
    folded = ends.unionByName(inner.withColumn("bucket", F.col("bucket").cast("long")))
    flat = folded.select(*by, "bucket", *(F.col(f"{e}.{k}").alias(f"{e}_{k}") for e in ("lo", "hi") for k in ("y", "ri", "x")))
    kind_x = kind_of(df.schema, x)
    schema = ", ".join([*(f"`{c}` {kind_of(df.schema, c).simpleString()}" for c in by), "ri long", f"x {kind_x.simpleString()}", "y double"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("bucket", kind="stable")
        at = {}
        for e in ("lo", "hi"):
            at.update(zip(p[f"{e}_ri"].tolist(), zip(p[f"{e}_x"].tolist(), p[f"{e}_y"].tolist())))
        middle = p.iloc[1:-1]
        num = lambda s: [math.nan if v is None else float(v) for v in s.tolist()]
        pairs = list(zip(middle["lo_ri"].tolist(), num(middle["lo_y"]), middle["hi_ri"].tolist(), num(middle["hi_y"])))
        kept = compensated((int(p["lo_ri"].iloc[0]), num(p["lo_y"])[0]), pairs, int(p["lo_ri"].iloc[-1]))
        out = pd.DataFrame({"ri": kept, "x": [at[k][0] for k in kept], "y": [at[k][1] for k in kept]})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "ri", "x", "y"]]

    # Without groups all of the at most n_points rows are one group.
    sampled = flat.groupBy(*by).applyInPandas(fold, schema) if by else flat.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(fold, schema)
    return settled(all_rows.unionByName(sampled), placed)


def _median(values: list[float]) -> float:
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def geo_gaps(lat: list[float | None], lon: list[float | None]) -> tuple[list, list]:
    """The points with a (None, None) row wherever a step is longer than GAP_FACTOR times the median step."""
    steps = [None if None in (a, b, c, d) else math.hypot(b - a, d - c) for a, b, c, d in zip(lat, lat[1:], lon, lon[1:])]
    known = [s for s in steps if s is not None]
    middle = _median(known) if known else 0.0
    if not middle:
        return list(lat), list(lon)
    out: tuple[list, list] = ([], [])
    for i, (a, b) in enumerate(zip(lat, lon)):
        if i and steps[i - 1] is not None and steps[i - 1] > GAP_FACTOR * middle:
            out[0].append(None)
            out[1].append(None)
        out[0].append(a)
        out[1].append(b)
    return out


def line_gaps(x: list, y: list, number=float) -> tuple[list, list]:
    """The points with a null y before every x step longer than GAP_FACTOR times the median step; `number` turns x into a number."""
    at = [None if v is None else number(v) for v in x]
    steps = [None if a is None or b is None else b - a for a, b in zip(at, at[1:])]
    finite = [s for s in steps if s is not None and math.isfinite(s)]
    middle = _median(finite) if finite else 0.0
    if middle <= 0:
        return list(x), list(y)
    out: tuple[list, list] = ([], [])
    for i, (a, b) in enumerate(zip(x, y)):
        if i and steps[i - 1] is not None and steps[i - 1] > GAP_FACTOR * middle:
            out[0].append(a)
            out[1].append(None)
        out[0].append(a)
        out[1].append(b)
    return out
