"""Correlation of all pairs of columns, over the rows where both have a value."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import has_value
from ..functions.typing import is_numeric
from .histogram import value_of
from .ordering import SMALL_BYTES, estimated_bytes, with_position

METHODS = ("pearson", "spearman")
#: Columns of at most so many distinct values (about 2 MB of ranks) get their ranks by broadcast, the others by a shuffle join.
FEW_VALUES = 100_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def _r(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate over rows where both are set; 0 where it is undefined."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
    return F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0))


def _ranked(df: DataFrame, columns: list[str], distinct: dict[str, int]) -> DataFrame:
    """The columns as average ranks over the rows where all of them have a value.

    Ranks belong to values, so only distinct values and their counts are put in
    order, and each column's ranks are joined back by value; `distinct` tells
    about how many there are.
    """
    named = {}
    for c in columns:
        v, kind = value_of(df, c)
        named[c] = (v, has_value(v, kind))
    rows = df.where(reduce(lambda a, b: a & b, [ok for _, ok in named.values()])).select(*(v.alias(c) for c, (v, _) in named.items()))
    whole = rows
    # Shuffle joins come first, while rows are still keyed by raw values only; broadcasts then run in the last join's stage.
    for c in sorted(columns, key=lambda c: -distinct[c]):
        ranks = _mean_ranks(whole.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c)
        rows = rows.join(F.broadcast(ranks) if distinct[c] <= FEW_VALUES else ranks, c).drop(c).withColumnRenamed("rank", c)
    return rows


def _mean_ranks(counts: DataFrame, c: str) -> DataFrame:
    """c, rank: the mean rank of each value from (c, n)."""
    from pyspark.sql.window import Window

    if estimated_bytes(counts) < SMALL_BYTES:
        before = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select(c, (before + (F.col("n") + 1) / 2).alias("rank"))
    # Blocks of neighbouring values: running sums inside a block, plus the sums of the blocks before it.
    block = 1 << 16
    placed = with_position(counts, [c], method="ranges").withColumn("block", F.floor(F.col("ri") / block))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("ri").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = placed.groupBy("block").agg(F.sum("n").alias("s"))
    first = sums.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return placed.withColumn("inside", inside).join(first, "block").select(c, (F.col("first") + F.col("inside") + (F.col("n") + 1) / 2).alias("rank"))


def _all_pairs(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """a, b, r of all pairs of the named columns, from one aggregation."""
    pairs = list(combinations(named, 2))
    row = df.agg(*(_r(named[a], named[b]).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def correlations(df: DataFrame, columns: list[str] | None = None, method: str = "pearson", absolute: bool = False) -> DataFrame:
    """a, b, r for every pair of columns in order.  All pairs share one aggregation; only spearman with missing values ranks each pair anew."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if len(columns) < 2:
        raise ValueError(f"a correlation needs at least two numeric columns, not {columns!r}")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "pearson":
        named = {}
        for c in columns:
            v, kind = value_of(df, c)
            named[c] = F.when(has_value(v, kind), v.cast("double"))
        out = _all_pairs(df, named)
    else:
        checks = [value_of(df, c) for c in columns]
        row = df.agg(*(F.count_if(~has_value(v, k)).alias(f"m{i}") for i, (v, k) in enumerate(checks)), *(F.approx_count_distinct(v).alias(f"d{i}") for i, (v, _) in enumerate(checks))).first()
        missing, distinct = row[: len(columns)], dict(zip(columns, row[len(columns) :]))
        if not any(missing):
            # Every pair is complete in every row, so each column is ranked once.
            out = _all_pairs(_ranked(df, columns, distinct), {c: F.col(c) for c in columns})
        else:
            parts = [_all_pairs(_ranked(df, [a, b], distinct), {a: F.col(a), b: F.col(b)}) for a, b in combinations(columns, 2)]
            out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumn("r", F.abs("r")) if absolute else out


def matrix(columns: list[str], pairs: dict[tuple[str, str], float], triangular: bool = False) -> list[list[float | None]]:
    """The square matrix in column order; `triangular` blanks the diagonal and everything right of it."""
    z = [[1.0 if a == b else pairs.get((a, b), pairs.get((b, a), 0.0)) for b in columns] for a in columns]
    return [[None if triangular and i >= j else v for i, v in enumerate(row)] for j, row in enumerate(z)]
