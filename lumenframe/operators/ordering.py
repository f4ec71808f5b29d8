"""Positions of rows in a stated order, and values at given ranks, for operators that depend on order.

Two plans number rows alike.  A small table is numbered by a window.  A large
one is dealt into ranges of (group, order) of about RANGE_BYTES, sorted in place
and written to the shared folder, which fixes who lies where; then a row's place
is its place in its range plus the rows of the ranges before, and no task ever
holds more than a range, however large a group is.  Rows that the order leaves
tied are told apart by a hash of all their columns, so numbers do not change from
run to run; rows that agree in everything may change places.  What an operator
makes of the numbers is small: `settled` writes that down and drops the copy.

Values at ranks (medians, quartiles) need no numbers and no sort: `pick_ranks`
counts rows into bins, keeps the bins that hold the ranks, and counts again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Plans whose estimated size is below this are numbered by a window.
SMALL_BYTES = 64 * 1024 * 1024
#: Estimated bytes of one range.
RANGE_BYTES = 128 * 1024 * 1024
_PRIVATE: dict[str, str | None] = {}


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ranges_for(df: DataFrame) -> int:
    """Ranges of about RANGE_BYTES of what a plan reads; the session's number of partitions at least, and where a leaf's size is unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(min(1 << 62, int(str(leaves.apply(i).stats().sizeInBytes()))) for i in range(leaves.size()))
    least = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return least if read >= 1 << 60 else max(least, -(-read // RANGE_BYTES))


def _shared(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that spark.checkpoint.dir names; a private one only where it is unset and all runs in one process."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _PRIVATE.setdefault("folder", None) or tempfile.mkdtemp(prefix="lumenframe-order-")
        _PRIVATE["folder"] = base
    path = f"{base.rstrip('/')}/lumenframe/order-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.copy = path
    return out


def drop(placed: DataFrame) -> None:
    """Deletes the written copy behind numbered rows, if there is one."""
    path = getattr(placed, "copy", None)
    if path is not None:
        spark = placed.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settled(result: DataFrame, placed: DataFrame) -> DataFrame:
    """The result, which is small, written down in place of the copy of the rows that it was made from."""
    if getattr(placed, "copy", None) is None:
        return result
    out = _shared(result)
    drop(placed)
    return out


def tie_breaker(df: DataFrame) -> Column:
    """A hash of a row's columns; maps, which cannot be hashed, count by their text."""
    return F.xxhash64(*(F.col(f.name).cast("string") if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name) for f in df.schema.fields))


def with_position(df: DataFrame, order: list[str], by: tuple[str, ...] = (), method: str = "auto") -> DataFrame:
    """Adds ri (place from 0 in `order` within each group) and n_rows (rows of the group)."""
    if method == "auto":
        method = "window" if estimated_bytes(df) < SMALL_BYTES else "ranges"
    keys = [F.col(c) for c in by]
    if method == "window":
        w = Window.partitionBy(*keys)
        return df.withColumn("ri", (F.row_number().over(w.orderBy(*order, tie_breaker(df))) - 1).cast("long")).withColumn("n_rows", F.count(F.lit(1)).over(w))
    # The local number fixes each row's range and place there; written down, they can't change.  Ranges may cut through ties.
    tied = df.withColumn("__tie", tie_breaker(df))
    written = _shared(tied.repartitionByRange(ranges_for(df), *by, *order, "__tie").sortWithinPartitions(*by, *order, "__tie").drop("__tie").withColumn("__id", F.monotonically_increasing_id()))
    fixed = written.withColumn("__range", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row for each range: as many as the table has stretches of RANGE_BYTES.
    counted = fixed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__range"))
    offsets = counted.select("__range", (upto - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("n_rows"))
    placed = fixed.join(F.broadcast(offsets), "__range").withColumn("ri", F.col("__before") + F.col("__place")).drop("__id", "__range", "__place", "__before")
    if by:
        groups = placed.groupBy(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]).agg(F.min("ri").alias("__first"), F.count(F.lit(1)).alias("__rows"))
        same: Column = F.lit(True)
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
        placed = placed.join(groups, same).withColumn("ri", F.col("ri") - F.col("__first")).withColumn("n_rows", F.col("__rows"))
    out = placed.select(*df.columns, "ri", "n_rows")
    out.copy = written.copy
    return out


#: Most groups and ranks that are followed in the driver; with more, groups are small and a window numbers them.
FEW_RANKS = 100_000
#: Bins of a doubling of the value, and parts that a bin is cut into when it is counted again.
FINENESS, PARTS = 64, 4096


def _coarse(v: Column) -> Column:
    """A number that rises with the value, in steps of a FINENESS-th of a doubling."""
    d = v.cast("double")
    size = F.least(F.abs(d), F.lit(1.7e308))
    # The smallest value has a logarithm of -1074, so steps start above 0 and take the value's sign.
    step = F.floor(F.log2(size) * FINENESS) + F.lit(1100 * FINENESS)
    return F.when(d == 0, F.lit(0).cast("long")).when(d > 0, step).otherwise(-step)


def pick_ranks(rows: DataFrame, value: str, by: tuple[str, ...], ranks: dict[str, Callable[[Column], Column]], method: str = "auto") -> DataFrame:
    """by…, and for each of `ranks` the value at that place (from 0, a function of the group's number of rows); `value` has no null or NaN.

    Three counts, each with partial sums and none with a sort of rows: into
    logarithmic bins; of the bins that hold a rank, into equal parts; of the parts
    that hold one, by value.  A bin of one value is done at once.
    """
    if method == "auto":
        method = "window" if estimated_bytes(rows) < SMALL_BYTES else "bins"
    v = F.col(value)
    if method == "bins":
        found = _by_bins(rows, value, by, ranks)
        if found is not None:
            return found
    placed = with_position(rows.select(*by, value), [value], by, "window")
    at = {name: rank(F.col("n_rows")) for name, rank in ranks.items()}
    return placed.where(F.col("ri").isin(*at.values())).groupBy(*by).agg(*(F.max(F.when(F.col("ri") == r, v)).alias(name) for name, r in at.items()))


def _by_bins(rows: DataFrame, value: str, by: tuple[str, ...], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame | None:
    spark, v = rows.sparkSession, F.col(value)
    kind = rows.schema[value].dataType
    keys = [f"__k{i}" for i in range(len(by))]
    rows = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), v.alias("__v"))
    groups = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys])
    v = F.col("__v")
    done: list[tuple] = []
    path: list[str] = []
    wanted: DataFrame | None = None
    current = rows
    for step, bin_ in enumerate((_coarse(v), None, v)):
        if step == 1:
            width = F.col("__high").cast("double") - F.col("__low").cast("double")
            bin_ = F.least(F.coalesce(F.floor(F.try_divide(v.cast("double") - F.col("__low").cast("double"), width) * PARTS), F.lit(0)), F.lit(PARTS - 1)).cast("long")
        current = current.withColumn(f"__b{step}", bin_)
        cells = current.groupBy(*keys, *path, f"__b{step}").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        within = Window.partitionBy(*keys, *path)
        before = F.sum("__n").over(within.orderBy(f"__b{step}")) - F.col("__n")
        cells = cells.withColumn("__before", before)
        if wanted is None:
            total = F.sum("__n").over(within)
            asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("__total")).cast("long").alias("k")) for name, rank in ranks.items())))
            cells = cells.withColumn("__total", total).withColumn("__want", asked).select("*", F.col("__want.name").alias("__name"), F.col("__want.k").alias("__rank")).drop("__want", "__total")
        else:
            cells = _matched(cells, wanted, [*keys, *path], ["__name", "__rank"])
        hit = cells.where((F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__n")))
        hit = hit.select(*keys, *path, f"__b{step}", "__low", "__high", "__name", (F.col("__rank") - F.col("__before")).alias("__rank"))
        got = hit.limit(FEW_RANKS + 1).collect()
        if len(got) > FEW_RANKS:
            return None
        path.append(f"__b{step}")
        done += [(*r[: len(keys)], r["__name"], r["__low"]) for r in got if r["__low"] == r["__high"]]
        rest = [r for r in got if r["__low"] != r["__high"]]
        if not rest:
            break
        # Open ranks are few, as has just been counted, so they are sent to all rows.
        wanted = spark.createDataFrame([tuple(r) for r in rest], hit.schema)
        if step == 0:
            bounds = wanted.select(*keys, *path, "__low", "__high").distinct()
            current = _matched(current, bounds, [*keys, *path], ["__low", "__high"])
        else:
            current = _matched(current.drop("__low", "__high"), wanted.select(*keys, *path).distinct().withColumn("__open", F.lit(True)), [*keys, *path], ["__open"]).drop("__open")
        wanted = wanted.select(*keys, *path, "__name", "__rank")
    schema = T.StructType([*groups.fields, T.StructField("name", T.StringType()), T.StructField("value", kind)])
    flat = spark.createDataFrame(done, schema)
    return flat.groupBy(*(F.col(k).alias(c) for c, k in zip(by, keys))).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks))


def _matched(left: DataFrame, few: DataFrame, on: list[str], take: list[str]) -> DataFrame:
    """The rows of `left` with the columns of the matching rows of `few`; null matches null."""
    named = few.select(*(F.col(c).alias(f"{c}__") for c in on), *take)
    same: Column = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    return left.join(F.broadcast(named), same).drop(*(f"{c}__" for c in on))


def keep_order(df: DataFrame, order: list[str]) -> bool:
    """Whether `order` puts all rows in one order: no two rows agree in all its columns."""
    return df.groupBy(*order).count().where("count > 1").isEmpty()


def is_sorted(df: DataFrame, column: str, order: list[str]) -> bool:
    """Whether `column` never falls along `order`.  Ranges are compared inside and at their seams."""
    placed = with_position(df.select(*dict.fromkeys([column, *order])), order)
    ahead = placed.select((F.col("ri") - 1).alias("ri"), F.col(column).alias("next"))
    out = placed.join(ahead, "ri").where(F.col("next") < F.col(column)).isEmpty()
    drop(placed)
    return out
