"""Shared plumbing of the training-data operators.

Everything here is about *moving rows*: reading tables, cutting lineage through
the folder all executors share, and streaming Arrow batches through Python
without ever holding more than one batch.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that an operator's function sees at once, and most rows of a batch on its way there.
BATCH_ROWS = 512

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever started them."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="lumenframe-src-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "lumenframe_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for base, _, names in os.walk(os.path.join(root, package)):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(base, n)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a private one only where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="lumenframe-shared-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


class Scratch:
    """Tables written to the shared folder: a lineage cut that survives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/lumenframe/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that `keep` wrote, once nothing reads it any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            if "/lumenframe/" in f:
                p = jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(conf).delete(p, True)


def short_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to BATCH_ROWS, whatever operator asks; one that wants fewer cuts its batches itself.

    A batch of long texts else takes 64 MB in the JVM and again in Python, for each core.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def stream(
    df: DataFrame,
    fn: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]],
    schema: str,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """`fn` maps an iterator of {column: list} batches to batches of `schema` (lists, numpy or Arrow arrays); Arrow carries them."""
    spark = df.sparkSession
    ship(spark)
    short_batches(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(b.schema.names, (c.to_pylist() for c in b.columns))) for b in pieces(batches, batch_rows))
        for cols in fn(rows):
            arrays = [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type) for f in out]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def pick_rows(df: DataFrame, text: str, start: Callable[[], Callable[[list], list[bool]]], batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The rows of `df`, all columns as they are, whose text passes; `start()` makes the test once in each task."""
    ship(df.sparkSession)
    short_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = start()
        for b in pieces(batches, batch_rows):
            yield b.filter(pa.array(test(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_text(df: DataFrame, text: str, start: Callable[[], Callable[[list], list]], length: str | None = None, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The rows of `df` with their texts rewritten, and the column `length`, if there, set to the new lengths."""
    ship(df.sparkSession)
    short_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = start()
        for b in pieces(batches, batch_rows):
            columns = list(b.columns)
            new = rewrite(b.column(names.index(text)).to_pylist())
            columns[names.index(text)] = pa.array(new, b.schema.field(names.index(text)).type)
            if length in names:
                i = names.index(length)
                columns[i] = pa.array([None if t is None else len(t) for t in new], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return df.mapInArrow(run, df.schema)


def doc_hash(key: str = "doc_id"):
    """crc32 of the id as text: the split and sampling key that every engine computes alike; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def held_out(of: int, remainder: int, key: str = "doc_id"):
    """Whether the hash leaves `remainder`; a row without an id is in no fold."""
    return F.coalesce(doc_hash(key) % of == remainder, F.lit(False))


def sample_by_class(rows: DataFrame, cls: str, cap: int, key: str = "doc_id", total: int | None = None) -> DataFrame:
    """`cap` rows of each class, or all it has; with `total` about so many in all, but one of each class at least.

    The rows of the least hashes of the key stay.  Counts of the classes combine
    before the shuffle; a threshold on the hash, wide enough to leave `cap` rows
    of a class for sure, thins a large class where it is read, so ranking sees
    few rows of it.
    """
    counted = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("__n"))
    if total is not None:
        cap = max(1, min(cap, total // max(1, counted.count())))
    wide = cap + 6 * int(cap**0.5) + 20
    counted = counted.select(F.col(cls).alias("__cls"), "__n")
    dealt = rows.withColumn("__draw", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 40)))
    # Classes are few beside rows; which side is sent around is left to Spark, which knows their number at run time.
    near = dealt.join(counted, F.col(cls).eqNullSafe(F.col("__cls"))).where(F.col("__draw") * F.col("__n").cast("double") <= F.lit(float(wide) * (1 << 40)))
    least = Window.partitionBy(cls).orderBy("__draw", key)
    return near.withColumn("__rank", F.row_number().over(least)).where(F.col("__rank") <= cap).select(*rows.columns)
