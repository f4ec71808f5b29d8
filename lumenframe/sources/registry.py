"""Named sources.

A source is a DataFrame with a stated order of its rows (Spark has none of its
own), a memory of column domains, and, if asked for, persisted rows.  Readers of
other forms are thin: whatever Spark reads is a source.
"""

from __future__ import annotations

from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import has_value
from ..operators import ordering
from ..operators.histogram import value_of


def frame_from(spark: SparkSession, data: Any) -> DataFrame:
    """A DataFrame from a DataFrame, a pandas frame, an Arrow table or a list of dicts; a ValueError for anything else."""
    if isinstance(data, DataFrame):
        return data
    try:
        import pandas as pd

        if isinstance(data, pd.DataFrame):
            return spark.createDataFrame(data)
    except ImportError:
        pass
    try:
        import pyarrow as pa

        if isinstance(data, pa.Table):
            return spark.createDataFrame(data)
    except ImportError:
        pass
    if isinstance(data, list) and data and all(isinstance(r, dict) for r in data):
        return spark.createDataFrame(data)
    raise ValueError(f"no source can be made of {type(data).__name__}")


def read(spark: SparkSession, path: str, form: str = "parquet", **options: Any) -> DataFrame:
    """Any format Spark reads: parquet, orc, csv, json, avro, jdbc (with its options), or a table's name with form="table"."""
    if form == "table":
        return spark.table(path)
    reader = spark.read.format(form).options(**options)
    return reader.load() if form == "jdbc" else reader.load(path)


def store(df: DataFrame, path: str, order_by: list[str], partitions: int | None = None) -> DataFrame:
    """Writes a table in ranges of `order_by`, sorted inside, and reads it back.

    Viewports on the leading column then skip whole files and row groups by their statistics.
    """
    dealt = df.repartitionByRange(partitions, *order_by) if partitions else df.repartitionByRange(*order_by)
    dealt.sortWithinPartitions(*order_by).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Source:
    def __init__(self, name: str, df: DataFrame, order_by: list[str] | None = None, cache: bool = False):
        self.name, self.cache = name, cache
        self.df = df.persist(StorageLevel.MEMORY_AND_DISK) if cache else df
        self.order_by = list(order_by or [])
        for c in self.order_by:
            if c not in df.columns:
                raise ValueError(f"{name!r} has no column {c!r}")
        self._domains: dict[str, tuple[float | None, float | None]] = {}
        self._sorted: set[str] = set()

    @property
    def schema(self):
        return self.df.schema

    def order_for(self, x: str) -> list[str]:
        """The order of the rows for a trace over x: the stated one, or x itself."""
        return self.order_by or [x]

    def domains(self, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
        """Least and greatest physical value of columns over all rows; each column is read once in a source's life."""
        new = [c for c in dict.fromkeys(columns) if c not in self._domains]
        if new:
            parts = []
            for i, c in enumerate(new):
                v, kind = value_of(self.df, c)
                v = F.when(has_value(v, kind), v.cast("double"))
                parts += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
            row = self.df.agg(*parts).first()
            self._domains.update({c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(new)})
        return {c: self._domains[c] for c in columns}

    def assume_sorted(self, column: str) -> None:
        self._sorted.add(column)

    def check_sorted(self, column: str) -> None:
        """Raises unless `column` rises along the stated order."""
        if not ordering.is_sorted(self.df, column, self.order_for(column)):
            raise ValueError(f"{column!r} is not sorted")
        self._sorted.add(column)

    def is_sorted(self, column: str) -> bool:
        """A hint only; no result depends on it."""
        return column in self._sorted

    def release(self) -> None:
        if self.cache:
            self.df.unpersist()


class SourceRegistry:
    def __init__(self):
        self.sources: dict[str, Source] = {}
        self.on_change: list = []

    def register(self, name: str, data: Any, cache: bool = False, order_by: list[str] | None = None, spark: SparkSession | None = None) -> Source:
        """Registers or replaces a source; replacing drops what was remembered of it."""
        df = data if isinstance(data, DataFrame) else frame_from(spark or SparkSession.getActiveSession(), data)
        old = self.sources.pop(name, None)
        if old is not None:
            old.release()
        for f in self.on_change:
            f(name)
        self.sources[name] = Source(name, df, order_by, cache)
        return self.sources[name]

    def get(self, name: str) -> Source:
        if name not in self.sources:
            raise KeyError(f"no source {name!r}; registered: {sorted(self.sources)}")
        return self.sources[name]

    def names(self) -> list[str]:
        return sorted(self.sources)


REGISTRY = SourceRegistry()


def register_source(name: str, data: Any, cache: bool = False, order_by: list[str] | None = None) -> Source:
    return REGISTRY.register(name, data, cache, order_by)
