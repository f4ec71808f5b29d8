"""Cubes as parquet tables named by their content keys.

A cube that another session or process has built is read, not built again; cells
and centres are all there is to a cube, so a stored one slices like a fresh one.
Sources must not change under a name: a changed source needs a new one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import cube as cubes


class CubeStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def get(self, spec: cubes.CubeSpec) -> cubes.Cube | None:
        path = f"{self.folder}/{cubes.content_key(spec)}"
        if not self._exists(f"{path}/cells"):
            return None
        centres: tuple[float, ...] = ()
        if spec.measure.agg == "corr":
            centres = tuple(r[0] for r in self.spark.read.parquet(f"{path}/centres").orderBy("i").select("centre").collect())
        return cubes.Cube(spec, self.spark.read.parquet(f"{path}/cells"), centres)

    def put(self, cube: cubes.Cube) -> cubes.Cube:
        """Centres go first, so that cells are the sign of a whole cube."""
        path = f"{self.folder}/{cubes.content_key(cube.spec)}"
        if cube.centres:
            rows = [(i, float(c)) for i, c in enumerate(cube.centres)]
            self.spark.createDataFrame(rows, "i int, centre double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        # Sorted by free bin, a slice skips row groups.
        keys = ["free_bin"] if "free_bin" in cube.frame.columns else cube.free_cols
        cube.frame.repartitionByRange(*map(F.col, keys)).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/cells")
        return self.get(cube.spec)

    def get_or_build(self, spec: cubes.CubeSpec, build: Callable[[], cubes.Cube]) -> cubes.Cube:
        return self.get(spec) or self.put(build())
