"""Live cubes: micro-batches add their cells to a stored cube.

Partials are associative, so a stream's cube is the merge of its batches' cubes.
Each batch writes one more version of the cells, named by its batch number, and
reads the one before; a batch that runs again writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import cube as cubes


class LiveCube:
    def __init__(self, spark: SparkSession, spec: cubes.CubeSpec, path: str, centres: tuple[float, ...] | None = None):
        if spec.measure.agg == "corr" and centres is None:
            raise ValueError("a live correlation needs fixed centres")
        self.spark, self.spec, self.path, self.centres = spark, spec, path.rstrip("/"), centres or ()

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = lambda s: fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v") and done(s))

    def add(self, batch: DataFrame, number: int) -> None:
        """Adds a batch; fit for foreachBatch."""
        before = [v for v in self._versions() if v < number]
        cells = cubes.build(batch, self.spec, centres=self.centres or None).frame
        if before:
            cells = cubes.merge_cells(self.spec, self.spark.read.parquet(f"{self.path}/v{before[-1]}").unionByName(cells))
        cells.write.mode("overwrite").parquet(f"{self.path}/v{number}")

    def cube(self) -> cubes.Cube:
        found = self._versions()
        if not found:
            raise ValueError("no batch has arrived yet")
        return cubes.Cube(self.spec, self.spark.read.parquet(f"{self.path}/v{found[-1]}"), self.centres)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Runs as a streaming query."""
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a key by time window, with late rows let in up to `late`: the tumbling form of a live bar chart."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), key).agg(F.count(F.lit(1)).alias("count"))
