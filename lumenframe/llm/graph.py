"""Connected components of an edge table by alternating stars, all in DataFrames.

Large star: every node hands its larger neighbours to the smallest node it
knows.  Small star: every node hands its smaller neighbours, and itself, to the
smallest.  Both keep the components; when nothing changes, each component is a
star around its smallest node.  Minima
combine before the shuffle.  A node's edges do meet in one task when its minimum
is joined back: a row of two longs each, streamed and never held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    """Equal for equal sets of edges, and hardly for others.  Exclusive or has no limit of rows, as a sum of longs has."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.col("v")))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) for every node of `edges` (u, v); nodes without edges are absent."""
    e = scratch.keep(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    mark = None
    while True:
        new = scratch.keep(_small_star(_large_star(e)), "star")
        now = _mark(new)
        scratch.drop(e)
        e = new
        if now == mark:
            break
        mark = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = scratch.keep(found, "components")
    scratch.drop(e)
    return out
