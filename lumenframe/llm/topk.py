"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments; a segment of length l with mean m and deviation
norm d (the norm of what is left after the mean is taken off) bounds the inner
product of two segments by l*m*m' + d*d'.  Summed, that is an upper bound of the
score, that is a lower bound of the distance; it is a short inner product
itself, so a tile of pairs is bounded by one small matrix product.  Bounds go
from coarse to fine (LEVELS): a level looks only at the pairs that the one before
has left, as a smaller matrix, or pair by pair where few are left; what survives
the last gets an exact score.  All scores are exact integers.

The queries are written down once as a table partitioned by wave, and run in
waves of bounded size, one after the other: a wave's queries are sent to all
tasks, its scan keeps k rows for each query and task, and its result is merged
and written before the next begins.  No more than a wave is ever in the driver.
A query's first threshold comes from the other queries of its tile, which are rows
too; it is computed once, where the wave is sent from.

Edge cases: vectors that are null, empty, or hold null or non-finite components
take no part, nor do rows without an id; vectors are compared with those of
their own length only; ties go to the smaller id; a repeated row is a candidate
each time; a repeated query id is searched once, with its smallest vector;
scores beyond a long are held at its limits; an empty table, or one without
queries, gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, stream, table

#: Segments of each resolution, from coarse to fine.
LEVELS = (2, 8, 16)
#: Queries of one matrix product, and tiles of one wave (16 MB of vectors of 64 components).
TILE, TILES = 2048, 16
#: Share of a matrix's pairs below which they are computed one by one.
FEW = 0.05
#: Tasks for each core that a scan is cut into at most: each keeps k rows for each query.
TASKS = 8
SCALE = 1024
EXACT = float(1 << 53)
#: Components beyond it count as this much; their scores are beyond a long anyway.
LARGEST = 1e300


def quantised(vectors: list) -> tuple[list[int], list[np.ndarray]]:
    """Positions and floor(SCALE * x) of the vectors that take part."""
    at, out = [], []
    for i, v in enumerate(vectors):
        if v:
            x = np.array(v, float)
            if np.isfinite(x).all():
                at.append(i)
                out.append(np.floor(np.clip(x, -LARGEST, LARGEST) * SCALE))
    return at, out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows [sqrt(l) * mean of each segment, deviation norm of each segment]: their inner products are the bounds."""
    n, d = x.shape
    l = -(-d // segments)
    cut = np.zeros((n, segments * l))
    cut[:, :d] = x
    cut = cut.reshape(n, segments, l)
    mean = cut.mean(axis=2)
    return np.concatenate([math.sqrt(l) * mean, np.sqrt(np.maximum(((cut - mean[:, :, None]) ** 2).sum(axis=2), 0.0))], axis=1)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products as int64, exactly."""
    size = (np.abs(q).max(initial=0.0) + 1) * (np.abs(c).max(initial=0.0) + 1) * q.shape[1]
    if size < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(q).dot(whole(c).T), -(1 << 63), (1 << 63) - 1).astype(np.int64)


NONE = np.iinfo(np.int64).min


def first_thresholds(x: np.ndarray, k: int) -> np.ndarray:
    """For each vector the k-th best score among the others of its tile, or NONE."""
    if len(x) <= k:
        return np.full(len(x), NONE)
    own = exact(x, x)
    np.fill_diagonal(own, NONE)
    return np.partition(own, len(x) - k, axis=1)[:, len(x) - k]


class Tile:
    """Queries of one length, and the best rows found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.x, self.floor, self.k = ids, vectors, floor, k
        self.levels = [statistics(self.x, s) for s in LEVELS if s <= self.x.shape[1]]
        self.score = np.full((len(self.ids), self.k), NONE)
        self.id = np.full((len(self.ids), self.k), np.iinfo(np.int64).max)
        self.full = np.zeros(len(self.ids), bool)
        #: Pairs that each level has computed, and exact scores.
        self.computed = [0] * (len(self.levels) + 1)

    def scored(self, ids: np.ndarray, c: np.ndarray, stats: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, exact score) of the pairs whose bounds reach the query's least score at all levels, and that reach it themselves."""
        # The least long is also what scores below it are held at, so nothing is pruned against it.
        bar = np.where(least == NONE, -np.inf, least.astype(float))
        reaches = lambda bound, bar: ~(bound * (1 + np.sign(bound) * 1e-9) + 1.0 < bar)
        q, r, left = np.arange(len(self.ids)), np.arange(len(ids)), self.ids[:, None] != ids[None, :]
        pairs = None
        for n, (mine, theirs) in enumerate(zip(self.levels, stats)):
            if pairs is None:
                self.computed[n] += left.size
                left &= reaches(mine[q] @ theirs[r].T, bar[q][:, None])
                some_q, some_r = left.any(axis=1), left.any(axis=0)
                if not (some_q.all() and some_r.all()):
                    q, r, left = q[some_q], r[some_r], left[np.ix_(some_q, some_r)]
                if left.sum() < FEW * left.size:
                    a, b = np.nonzero(left)
                    pairs = q[a], r[b]
            else:
                a, b = pairs
                self.computed[n] += len(a)
                good = reaches(np.einsum("ij,ij->i", mine[a], theirs[b]), bar[a])
                pairs = a[good], b[good]
        if pairs is None:
            self.computed[-1] += left.size
            s = exact(self.x[q], c[r])
            a, b = np.nonzero(left & (s >= least[q][:, None]))
            return q[a], r[b], s[a, b]
        a, b = pairs
        self.computed[-1] += len(a)
        if not len(a):
            return a, b, a
        # Pairs come by query, so each query has a run of rows.
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        return a, b, np.concatenate([exact(self.x[a[i] : a[i] + 1], c[b[i:j]])[0] for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(a)])])

    def offer(self, ids: np.ndarray, c: np.ndarray, stats: list[np.ndarray]) -> None:
        least = np.maximum(self.floor, np.where(self.full, self.score[:, -1], NONE))
        a, b, s = self.scored(ids, c, stats, least)
        if not len(a):
            return
        worst = np.where(self.full, self.id[:, -1], np.iinfo(np.int64).max)[a]
        good = (s > least[a]) | ((s == least[a]) & (ids[b] <= worst))
        a, b, s = a[good], b[good], s[good]
        if not len(a):
            return
        old = np.unique(a)
        n = len(old)
        q = np.concatenate([a, np.repeat(old, self.k)])
        score = np.concatenate([s, self.score[old].ravel()])
        ident = np.concatenate([ids[b], self.id[old].ravel()])
        order = np.lexsort((ident, ~score, q))
        q, score, ident = q[order], score[order], ident[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        keep = (np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))) < self.k
        self.score[old] = score[keep].reshape(n, self.k)
        self.id[old] = ident[keep].reshape(n, self.k)
        self.full[old] = self.id[old][:, -1] != np.iinfo(np.int64).max

    def found(self) -> dict[str, list]:
        a, b = np.nonzero(self.id != np.iinfo(np.int64).max)
        return {"query_id": self.ids[a].tolist(), "vec_id": self.id[a, b].tolist(), "score": self.score[a, b].tolist()}


def tiles(queries: list, k: int, tile: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, first thresholds) of the queries (id, vector), by length and in tiles; a repeated id has its smallest vector."""
    at, vectors = quantised([r[1] for r in queries])
    one: dict[int, np.ndarray] = {}
    for i, v in zip(at, vectors):
        q = queries[i][0]
        if q not in one or (len(v), v.tolist()) < (len(one[q]), one[q].tolist()):
            one[q] = v
    by_length: dict[int, list[int]] = {}
    for q in sorted(one):
        by_length.setdefault(len(one[q]), []).append(q)
    out = []
    for ids in by_length.values():
        for i in range(0, len(ids), tile):
            x = np.array([one[q] for q in ids[i : i + tile]])
            out.append((np.array(ids[i : i + tile], np.int64), x, first_thresholds(x, k)))
    return out


def _wave(rows: DataFrame, queries: list, k: int, tile: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(tiles(queries, k, tile))

    def run(batches):
        by_length: dict[int, list[Tile]] = {}
        for ids, x, floor in shared.value:
            by_length.setdefault(x.shape[1], []).append(Tile(ids, x, floor, k))
        for b in batches:
            at, vectors = quantised(b["v"])
            lengths = np.array([len(v) for v in vectors], np.int64)
            for d in np.unique(lengths).tolist():
                if d in by_length:
                    here = np.flatnonzero(lengths == d).tolist()
                    ids, c = np.array([b["vec_id"][at[i]] for i in here], np.int64), np.array([vectors[i] for i in here])
                    stats = [statistics(c, s) for s in LEVELS if s <= d]
                    for one in by_length[d]:
                        one.offer(ids, c, stats)
        for some in by_length.values():
            for one in some:
                yield one.found()

    return stream(rows, run, "query_id long, vec_id long, score long", 1024)


def search(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", value: str = "embedding", tile: int = TILE, waves_of: int = TILES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row of `vectors` where `is_query` holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = vectors.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(value).alias("v"))
    asked = rows.where(is_query(F.col("vec_id")))
    waves = max(1, -(-asked.count() // (tile * waves_of)))
    if waves > 1:
        path = scratch.path("queries")
        asked.withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(waves)).cast("int")).repartition("wave").write.partitionBy("wave").parquet(path)
        asked = spark.read.parquet(path)
    scanned = rows.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for i in range(waves):
        mine = asked.where(F.col("wave") == i) if waves > 1 else asked
        found = _wave(scanned, [tuple(r) for r in mine.select("vec_id", "v").collect()], k, tile)
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        # One wave after the other; the last, or only, one is left to the reader.
        found = scratch.keep(found, "found") if i < waves - 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
