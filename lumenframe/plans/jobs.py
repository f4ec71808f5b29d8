"""What traces ask of Spark, and how jobs of one filtered table share scans.

A trace asks for a job, a small description; `run` groups jobs that one scan can
serve (ungrouped histograms; reductions over the same keys), collects the few
rows of each, and hands them back by trace.  Results are bounded by bins, groups
or points, never by rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import edges
from ..operators import grouping, histogram


@dataclass(frozen=True)
class HistogramJob:
    uid: str
    column: str
    bins: int
    bounds: tuple[float, float]
    by: tuple[str, ...] = ()
    view: Column | None = None


@dataclass(frozen=True)
class ReduceJob:
    uid: str
    by: tuple[str, ...]
    func: str
    column: str | None


@dataclass(frozen=True)
class TableJob:
    """Any other bounded result: a function of the filtered table."""

    uid: str
    make: Callable[[DataFrame], DataFrame]


def _sorted_rows(rows: list[dict], by: tuple[str, ...]) -> list[dict]:
    """By group, nulls first."""
    return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in by))


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


#: Actions in flight at once; each is a small result of a shared or separate scan.
PARALLEL = 6


def _grouped_histogram(df: DataFrame, j: HistogramJob) -> dict[str, list[dict]]:
    rows = df if j.view is None else df.where(j.view)
    return {j.uid: _sorted_rows(_dicts(histogram.histogram(rows, j.column, j.bins, j.bounds, j.by)), (*j.by, "bin"))}


def _shared_histograms(df: DataFrame, group: list[HistogramJob]) -> dict[str, list[dict]]:
    """Ungrouped histograms of one view, in one scan."""
    if len(group) == 1:
        return _grouped_histogram(df, group[0])
    rows = df if group[0].view is None else df.where(group[0].view)
    found = _dicts(histogram.histograms(rows, [(j.uid, j.column, j.bins, j.bounds) for j in group]))
    out = {}
    for j in group:
        edge = edges(*j.bounds, j.bins)
        mine = _sorted_rows([r for r in found if r["trace"] == j.uid], ("bin",))
        out[j.uid] = [{"bin": r["bin"], "lo": edge[r["bin"]][0], "hi": edge[r["bin"]][1], "count": r["count"]} for r in mine]
    return out


def _shared_reductions(df: DataFrame, by: tuple[str, ...], group: list[ReduceJob]) -> dict[str, list[dict]]:
    """Reductions over the same keys, in one aggregation."""
    exprs = []
    for i, j in enumerate(group):
        v, kind = histogram.value_of(df, j.column) if j.column is not None else (None, None)
        exprs.append(grouping.simple_reducer(j.func if j.column is not None else "count", v, kind).alias(f"__v{i}"))
    rows = _sorted_rows(_dicts(df.groupBy(*by).agg(*exprs)), by)
    return {j.uid: [{**{c: r[c] for c in by}, "value": r[f"__v{i}"]} for r in rows] for i, j in enumerate(group)}


def run(df: DataFrame, jobs: list) -> dict[str, Any]:
    """uid -> rows (list of dicts).  Independent actions run side by side."""
    views: dict[str, list[HistogramJob]] = defaultdict(list)
    keys: dict[tuple[str, ...], list[ReduceJob]] = defaultdict(list)
    work: list[Callable[[], dict[str, Any]]] = []
    for j in jobs:
        if isinstance(j, HistogramJob) and not j.by:
            views[str(j.view)].append(j)
        elif isinstance(j, HistogramJob):
            work.append(lambda j=j: _grouped_histogram(df, j))
        elif isinstance(j, ReduceJob) and not (j.column is not None and j.func in ("median", "n_unique")):
            keys[j.by].append(j)
        elif isinstance(j, ReduceJob):
            work.append(lambda j=j: {j.uid: _sorted_rows(_dicts(grouping.aggregate(df, j.by, j.func, j.column)), j.by)})
        else:
            work.append(lambda j=j: {j.uid: _dicts(j.make(df))})
    work += [lambda g=g: _shared_histograms(df, g) for g in views.values()]
    work += [lambda by=by, g=g: _shared_reductions(df, by, g) for by, g in keys.items()]
    if len(work) < 2:
        found = [w() for w in work]
    else:
        with ThreadPoolExecutor(PARALLEL) as pool:
            found = [f.result() for f in [pool.submit(inheritable_thread_target(df.sparkSession)(w)) for w in work]]
    return {uid: rows for part in found for uid, rows in part.items()}


def overlay_histogram(df: DataFrame, job: HistogramJob, where: Column) -> tuple[list[dict], list[dict]]:
    """Background and foreground rows of a histogram from one scan."""
    rows = df if job.view is None else df.where(job.view)
    found = _sorted_rows(_dicts(histogram.histogram(rows, job.column, job.bins, job.bounds, job.by, where)), (*job.by, "bin"))
    return found, [{**r, "count": r["fg_count"]} for r in found]


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
