"""A brush answered from cubes.

Opening a brush builds (or finds) one cube for each distinct target and persists
it; every move then filters cells, adds partials up and shapes them with the
traces' own code, so a drag never reads the rows again.  Committing turns the
brush into the half-open, grid-aligned clause that gives the same result from
the rows.
"""

from __future__ import annotations

from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions.binning import edges
from ..functions.typing import from_physical, is_temporal, kind_of
from . import cube as cubes
from . import traces as t
from .cubestore import CubeStore
from .engine import Engine, TraceInfo
from .spec import ActiveSource, ClauseFilter, SelectionPredicate, SelectionState, TraceDelta


def category_keys(columns: tuple[str, ...], predicates: list[SelectionPredicate]) -> list[tuple]:
    """Key tuples (or prefixes) that predicates of single values on leading columns of a categorical axis stand for."""
    out = []
    for p in predicates:
        named = {c.column: c.values for c in p.clauses}
        if any(v is None or len(v) != 1 for v in named.values()) or list(named) != [c for c in columns if c in named] or set(named) != set(columns[: len(named)]) or not named:
            raise ValueError("a categorical brush takes one value for each leading column")
        out.append(tuple(named[c][0] for c in columns[: len(named)]))
    return out


def _histogram_rows(trace: t.Histogram, spec: cubes.CubeSpec, rows: list[dict]) -> list[dict]:
    dim = spec.target_dims[0]
    edge = edges(*dim.domain, dim.bins)
    found: dict[tuple, dict[int, int]] = {}
    for r in rows:
        found.setdefault(tuple(r[c] for c in trace.by), {})[r[dim.key]] = int(r["value"])
    groups = sorted(found, key=lambda g: tuple((v is not None, v if v is not None else "") for v in g)) if trace.by else [()]
    return [{**dict(zip(trace.by, g)), "bin": i, "lo": lo, "hi": hi, "count": found.get(g, {}).get(i, 0)} for g in groups for i, (lo, hi) in enumerate(edge)]


def _tree_rows(trace: t.TreeMap, rows: list[dict]) -> list[dict]:
    """Leaves and the sums above them, level by level."""
    out = []
    for level in range(len(trace.path) + 1):
        sums: dict[tuple, float] = {}
        for r in rows:
            key = tuple(r[c] for c in trace.path[:level])
            sums[key] = sums.get(key, 0) + r["value"]
        if level == 0 and not rows:
            sums[()] = 0
        out += [{"level": level, **dict(zip(trace.path, k)), "value": v} for k, v in sorted(sums.items(), key=lambda z: tuple(map(str, z[0])))]
    return out


def _line_rows(trace: t.LinePlot, spec: cubes.CubeSpec, rows: list[dict], kind) -> list[dict]:
    """Two points of each bucket in order of x; a bucket with one extreme gives one."""
    bucket = cubes.bucket_dim(spec).key
    out = []
    order = lambda r: (tuple((r[c] is not None, r[c] if r[c] is not None else "") for c in trace.by), r[bucket])
    for r in sorted(rows, key=order):
        points = sorted({(r["x_at_ymin"], r["y_min"]), (r["x_at_ymax"], r["y_max"])})
        out += [{**{c: r[c] for c in trace.by}, "__x": from_physical(x, kind) if is_temporal(kind) else x, "__y": y} for x, y in points]
    return out


def rows_for(trace: t.Trace, spec: cubes.CubeSpec, rows: list[dict], schema) -> list[dict]:
    """Slice rows in the form of the trace's own aggregation."""
    if isinstance(trace, t.Histogram):
        return _histogram_rows(trace, spec, rows)
    if isinstance(trace, (t.BarPlot, t.PiePlot)):
        by = (*trace.by, *trace.labels)
        return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c] if r[c] is not None else "") for c in by))
    if isinstance(trace, t.TreeMap):
        return _tree_rows(trace, rows)
    if isinstance(trace, t.Histogram2D):
        x, y = spec.target_dims
        got = {(r[x.key], r[y.key]): r["value"] for r in rows}
        empty = 0.0 if spec.measure.agg == "count" else None
        return [{"xb": i, "yb": j, "value": got.get((i, j), empty)} for j in range(y.bins) for i in range(x.bins)]
    if isinstance(trace, t.LinePlot):
        return _line_rows(trace, spec, rows, kind_of(schema, trace.backend_data["x"]))
    if isinstance(trace, t.CorrHeatmap):
        return [{**r, "r": abs(r["r"])} for r in rows] if trace.params["absolute"] else rows
    raise ValueError(f"{trace.trace_type} is not served by cubes")


def prepare(trace: t.Trace, spec: cubes.CubeSpec, schema) -> None:
    """What a trace remembers between its job and its shaping."""
    if isinstance(trace, t.Histogram):
        trace.kind, trace.bounds = kind_of(schema, trace.column), spec.target_dims[0].domain
    elif isinstance(trace, t.Histogram2D):
        trace.kinds = [kind_of(schema, trace.backend_data[r]) for r in "xy"]
        trace.bounds = [d.domain for d in spec.target_dims]
    elif isinstance(trace, t.CorrHeatmap):
        trace.columns = list(spec.measure.columns)


class Brush:
    def __init__(self, engine: Engine, infos: list[TraceInfo], viewports: dict[str, dict], selections: list[SelectionState], active: ActiveSource, store: CubeStore | None = None):
        self.engine, self.active = engine, active
        self.specs, by_trace, passive = engine.plan_cubes(infos, viewports, selections, active)
        self.targets = [(i, by_trace[i.uid]) for i in infos if i.uid in by_trace]
        self.cubes = {}
        for key, spec in self.specs.items():
            built = engine.cube(spec, passive) if store is None else store.get_or_build(spec, lambda spec=spec: engine.cube(spec, passive))
            built.frame = built.frame.persist(StorageLevel.MEMORY_AND_DISK)
            self.cubes[key] = built

    @property
    def free(self) -> cubes.FreeAxis | None:
        return next(iter(self.specs.values())).free if self.specs else None

    def _slice(self, key: str, brush: Any) -> DataFrame:
        c = self.cubes[key]
        if self.free.kind == "categorical":
            return c.slice_keys(brush)
        if self.free.kind == "box2d":
            return c.slice_box(*brush)
        return c.slice(*brush)

    def move(self, brush: Any) -> list[TraceDelta]:
        """Deltas of all served traces: (lo, hi), ((x lo, x hi), (y lo, y hi)) or a list of category tuples."""
        found = {k: [r.asDict() for r in self._slice(k, brush).collect()] for k in self.cubes}
        out = []
        for info, key in self.targets:
            spec = self.specs[key]
            prepare(info.trace, spec, self.engine.source.schema)
            rows = rows_for(info.trace, spec, found[key], self.engine.source.schema)
            out.append(self.engine._delta(info, self.engine._payload(info, rows), None))
        return out

    def commit(self, brush: Any) -> SelectionState:
        """The selection that the brush leaves behind, grid-aligned, so that it selects what the cubes have shown."""
        f = self.free

        def clause(column: str, r: tuple, domain: tuple, unit: str | None) -> ClauseFilter:
            lo, hi = cubes.snapped_range(cubes.snap(*r, domain, f.p, unit), domain, f.p, unit)
            kind = kind_of(self.engine.source.schema, column)
            if is_temporal(kind):
                lo, hi = (from_physical(v, kind).isoformat() for v in (lo, hi))
            return ClauseFilter(column, range=(lo, hi), closed="left")

        if f.kind == "categorical":
            predicates = [SelectionPredicate([ClauseFilter(c, values=[v]) for c, v in zip(f.columns, k)]) for k in brush]
        elif f.kind == "box2d":
            predicates = [SelectionPredicate([clause(c, r, d, u) for c, r, d, u in zip(f.columns, brush, f.domains, f.units())])]
        else:
            predicates = [SelectionPredicate([clause(f.column, brush, f.domain, f.unit)])]
        return SelectionState(self.active.figure_uid, predicates)

    def close(self) -> None:
        for c in self.cubes.values():
            c.frame.unpersist()
