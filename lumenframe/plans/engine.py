"""From an interaction to the changes of each trace.

The engine keeps no interaction state: the caller sends event, traces, viewports
and mode each time.  It decides which traces an event touches, compiles the
other figures' selections to one filter, lets the job planner share scans, and
shapes the collected rows.  For a cube request it finds the free axis, bakes
the passive selections in, resolves domains over all rows and builds one cube
for each distinct content key.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame

from ..functions.binning import EDGE_EPS
from ..functions.labels import child_uid
from ..functions.typing import is_temporal, kind_of, physical_bound, unit_of
from ..operators import predicates
from ..sources.registry import Source
from . import codec, cube as cubes, jobs
from .cache import LRU
from .spec import ActiveSource, GroupedChildDelta, InteractionEvent, SelectionState, TraceDelta
from .traces import Histogram, Histogram2D, Trace

#: Events that show unfiltered data at full extent, whose payloads may be remembered.
PLAIN_EVENTS = ("init", "reset", "deselect")


@dataclass
class TraceInfo:
    uid: str
    figure_uid: str | None
    trace: Trace


def ascending(ranges: dict[str, Any]) -> dict[str, Any]:
    """Axis ranges with descending pairs turned round; anything else as it is."""
    out = {}
    for axis, r in (ranges or {}).items():
        if isinstance(r, dict) and set(r) == {"min", "max"}:
            r = (r["min"], r["max"])
        if isinstance(r, (list, tuple)) and len(r) == 2 and not any(isinstance(v, (list, tuple)) or v is None for v in r):
            try:
                r = (r[1], r[0]) if r[0] > r[1] else tuple(r)
            except TypeError:
                pass
        out[axis] = r
    return out


def owners(selections: list[SelectionState]) -> set[str]:
    return {s.source_figure_uid for s in selections if s.source_figure_uid is not None}


class Engine:
    def __init__(self, source: Source, cache: LRU | None = None):
        self.source, self.cache = source, cache

    # -- which traces, which rows
    def _active(self, event: InteractionEvent) -> list[SelectionState]:
        return [] if event.type in PLAIN_EVENTS else list(event.selections)

    def _filters(self, event: InteractionEvent, active: list[SelectionState]) -> list:
        own = event.figure_uid if event.type == "viewport" else None
        return [predicates.selection(s.predicates, self.source.schema) for s in active if s.source_figure_uid not in (None, own) and s.predicates]

    @staticmethod
    def _ranges(event: InteractionEvent, figure: str | None, viewports: dict[str, dict]) -> dict[str, Any]:
        if event.type == "viewport":
            return ascending(event.axis_ranges)
        return dict(viewports.get(figure, {})) if figure is not None else {}

    def _touched(self, event, infos, active, viewports) -> list[tuple[TraceInfo, dict[str, Any]]]:
        selecting = owners(active)
        out = []
        for info in infos:
            # A figure that selects shows its own rows unfiltered, so it stays as it is; while it is panned itself it may still re-bin.
            if info.figure_uid in selecting and (event.type == "selection" or info.figure_uid != event.figure_uid):
                continue
            ranges = self._ranges(event, info.figure_uid, viewports)
            if not event.force_update and not set(info.trace.recompute_axes) & set(ranges):
                continue
            binding = {} if event.type == "reset" else {a: ranges[a] for a in info.trace.recompute_axes if a in ranges and ranges[a] is not None}
            out.append((info, binding))
        return out

    def _siblings(self, items: list[tuple[TraceInfo, bool]]) -> dict[str, tuple[str, ...]]:
        """Unzoomed histograms of one figure on one axis share a domain, so their bars line up; temporal units never mix."""
        groups: dict[tuple, list[str]] = {}
        mine: dict[str, tuple] = {}
        for info, zoomed in items:
            t = info.trace
            if isinstance(t, Histogram) and not zoomed:
                key = (info.figure_uid, t.axes, t.role, unit_of(kind_of(self.source.schema, t.column)))
                mine[info.uid] = key
                if t.column not in groups.setdefault(key, []):
                    groups[key].append(t.column)
        return {uid: tuple(groups[key]) for uid, key in mine.items()}

    @staticmethod
    def _zoomed(info: TraceInfo, ranges: dict[str, Any]) -> bool:
        t = info.trace
        return isinstance(t, Histogram) and ranges.get(t.axes["xy".index(t.role)]) is not None

    # -- deltas
    def process(self, event: InteractionEvent, infos: list[TraceInfo], viewports: dict[str, dict] | None = None, mode: str = "update") -> list[TraceDelta]:
        if event.type == "cube_request":
            return []
        viewports = {f: ascending(v) for f, v in (viewports or {}).items()}
        active = self._active(event)
        touched = self._touched(event, infos, active, viewports)
        if not touched:
            return []
        siblings = self._siblings([(i, self._zoomed(i, r)) for i, r in touched])
        keys = {i.uid: self._key(i, siblings) for i, r in touched if not r} if self.cache is not None and event.type in PLAIN_EVENTS else {}
        if len(keys) == len(touched):
            known = {uid: self.cache.get(k) for uid, k in keys.items()}
            if all(v is not None for v in known.values()):
                return [self._delta(i, known[i.uid], "bg" if mode == "overlay" else None) for i, _ in touched]
        wanted = {i.uid: i.trace.job(self.source, r, siblings.get(i.uid, ())) for i, r in touched}
        filters = self._filters(event, active)
        df = self.source.df
        out: list[TraceDelta] = []
        if mode == "overlay":
            out = self._overlay(df, touched, wanted, filters, bool(active))
        else:
            rows = jobs.run(df.where(jobs.all_of(filters)) if filters else df, self._plan(touched, wanted, bool(filters), df, filters))
            out = [self._delta(i, self._payload(i, rows[i.uid]), None) for i, _ in touched]
        for d in out:
            if d.uid in keys and d.layer != "fg":
                self.cache.set(keys[d.uid], self._content(d))
        return out

    def _plan(self, touched, wanted, filtered: bool, df: DataFrame, filters: list) -> list:
        """The jobs; unzoomed histograms fall back to 0..1 when no row is left, as their bounds come from the rows that are."""
        plan = [wanted[i.uid] for i, _ in touched]
        open_ = [n for n, (i, r) in enumerate(touched) if isinstance(i.trace, (Histogram, Histogram2D)) and not r]
        if filtered and open_ and df.where(jobs.all_of(filters)).isEmpty():
            for n in open_:
                trace = touched[n][0].trace
                if isinstance(trace, Histogram):
                    trace.bounds = (0.0, 1.0 + EDGE_EPS)
                    plan[n] = replace(plan[n], bounds=trace.bounds)
                else:
                    trace.bounds = [(0.0, 1.0), (0.0, 1.0)]
        return plan

    def _overlay(self, df, touched, wanted, filters, selected: bool) -> list[TraceDelta]:
        """Background and foreground layers.  Histograms get both from one scan."""
        out: list[TraceDelta] = []
        where = jobs.all_of(filters) if filters else None
        both: dict[str, tuple] = {}
        back, front = [], []
        for i, _ in touched:
            j = wanted[i.uid]
            alone = i.trace.filtered_only and selected
            if where is not None and isinstance(j, jobs.HistogramJob) and not alone:
                both[i.uid] = jobs.overlay_histogram(df, j, where)
                continue
            if not alone:
                back.append(j)
            if where is not None:
                front.append(j)
        bg = jobs.run(df, back)
        shaped = {i.uid: self._payload(i, bg[i.uid] if i.uid in bg else both[i.uid][0]) for i, _ in touched if i.uid in bg or i.uid in both}
        out += [self._delta(i, shaped[i.uid], "bg") for i, _ in touched if i.uid in shaped]
        if where is not None:
            fg = jobs.run(df.where(where), front)
            out += [self._delta(i, self._payload(i, fg[i.uid] if i.uid in fg else both[i.uid][1]), "fg") for i, _ in touched]
        return out

    def _payload(self, info: TraceInfo, rows: list[dict]) -> dict[str, Any]:
        """uid-free: updates, or key and updates of each group."""
        got = info.trace.shape(rows)
        return {"groups": [(g.key, g.updates) for g in got]} if isinstance(got, list) else {"updates": got}

    def _delta(self, info: TraceInfo, payload: dict[str, Any], layer: str | None) -> TraceDelta:
        if "groups" in payload:
            children = [GroupedChildDelta(child_uid(info.uid, k), u, info.uid, k) for k, u in payload["groups"]]
            return TraceDelta(info.uid, {}, children, layer)
        return TraceDelta(info.uid, payload["updates"], None, layer)

    @staticmethod
    def _content(delta: TraceDelta) -> dict[str, Any]:
        if delta.group_results is not None:
            return {"groups": [(c.group_value_key, c.updates) for c in delta.group_results]}
        return {"updates": delta.updates}

    def _key(self, info: TraceInfo, siblings: dict[str, tuple[str, ...]]) -> str:
        return json.dumps([self.source.name, info.trace.content(), siblings.get(info.uid, ())], sort_keys=True, default=str)

    # -- cubes
    def _axis_range(self, viewports: dict[str, dict], figure: str | None, anchor: str | None, column: str | None) -> tuple[float, float] | None:
        """A figure's view of an axis in physical numbers; None where it is not zoomed, or not a range."""
        r = (viewports.get(figure) or {}).get(anchor) if figure is not None and anchor is not None else None
        if not (isinstance(r, (list, tuple)) and len(r) == 2):
            return None
        kind = kind_of(self.source.schema, column)
        if is_temporal(kind):
            if all(isinstance(v, (int, float)) for v in r):
                return float(r[0]), float(r[1])
            got = tuple(physical_bound(v, kind) for v in r)
            return None if None in got else got
        return (float(r[0]), float(r[1])) if all(isinstance(v, (int, float)) for v in r) else None

    def _free_axis(self, infos, viewports, active: ActiveSource) -> cubes.FreeAxis | None:
        info = next((i for i in infos if i.uid == active.trace_uid), None)
        if info is None or info.figure_uid != active.figure_uid:
            return None
        t = info.trace
        view = lambda anchor, column: self._axis_range(viewports, info.figure_uid, anchor, column)
        free = t.cube_source(view(t.select_axes[0] if t.select_axes else None, active.column), self.source.schema)
        if free is None or free.column != active.column:
            return None
        if free.kind == "categorical":
            return free
        if free.kind == "box2d":
            found = [view(a, c) for a, c in zip(t.select_axes, free.columns)]
            known = self.source.domains([c for c, d in zip(free.columns, found) if d is None])
            domains = [d or known[c] for c, d in zip(free.columns, found)]
            return None if any(None in d for d in domains) else replace(free, domains=tuple(map(tuple, domains)))
        domain = free.domain or self.source.domains([free.column])[free.column]
        return None if None in domain else replace(free, domain=tuple(map(float, domain)))

    def _target(self, info: TraceInfo, viewports, siblings) -> cubes.CubeTarget | None:
        """The target with all domains resolved, over all rows."""
        t = info.trace
        columns = {a: t.backend_data.get("xy"[i]) for i, a in enumerate(t.axes or ())}
        view = {a: self._axis_range(viewports, info.figure_uid, a, columns.get(a) if isinstance(columns.get(a), str) else None) for a in t.recompute_axes}
        if any(view[a] is not None for a in t.recompute_axes[1:]):
            return None
        target = t.cube_target(view[t.recompute_axes[0]] if t.recompute_axes else None, self.source.schema)
        if target is None:
            return None
        dims = []
        for d in target.target_dims:
            if d.kind == "binned":
                domain = d.domain
                if domain is None:
                    found = self.source.domains(list(dict.fromkeys([*siblings.get(info.uid, ()), d.column]))).values()
                    if any(None in f for f in found):
                        return None
                    domain = (min(f[0] for f in found), max(f[1] for f in found))
                pad = 0.0 if d.bin_variant == "hist2d" else EDGE_EPS
                d = replace(d, domain=(float(domain[0]), float(domain[1]) + pad), unit=unit_of(kind_of(self.source.schema, d.column)))
            dims.append(d)
        return replace(target, target_dims=tuple(dims))

    def plan_cubes(self, infos, viewports, selections, active: ActiveSource) -> tuple[dict[str, cubes.CubeSpec], dict[str, str], list]:
        """(content key -> spec, target uid -> content key, passive selections)."""
        viewports = {f: ascending(v) for f, v in (viewports or {}).items()}
        free = self._free_axis(infos, viewports, active)
        passive = [s for s in selections if s.source_figure_uid not in (None, active.figure_uid) and s.predicates]
        if free is None:
            return {}, {}, passive
        resting = [i for i in infos if i.figure_uid != active.figure_uid and i.figure_uid not in owners(passive)]
        siblings = self._siblings([(i, self._zoomed(i, viewports.get(i.figure_uid) or {})) for i in resting])
        specs: dict[str, cubes.CubeSpec] = {}
        by_trace: dict[str, str] = {}
        for i in resting:
            target = self._target(i, viewports, siblings)
            if target is None or not cubes.buildable(free, target.measure):
                continue
            spec = cubes.CubeSpec(self.source.name, free, target.target_dims, target.measure, predicates.passive_key(selections, active.figure_uid))
            key = cubes.content_key(spec)
            specs.setdefault(key, spec)
            by_trace[i.uid] = key
        return specs, by_trace, passive

    def cube(self, spec: cubes.CubeSpec, passive: list[SelectionState]) -> cubes.Cube:
        df = self.source.df
        for s in passive:
            df = df.where(predicates.selection(s.predicates, self.source.schema))
        order = self.source.order_by or None
        return cubes.build(df, spec, order)

    def build_cubes(self, infos, viewports, selections, active: ActiveSource, cache: LRU | None = None) -> tuple[list[bytes], dict[str, int]]:
        """Encoded cubes, one for each distinct content, and the cube of each trace it serves."""
        specs, by_trace, passive = self.plan_cubes(infos, viewports, selections, active)
        blobs, index = [], {}
        for key, spec in specs.items():
            blob = cache.get(key) if cache is not None else None
            if blob is None:
                blob = codec.encode_cube(self.cube(spec, passive), key)
                if cache is not None:
                    cache.set(key, blob)
            index[key] = len(blobs)
            blobs.append(blob)
        return blobs, {uid: index[key] for uid, key in by_trace.items()}
