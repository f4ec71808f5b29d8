"""The ten traces: what each asks of Spark, how its rows become a payload, and its place in cross-filtering.

A trace holds column roles, parameters and display hints, nothing else; it
serialises to a `TraceSpec` and back.  `job` describes the aggregation for a
viewport, `shape` turns the collected rows into updates (or one child for each
group).
"""

from __future__ import annotations

import json
import math
from typing import Any
from urllib.parse import quote
from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.labels import column_tuple, composite_label, group_key
from ..functions.typing import epoch_ms_factor, from_physical, in_range, is_numeric, is_temporal, kind_of, physical_bound, unit_of
from ..operators import correlation, downsample, grouping, histogram
from . import cube as cubes
from .jobs import HistogramJob, ReduceJob, TableJob
from .spec import TraceHoverSpec, TraceSelectionSpec, TraceSpec

NORMS_2D = (None, "percent", "probability", "density", "probability density")
DOWNSAMPLES = ("minmax", "fpcs", "nth")
AGGS = ("sum", "mean", "median", "min", "max", "n_unique")


def _checked(value: Any, options: tuple, what: str) -> Any:
    if value not in options:
        raise ValueError(f"{what} must be one of {options}, not {value!r}")
    return value


def _given(**named: Any) -> dict[str, Any]:
    return {k: v for k, v in named.items() if v is not None}


def checked_range(value: Any, default: Any) -> Any:
    """'auto' or a finite (min, max)."""
    if value is None:
        return default
    if isinstance(value, str) and value == "auto":
        return value
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        raise TypeError("color_range is 'auto' or (min, max)")
    lo, hi = float(value[0]), float(value[1])
    if not (math.isfinite(lo) and math.isfinite(hi)) or lo >= hi:
        raise ValueError("color_range needs finite numbers with min < max")
    return (lo, hi)


def checked_scale(value: Any, default: str) -> str:
    if value is None:
        return default
    if not isinstance(value, str) or not value:
        raise TypeError("color_scale is the name of a scale")
    return value


class Group:
    """The payload of one group of a grouped trace."""

    def __init__(self, value: Any, updates: dict[str, Any]):
        self.key, self.updates = group_key(value), updates


class Trace:
    trace_type = ""
    #: Whether overlay mode draws a filtered trace alone, without its unfiltered background.
    filtered_only = False
    #: Roles of the anchors whose viewport the aggregation depends on, and on which a box brush selects: 0 is x, 1 is y.
    recompute_roles: tuple[int, ...] = ()
    select_roles: tuple[int, ...] = ()
    hover = ((), ())

    def __init__(self, backend_data: dict[str, Any], params: dict[str, Any], display: dict[str, Any], axes: tuple[str, ...] | None):
        self.uid = str(uuid4())
        self.backend_data, self.params, self.display = backend_data, params, display
        self.axes = tuple(axes) if axes else None
        self.recompute_axes = self.default_recompute_axes()

    # -- policies
    def default_recompute_axes(self) -> tuple[str, ...]:
        return tuple(self.axes[i] for i in self.recompute_roles) if self.axes else ()

    @property
    def select_axes(self) -> tuple[str, ...]:
        return tuple(self.axes[i] for i in self.select_roles) if self.axes else ()

    @property
    def by(self) -> tuple[str, ...]:
        g = self.params.get("group_by")
        return () if g is None else column_tuple(g, "group_by")

    def selection(self) -> TraceSelectionSpec:
        columns = {}
        for i in self.select_roles:
            c = self.backend_data.get("xy"[i])
            if self.axes and isinstance(c, str):
                columns[self.axes[i]] = c
        return TraceSelectionSpec(kind="range", axis_columns=columns) if columns else TraceSelectionSpec()

    # -- wire form
    def to_spec(self, domain_source: str | None = None) -> TraceSpec:
        params = dict(self.params)
        if domain_source is not None and self.by and "group_domain_key" not in params:
            params["group_domain_key"] = f"{domain_source}::{self.by[0] if len(self.by) == 1 else json.dumps(list(self.by), separators=(',', ':'))}"
        return TraceSpec(self.uid, self.trace_type, self.axes, dict(self.backend_data), params, dict(self.display), self.recompute_axes, self.selection(), TraceHoverSpec(*map(list, self.hover)))

    @classmethod
    def arguments(cls, spec: TraceSpec) -> dict[str, Any]:
        """Constructor arguments from a spec."""
        return {**spec.backend_data, **{k: v for k, v in spec.params.items() if k != "group_domain_key"}, **spec.display, **({"axes": tuple(spec.axes)} if spec.axes else {})}

    @classmethod
    def from_spec(cls, spec: TraceSpec) -> "Trace":
        trace = cls(**cls.arguments(spec))
        trace.uid = spec.uid
        if "group_domain_key" in spec.params:
            trace.params["group_domain_key"] = spec.params["group_domain_key"]
        if spec.recompute_axes is not None:
            trace.recompute_axes = tuple(spec.recompute_axes)
        return trace

    # -- what a reader is told
    def on_axes(self) -> dict[str, str]:
        """What its axes show: by default the columns in its roles."""
        return {role: c for role in "xy" if isinstance(c := self.backend_data.get(role), str)}

    def headline(self) -> str | None:
        """What it shows as a whole, where no axis says it."""
        return None

    # -- cube descriptors
    def cube_source(self, axis_range: tuple[float, float] | None, schema) -> cubes.FreeAxis | None:
        return None

    def cube_target(self, axis_range: tuple[float, float] | None, schema) -> cubes.CubeTarget | None:
        return None

    # -- aggregation
    def job(self, source, update_range: dict[str, Any], siblings: tuple[str, ...] = ()):
        raise NotImplementedError

    def shape(self, rows: list[dict]) -> dict[str, Any] | list[Group]:
        raise NotImplementedError

    def content(self) -> dict[str, Any]:
        """What the payload of an unfiltered, unzoomed trace depends on, without its uid."""
        return {"t": self.trace_type, "b": self.backend_data, "p": {k: v for k, v in self.params.items() if k != "group_domain_key"}, "d": self.display, "a": self.axes}

    def _split(self, rows: list[dict], by: tuple[str, ...]) -> list[tuple[Any, list[dict]]]:
        """Rows of neighbouring equal groups, as (value or tuple, rows)."""
        out: list[tuple[Any, list[dict]]] = []
        for r in rows:
            g = r[by[0]] if len(by) == 1 else tuple(r[c] for c in by)
            if not out or out[-1][0] != g:
                out.append((g, []))
            out[-1][1].append(r)
        return out

    def _range_source(self, column: str, axis_range, schema) -> cubes.FreeAxis | None:
        kind = kind_of(schema, column)
        if is_temporal(kind):
            return cubes.FreeAxis(column, "temporal", domain=axis_range, unit=unit_of(kind))
        if kind is not None and not is_numeric(kind):
            return None
        return cubes.FreeAxis(column, domain=axis_range)


def axis_bounds(source, column: str, axis_range: Any, siblings: tuple[str, ...] = ()) -> tuple[float | None, float | None]:
    """Physical bounds of an axis: the viewport, or the domain of the column and its siblings over all rows."""
    kind = kind_of(source.schema, column)
    if axis_range is not None:
        if is_temporal(kind):
            return tuple(physical_bound(v, kind) for v in axis_range)
        return float(axis_range[0]), float(axis_range[1])
    found = source.domains(list(dict.fromkeys([*siblings, column]))).values()
    lows, highs = [a for a, _ in found if a is not None], [b for _, b in found if b is not None]
    return (min(lows) if lows else None), (max(highs) if highs else None)


class Histogram(Trace):
    trace_type = "histogram"
    hover = (("axis", "cell"), ("axis", "cell"))

    def __init__(self, x=None, y=None, bins=20, histnorm="count", name=None, color=None, color_map=None, axes=("x", "y"), group_by=None):
        if (x is None) == (y is None):
            raise ValueError("give x or y, not both")
        _checked(histnorm, histogram.NORMS, "histnorm")
        self.role = "x" if x is not None else "y"
        self.recompute_roles = self.select_roles = ("xy".index(self.role),)
        by = column_tuple(group_by, "group_by") if group_by is not None else None
        self.column = x if x is not None else y
        super().__init__({self.role: self.column}, {"bins": bins, "histnorm": histnorm, **_given(group_by=list(by) if by else None)}, {"name": name or self.column, **_given(color=color, color_map=color_map)}, axes)

    def job(self, source, update_range, siblings=()):
        view = update_range.get(self.axes["xy".index(self.role)])
        self.kind = kind_of(source.schema, self.column)
        self.bounds = histogram.padded(axis_bounds(source, self.column, view, siblings))
        where = in_range(self.column, tuple(view), self.kind) if view is not None else None
        return HistogramJob(self.uid, self.column, self.params["bins"], self.bounds, self.by, where)

    def on_axes(self):
        return {"x": self.params["histnorm"], "y": self.params["histnorm"], self.role: self.column}

    def _payload(self, rows):
        counts = [r["count"] for r in rows]
        n = len(rows)
        width = (rows[-1]["hi"] - rows[0]["lo"]) / n if n else 0.0
        # The centre is taken from neighbouring edges, so a single bin has none.
        centres = [r["lo"] + width / 2 for r in rows] if n > 1 else [None] * n
        width = width if n > 1 and width else 1.0
        total = sum(counts)
        share = (lambda c: c / total) if total else (lambda c: math.nan)
        norm = {"count": lambda c: c, "percent": lambda c: share(c) * 100, "probability": share, "density": lambda c: c / width, "probability density": lambda c: share(c) / width}[self.params["histnorm"]]
        temporal = is_temporal(self.kind)
        scale = epoch_ms_factor(self.kind) if temporal else 1.0
        along = [from_physical(c, self.kind) for c in centres] if temporal else centres
        a, b = f"{self.role}0", f"{self.role}1"
        bounds = [{a: None, b: None} if c is None else {a: (c - width / 2) * scale, b: (c + width / 2) * scale} for c in centres]
        values = [norm(c) for c in counts]
        if self.role == "x":
            return {"x": along, "y": values, "hover_bounds": bounds}
        return {"x": values, "y": along, "orientation": "h", "hover_bounds": bounds}

    def shape(self, rows):
        if not self.by:
            return self._payload(rows)
        return [Group(g, self._payload(part)) for g, part in self._split(rows, self.by)]

    def cube_source(self, axis_range, schema):
        return self._range_source(self.column, axis_range, schema)

    def cube_target(self, axis_range, schema):
        if self.by and not cubes.dims_allowed(schema, self.by):
            return None
        return cubes.CubeTarget((cubes.TargetDim(self.column, "binned", self.params["bins"], axis_range), *(cubes.TargetDim(c, "categorical") for c in self.by)))


class BoxPlot(Trace):
    trace_type = "box"
    filtered_only = True

    def __init__(self, x=None, y=None, name=None, color=None, color_map=None, axes=("x", "y"), group_by=None):
        if (x is None) == (y is None):
            raise ValueError("give x or y, not both")
        self.role = "x" if x is not None else "y"
        self.select_roles = ("xy".index(self.role),)
        by = column_tuple(group_by, "group_by") if group_by is not None else None
        self.column = x if x is not None else y
        super().__init__({self.role: self.column}, _given(group_by=list(by) if by else None), {"name": name or self.column, **_given(color=color, color_map=color_map)}, axes)

    def job(self, source, update_range, siblings=()):
        def make(df):
            out = grouping.box(df, self.column, self.by)
            return out.orderBy(*self.by) if self.by else out

        return TableJob(self.uid, make)

    def _payload(self, row, label):
        keys = {"lowerfence": "lower", "q1": "q1", "median": "q2", "q3": "q3", "upperfence": "upper"}
        if row is None:
            return {k: [] for k in keys}
        way = {"orientation": "h", "y0": label} if self.role == "x" else {"orientation": "v", "x0": label}
        return {**{k: [row[v]] for k, v in keys.items()}, **way}

    def shape(self, rows):
        if not self.by:
            return self._payload(rows[0] if rows else None, self.display["name"])
        return [Group(g, self._payload(part[0], group_key(g))) for g, part in self._split(rows, self.by)]

    def cube_source(self, axis_range, schema):
        return self._range_source(self.column, axis_range, schema)


def _reduction(values: str | None, agg: str) -> str:
    _checked(agg, (*AGGS, "count"), "agg")
    if values is None:
        return "count"
    if agg == "count":
        raise ValueError("count takes no values; leave values out")
    return agg


def reduced(func: str, values: str | None) -> str:
    return "count" if values is None else f"{func} of {values}"


def _old_names(spec: TraceSpec) -> dict[str, Any]:
    """Arguments of specs whose bars still named their roles x and y."""
    a = Trace.arguments(spec)
    if "labels" not in a and "x" in a:
        a["labels"], a["values"] = a.pop("x"), a.pop("y", None)
    if a.get("agg") == "count":
        a.update(agg="sum", values=None)
    return a


class BarPlot(Trace):
    trace_type = "bar"

    def __init__(self, labels, values=None, agg="sum", name=None, color=None, orientation="v", bar_mode="group", group_by=None, color_map=None, axes=("x", "y")):
        _checked(orientation, ("v", "h"), "orientation")
        _checked(bar_mode, ("group", "stack"), "bar_mode")
        self.labels = column_tuple(labels, "labels")
        by = column_tuple(group_by, "group_by") if group_by is not None else None
        if by and set(by) & set(self.labels):
            raise ValueError("a column is either a label or a group")
        self.func = _reduction(values, agg)
        super().__init__({"labels": list(self.labels), **_given(values=values)}, {"agg": self.func, "orientation": orientation, **_given(group_by=list(by) if by else None)}, {"name": name or values or composite_label(self.labels), "bar_mode": bar_mode, **_given(color=color, color_map=color_map)}, axes)
        self.filtered_only = by is not None

    arguments = classmethod(lambda cls, spec: _old_names(spec))
    #: A box drag names a new set of labels each time; clicks on slices add up.
    multi = "replace"

    def on_axes(self):
        names = (composite_label(self.labels), reduced(self.func, self.backend_data.get("values")))
        return dict(zip("yx" if self.params["orientation"] == "h" else "xy", names))

    def selection(self):
        return TraceSelectionSpec(kind="categorical", label_columns=list(self.labels), multi=self.multi)

    def job(self, source, update_range, siblings=()):
        return ReduceJob(self.uid, (*self.by, *self.labels), self.func, self.backend_data.get("values"))

    def _payload(self, rows):
        names = [r[self.labels[0]] if len(self.labels) == 1 else group_key([r[c] for c in self.labels]) for r in rows]
        values = [r["value"] for r in rows]
        return ({"x": values, "y": names, "orientation": "h"} if self.params["orientation"] == "h" else {"x": names, "y": values}), names

    def shape(self, rows):
        if self.by:
            return [Group(g, self._payload(part)[0]) for g, part in self._split(rows, self.by)]
        out, names = self._payload(rows)
        if self.display.get("color_map") is not None:
            out["marker"] = {"color": [self.display["color_map"].get(str(n)) for n in names]}
        return out

    def cube_source(self, axis_range, schema):
        if not cubes.dims_allowed(schema, self.labels, numeric=True):
            return None
        return cubes.FreeAxis(self.labels[0], "categorical", 0, columns=self.labels)

    def cube_target(self, axis_range, schema):
        measure = cubes.measure_for(schema, self.func, self.backend_data.get("values"))
        if measure is None or not cubes.dims_allowed(schema, self.labels, numeric=True) or not cubes.dims_allowed(schema, self.by):
            return None
        return cubes.CubeTarget(tuple(cubes.TargetDim(c, "categorical") for c in (*self.labels, *self.by)), measure)


class PiePlot(Trace):
    trace_type = "pie"
    filtered_only = True
    multi = "or"

    def __init__(self, labels, values=None, agg="sum", name=None, hole=0.0, color_map=None, axes=None):
        self.labels = column_tuple(labels, "labels")
        self.func = _reduction(values, agg)
        super().__init__({"labels": list(self.labels), **_given(values=values)}, {"agg": self.func, "hole": hole}, {"name": name or values or composite_label(self.labels), **_given(color_map=color_map)}, None)

    arguments = classmethod(lambda cls, spec: _old_names(spec))
    selection = BarPlot.selection

    def headline(self):
        values = self.backend_data.get("values")
        return reduced(self.func, values) if values is not None else f"count of {composite_label(self.labels)}"

    cube_source = BarPlot.cube_source
    cube_target = BarPlot.cube_target

    def job(self, source, update_range, siblings=()):
        return ReduceJob(self.uid, self.labels, self.func, self.backend_data.get("values"))

    def shape(self, rows):
        names = [r[self.labels[0]] if len(self.labels) == 1 else group_key([r[c] for c in self.labels]) for r in rows]
        out = {"labels": names, "values": [r["value"] for r in rows]}
        if self.display.get("color_map") is not None:
            out["marker"] = {"colors": [self.display["color_map"].get(str(n)) for n in names]}
        return out


class TreeMap(Trace):
    trace_type = "treemap"
    filtered_only = True

    def __init__(self, path, values=None, agg="sum", name=None, color_map=None, axes=None):
        self.path = column_tuple(list(path), "path")
        if len(set(self.path)) != len(self.path):
            raise ValueError("a path names each column once")
        self.func = _reduction(values, agg)
        super().__init__(_given(values=values), {"path": list(self.path), "agg": self.func}, {"name": name or "treemap", **_given(color_map=color_map)}, None)

    arguments = classmethod(lambda cls, spec: _old_names(spec))

    def selection(self):
        return TraceSelectionSpec(kind="path", path_columns=list(self.path), multi="path")

    def job(self, source, update_range, siblings=()):
        return TableJob(self.uid, lambda df: grouping.treemap(df, self.path, self.func, self.backend_data.get("values")).orderBy("level", *self.path))

    def shape(self, rows):
        out: dict[str, list] = {"labels": [], "parents": [], "ids": [], "values": []}
        for r in rows or [{"level": 0, "value": 0}]:
            parts = [str(r[c]) for c in self.path[: r["level"]]]
            steps = ["root", *(quote(p, safe="") for p in parts)]
            out["ids"].append("/".join(steps))
            out["parents"].append("/".join(steps[:-1]))
            out["labels"].append(parts[-1] if parts else "")
            out["values"].append(r["value"])
        if self.display.get("color_map") is not None:
            out["marker"] = {"colors": [self.display["color_map"].get(str(n)) for n in out["labels"]]}
        return out

    def cube_source(self, axis_range, schema):
        return cubes.FreeAxis(self.path[0], "categorical", 0, columns=self.path) if cubes.dims_allowed(schema, self.path) else None

    def cube_target(self, axis_range, schema):
        measure = cubes.measure_for(schema, self.func, self.backend_data.get("values"))
        if measure is None or not cubes.dims_allowed(schema, self.path):
            return None
        return cubes.CubeTarget(tuple(cubes.TargetDim(c, "categorical") for c in self.path), measure)


class LinePlot(Trace):
    trace_type = "line"
    recompute_roles = select_roles = (0,)
    hover = (("axis",), ("axis",))

    def __init__(self, x, y, name=None, color=None, color_map=None, n_points=1000, downsample="minmax", add_gaps=True, axes=("x", "y"), update_on_zoom=True, group_by=None):
        _checked(downsample, DOWNSAMPLES, "downsample")
        by = column_tuple(group_by, "group_by") if group_by is not None else None
        super().__init__({"x": x, "y": y}, {"n_points": n_points, "downsample": downsample, "add_gaps": add_gaps, **_given(group_by=list(by) if by else None)}, {"name": name or y, **_given(color=color, color_map=color_map)}, axes)
        if not update_on_zoom:
            self.recompute_axes = ()

    def job(self, source, update_range, siblings=()):
        x, y, n = self.backend_data["x"], self.backend_data["y"], self.params["n_points"]
        view = update_range.get(self.axes[0])
        order = source.order_for(x)

        def make(df):
            if view is not None:
                df = df.where(in_range(x, tuple(view), kind_of(df.schema, x)))
            if self.params["downsample"] == "nth":
                picked = downsample.every_nth(df.select(*dict.fromkeys([*self.by, x, y, *order])), order, n, self.by)
                out = picked.select(*self.by, "ri", F.col(x).alias("__x"), F.col(y).alias("__y"))
            else:
                picked = (downsample.min_max if self.params["downsample"] == "minmax" else downsample.fpcs)(df, x, y, order, n, self.by)
                out = picked.select(*self.by, "ri", F.col("x").alias("__x"), F.col("y").alias("__y"))
            return out.orderBy(*self.by, "ri")

        return TableJob(self.uid, make)

    def shape(self, rows):
        points = lambda part: {"x": [r["__x"] for r in part], "y": [r["__y"] for r in part]}
        return [Group(g, points(part)) for g, part in self._split(rows, self.by)] if self.by else points(rows)

    def cube_source(self, axis_range, schema):
        return self._range_source(self.backend_data["x"], axis_range, schema)

    def cube_target(self, axis_range, schema):
        if self.params["downsample"] != "minmax" or not is_numeric(kind_of(schema, self.backend_data["y"])) or (self.by and not cubes.dims_allowed(schema, self.by)):
            return None
        bucket = cubes.TargetDim(self.backend_data["x"], "binned", max(1, self.params["n_points"] // 2), axis_range)
        return cubes.CubeTarget((bucket, *(cubes.TargetDim(c, "categorical") for c in self.by)), cubes.Measure("line_env", self.backend_data["y"]))


def normalised_cells(values: list[float | None], norm: str | None, area: float) -> list[float | None]:
    """Shares or densities of the cells that hold something."""
    if norm is None:
        return values
    _checked(norm, NORMS_2D, "histnorm")
    total = sum(v for v in values if v is not None)
    part = {"percent": lambda v: v / total * 100, "probability": lambda v: v / total, "density": lambda v: v / area, "probability density": lambda v: v / (total * area)}[norm]
    return [None if v is None else (part(v) if norm == "density" or total else math.nan) for v in values]


def _cells(rows: list[dict], count: bool) -> dict[tuple[int, int], float | None]:
    return {(r["xb"], r["yb"]): None if r["value"] is None or (count and r["value"] == 0) else float(r["value"]) for r in rows}


def _old_reducer(spec: TraceSpec) -> dict[str, Any]:
    """Arguments of specs that still named the count of a grid without values."""
    a = Trace.arguments(spec)
    if a.get("histfunc") == "count":
        a.update(histfunc=None, z=None)
    return a


def _of_cells(trace: Trace) -> str:
    """What the cells of a grid hold, and how they are normalised."""
    z, norm = trace.backend_data.get("z"), trace.params["histnorm"]
    if z is None:
        return norm or "count"
    return reduced(trace.params["histfunc"], z) + f" ({norm})" * (norm is not None)


class Histogram2D(Trace):
    trace_type = "histogram2d"
    headline = _of_cells
    filtered_only = True
    recompute_roles = select_roles = (0, 1)
    hover = (("cell",), ("cell", "axis"))

    def __init__(self, x, y, x_bins=20, y_bins=20, z=None, histfunc=None, histnorm=None, name=None, color_scale=None, color_range=None, axes=("x", "y")):
        _checked(histnorm, NORMS_2D, "histnorm")
        if (z is None) != (histfunc is None):
            raise ValueError("z and histfunc go together")
        if histfunc is not None:
            _checked(histfunc, histogram.REDUCERS_2D, "histfunc")
        scale, colors = _style(color_scale, color_range, "viridis")
        super().__init__({"x": x, "y": y, **_given(z=z)}, {"x_bins": x_bins, "y_bins": y_bins, "histfunc": histfunc, "histnorm": histnorm}, {"name": name or f"{y} vs {x}", "color_scale": scale, "color_range": colors}, axes)

    arguments = classmethod(lambda cls, spec: _old_reducer(spec))

    def job(self, source, update_range, siblings=()):
        x, y, z = self.backend_data["x"], self.backend_data["y"], self.backend_data.get("z")
        views = [update_range.get(a) for a in self.axes]
        zoomed = None not in views
        self.kinds = [kind_of(source.schema, c) for c in (x, y)]
        bounds = [axis_bounds(source, c, v if zoomed else None) for c, v in zip((x, y), views)]
        self.bounds = [(0.0 if lo is None else lo, 1.0 if hi is None else hi) for lo, hi in bounds]

        def make(df):
            if zoomed:
                for c, v, k in zip((x, y), views, self.kinds):
                    df = df.where(in_range(c, tuple(v), k))
            return histogram.histogram2d(df, x, y, self.params["x_bins"], self.params["y_bins"], *self.bounds, z, self.params["histfunc"] or "count")

        return TableJob(self.uid, make)

    def shape(self, rows):
        nx, ny = self.params["x_bins"], self.params["y_bins"]
        (x0, x1), (y0, y1) = self.bounds
        dx, dy = (x1 - x0) / nx, (y1 - y0) / ny
        cell = _cells(rows, "z" not in self.backend_data)
        flat = normalised_cells([cell[i, j] for j in range(ny) for i in range(nx)], self.params["histnorm"], dx * dy)
        scale = [epoch_ms_factor(k) if is_temporal(k) else 1.0 for k in self.kinds]

        def centres(lo, step, n, kind):
            made = [lo + (i + 0.5) * step for i in range(n)]
            return [from_physical(c, kind) for c in made] if is_temporal(kind) else made

        edge = lambda i, j: {"x0": (x0 + i * dx) * scale[0], "x1": (x0 + (i + 1) * dx) * scale[0], "y0": (y0 + j * dy) * scale[1], "y1": (y0 + (j + 1) * dy) * scale[1]}
        return {"x": centres(x0, dx, nx, self.kinds[0]), "y": centres(y0, dy, ny, self.kinds[1]), "z": [flat[j * nx : (j + 1) * nx] for j in range(ny)], "hover_bounds": [[edge(i, j) for i in range(nx)] for j in range(ny)]}

    def cube_source(self, axis_range, schema):
        x, y = self.backend_data["x"], self.backend_data["y"]
        kinds = [kind_of(schema, c) for c in (x, y)]
        if any(not (is_numeric(k) or is_temporal(k)) for k in kinds):
            return None
        units = tuple(map(unit_of, kinds))
        return cubes.FreeAxis(x, "box2d", cubes.BOX_BINS, columns=(x, y), unit=units if any(units) else None)

    def cube_target(self, axis_range, schema):
        if axis_range is not None:
            return None
        measure = cubes.measure_for(schema, self.params["histfunc"] or "count", self.backend_data.get("z"))
        if measure is None:
            return None
        dims = tuple(cubes.TargetDim(self.backend_data[r], "binned", self.params[f"{r}_bins"], bin_variant="hist2d") for r in "xy")
        return cubes.CubeTarget(dims, measure)


def _style(scale: Any, colors: Any, default: str, span: Any = "auto") -> tuple[str, Any]:
    return checked_scale(scale, default), checked_range(colors, span)


def corner_box(corners: Any) -> tuple[tuple[float, float], tuple[float, float]] | None:
    """(lat range, lon range) of a map view given by its [lon, lat] corners."""
    if not corners:
        return None
    lons, lats = [c[0] for c in corners], [c[1] for c in corners]
    return (min(lats), max(lats)), (min(lons), max(lons))


class GeoTrace(Trace):
    def default_recompute_axes(self):
        return ("coordinates",)

    def _in_view(self, df, view):
        if view is None:
            return df
        for role, r in zip(("lat", "lon"), view):
            df = df.where(in_range(self.backend_data[role], r, kind_of(df.schema, self.backend_data[role])))
        return df


class GeoHistogram2D(GeoTrace):
    trace_type = "geo_histogram2d"
    headline = _of_cells
    filtered_only = True
    hover = (("cell",), ("cell",))

    def __init__(self, lat, lon, lat_bins=64, lon_bins=64, z=None, histfunc=None, histnorm=None, name=None, color_scale=None, color_range=None, bin_boundaries="data", axes=None):
        _checked(histnorm, NORMS_2D, "histnorm")
        _checked(bin_boundaries, ("data", "viewport"), "bin_boundaries")
        if (z is None) != (histfunc is None):
            raise ValueError("z and histfunc go together")
        if histfunc is not None:
            _checked(histfunc, histogram.REDUCERS_2D, "histfunc")
        scale, colors = _style(color_scale, color_range, "viridis")
        super().__init__({"lat": lat, "lon": lon, **_given(z=z)}, {"lat_bins": lat_bins, "lon_bins": lon_bins, "histfunc": histfunc, "histnorm": histnorm, "bin_boundaries": bin_boundaries}, {"name": name or f"geo {lat} x {lon}", "color_scale": scale, "color_range": colors}, None)

    arguments = classmethod(lambda cls, spec: _old_reducer(spec))

    def selection(self):
        return TraceSelectionSpec(kind="geo_box", lon_column=self.backend_data["lon"], lat_column=self.backend_data["lat"])

    def job(self, source, update_range, siblings=()):
        view = corner_box(update_range.get("coordinates"))
        lat, lon = self.backend_data["lat"], self.backend_data["lon"]

        def make(df):
            df = self._in_view(df, view)
            bounds = view if view and self.params["bin_boundaries"] == "viewport" else None
            if bounds is None:
                # The bins follow the rows in view, so this one aggregation comes first; its single row is collected.
                bounds = [(0.0 if lo is None else lo, 1.0 if hi is None else hi) for lo, hi in (histogram.domain(df, lat), histogram.domain(df, lon))]
            self.bounds = [tuple(map(float, b)) for b in bounds]
            return histogram.histogram2d(df, lat, lon, self.params["lat_bins"], self.params["lon_bins"], *self.bounds, self.backend_data.get("z"), self.params["histfunc"] or "count")

        return TableJob(self.uid, make)

    def shape(self, rows):
        n_lat, n_lon = self.params["lat_bins"], self.params["lon_bins"]
        (lat0, lat1), (lon0, lon1) = self.bounds
        d_lat, d_lon = (lat1 - lat0) / n_lat, (lon1 - lon0) / n_lon
        cell = _cells(rows, "z" not in self.backend_data)
        order = [(i, j) for j in range(n_lon) for i in range(n_lat)]
        values = dict(zip(order, normalised_cells([cell[k] for k in order], self.params["histnorm"], d_lat * d_lon)))
        kept = [k for k in order if values[k] is not None]
        return {"geojson": {"type": "FeatureCollection", "features": [self._rectangle(*k, lat0, d_lat, lon0, d_lon) for k in kept]}, "locations": [f"r{i}_c{j}" for i, j in kept], "z": [values[k] for k in kept]}

    @staticmethod
    def _rectangle(i, j, lat0, d_lat, lon0, d_lon):
        south, north, west, east = lat0 + i * d_lat, lat0 + (i + 1) * d_lat, lon0 + j * d_lon, lon0 + (j + 1) * d_lon
        ring = [[west, south], [east, south], [east, north], [west, north], [west, south]]
        return {"type": "Feature", "id": f"r{i}_c{j}", "geometry": {"type": "Polygon", "coordinates": [ring]}}


class GeoLine(GeoTrace):
    trace_type = "geo_line"

    def __init__(self, lat, lon, n_points=1000, name=None, color=None, add_gaps=True, update_on_zoom=True, axes=None):
        super().__init__({"lat": lat, "lon": lon}, {"n_points": n_points, "add_gaps": add_gaps}, {"name": name or f"{lat}/{lon}", **_given(color=color)}, None)
        if not update_on_zoom:
            self.recompute_axes = ()

    def job(self, source, update_range, siblings=()):
        view = corner_box(update_range.get("coordinates"))
        lat, lon = self.backend_data["lat"], self.backend_data["lon"]
        order = source.order_by or [lat, lon]

        def make(df):
            picked = downsample.every_nth(self._in_view(df, view).select(*dict.fromkeys([lat, lon, *order])), order, self.params["n_points"])
            return picked.select("ri", F.col(lat).alias("__lat"), F.col(lon).alias("__lon")).orderBy("ri")

        return TableJob(self.uid, make)

    def shape(self, rows):
        lat, lon = [r["__lat"] for r in rows], [r["__lon"] for r in rows]
        if self.params["add_gaps"]:
            lat, lon = downsample.geo_gaps(lat, lon)
        return {"lat": lat, "lon": lon}


class CorrHeatmap(Trace):
    trace_type = "corr_heatmap"
    filtered_only = True

    def __init__(self, columns=None, method="pearson", triangular=False, absolute=False, name=None, color_scale=None, color_range=None, axes=("x", "y")):
        _checked(method, correlation.METHODS, "method")
        scale, colors = _style(color_scale, color_range, *(("viridis", (0.0, 1.0)) if absolute else ("rdbu", (-1.0, 1.0))))
        super().__init__({}, {"columns": list(columns) if columns is not None else None, "method": method, "triangular": triangular, "absolute": absolute}, {"name": name or "Correlation", "color_scale": scale, "color_range": colors}, axes)

    def job(self, source, update_range, siblings=()):
        self.columns = self.params["columns"] or [f.name for f in source.schema.fields if is_numeric(f.dataType)]
        if len(self.columns) < 2:
            raise ValueError(f"a correlation needs at least two numeric columns, not {self.columns!r}")
        return TableJob(self.uid, lambda df: correlation.correlations(df, self.columns, self.params["method"], self.params["absolute"]))

    def shape(self, rows):
        z = correlation.matrix(self.columns, {(r["a"], r["b"]): r["r"] for r in rows}, self.params["triangular"])
        return {"x": list(self.columns), "y": self.columns[::-1], "z": z[::-1]}

    def cube_target(self, axis_range, schema):
        columns = self.params["columns"]
        if self.params["method"] != "pearson" or not columns or len(columns) < 2:
            return None
        if any(c in cubes.RESERVED or not is_numeric(kind_of(schema, c)) for c in columns):
            return None
        return cubes.CubeTarget((), cubes.Measure("corr", columns=tuple(columns)))


TRACES = {c.trace_type: c for c in (Histogram, BoxPlot, BarPlot, PiePlot, TreeMap, LinePlot, Histogram2D, GeoHistogram2D, GeoLine, CorrHeatmap)}


def from_spec(spec: TraceSpec) -> Trace:
    if spec.trace_type not in TRACES:
        raise ValueError(f"no trace type {spec.trace_type!r}; there are {sorted(TRACES)}")
    return TRACES[spec.trace_type].from_spec(spec)
