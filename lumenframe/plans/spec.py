"""The wire model: dashboards, figures, traces and interaction state as plain dataclasses.

`to_dict` and `from_dict` go to and from JSON; unknown keys are ignored, so specs
of later versions still load.  `encode` and `decode` pack a spec into a URL.
"""

from __future__ import annotations

import base64
import dataclasses
import gzip
import json
import math
import types
import typing
from dataclasses import dataclass, field
from typing import Any
from uuid import uuid4

VERSION = "0.4"
EVENTS = ("init", "viewport", "selection", "deselect", "reset", "cube_request")
MODES = ("update", "overlay")


def to_dict(x: Any) -> Any:
    if dataclasses.is_dataclass(x):
        return {f.name: to_dict(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, dict):
        return {k: to_dict(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [to_dict(v) for v in x]
    return x


def from_dict(cls: type, data: Any) -> Any:
    """An instance of a spec class from JSON data; nested specs, lists, tuples and maps follow the annotations."""
    if dataclasses.is_dataclass(data):
        return data
    hints = typing.get_type_hints(cls)
    return cls(**{f.name: _convert(hints[f.name], data[f.name]) for f in dataclasses.fields(cls) if f.name in data})


def _convert(kind: Any, value: Any) -> Any:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if value is None:
        return None
    if origin in (typing.Union, types.UnionType):
        options = [a for a in args if a is not type(None)]
        for a in options:
            if dataclasses.is_dataclass(a) and isinstance(value, dict):
                return from_dict(a, value)
        return _convert(options[0], value) if len(options) == 1 else value
    if dataclasses.is_dataclass(kind):
        return from_dict(kind, value)
    if origin is list:
        return [_convert(args[0], v) for v in value]
    if origin is dict:
        return {k: _convert(args[1], v) for k, v in value.items()}
    if origin is tuple:
        return tuple(value)
    return value


def _one_of(value: Any, options: tuple, what: str) -> None:
    if value not in options:
        raise ValueError(f"{what} must be one of {options}, not {value!r}")


@dataclass
class AxisRange:
    min: float | str
    max: float | str

    def as_tuple(self) -> tuple:
        return (self.min, self.max)


@dataclass
class ClauseFilter:
    """One column test: a range (closed at both ends, or half-open with closed="left") or a list of values."""

    column: str
    range: tuple[Any, ...] | None = None
    values: list[Any] | None = None
    closed: str = "both"

    def __post_init__(self) -> None:
        if (self.range is None) == (self.values is None):
            raise ValueError("a clause has either a range or values")
        _one_of(self.closed, ("both", "left"), "closed")
        if self.values is not None and self.closed != "both":
            raise ValueError("only a range can be half-open")
        if self.range is not None:
            if len(self.range) != 2:
                raise ValueError("a range has two ends")
            self.range = tuple(self.range)


@dataclass
class SelectionPredicate:
    clauses: list[ClauseFilter] = field(default_factory=list)


@dataclass
class SelectionState:
    source_figure_uid: str | None = None
    predicates: list[SelectionPredicate] = field(default_factory=list)


@dataclass
class TraceHoverSpec:
    source_modes: list[str] = field(default_factory=list)
    target_modes: list[str] = field(default_factory=list)


@dataclass
class TraceSelectionSpec:
    """How a gesture on a trace becomes clauses."""

    kind: str = "none"
    axis_columns: dict[str, str] = field(default_factory=dict)
    label_columns: list[str] = field(default_factory=list)
    path_columns: list[str] = field(default_factory=list)
    path_separator: str = "/"
    lon_column: str | None = None
    lat_column: str | None = None
    multi: str = "replace"

    def __post_init__(self) -> None:
        _one_of(self.kind, ("range", "categorical", "path", "geo_box", "none"), "selection kind")
        _one_of(self.multi, ("replace", "or", "path"), "multi")


@dataclass
class TraceSpec:
    uid: str
    trace_type: str
    axes: tuple[str, ...] | None = None
    backend_data: dict[str, Any] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    display: dict[str, Any] = field(default_factory=dict)
    recompute_axes: tuple[str, ...] | None = None
    selection: TraceSelectionSpec = field(default_factory=TraceSelectionSpec)
    hover: TraceHoverSpec = field(default_factory=TraceHoverSpec)


@dataclass
class FigureSpec:
    uid: str = field(default_factory=lambda: str(uuid4()))
    source: str | None = None
    layout: dict[str, Any] = field(default_factory=dict)
    traces: list[TraceSpec] = field(default_factory=list)


@dataclass
class GroupDomainState:
    mapping: dict[str, str] = field(default_factory=dict)
    next_color_index: int = 0


@dataclass
class InteractionState:
    viewport: dict[str, Any] = field(default_factory=dict)
    selections: list[SelectionState] = field(default_factory=list)
    group_domains: dict[str, GroupDomainState] = field(default_factory=dict)
    cross_filter_mode: str = "update"

    def __post_init__(self) -> None:
        _one_of(self.cross_filter_mode, MODES, "cross_filter_mode")


@dataclass
class ClientState:
    hover_mode: str = "off"
    live_brush: str = "auto"
    axis_locks: dict[str, bool] = field(default_factory=dict)
    axis_lock_ranges: dict[str, AxisRange] = field(default_factory=dict)


@dataclass
class VisualizationSpec:
    version: str = VERSION
    figure: FigureSpec = field(default_factory=FigureSpec)
    state: InteractionState = field(default_factory=InteractionState)


@dataclass
class GridItem:
    fig_uid: str
    x: int = 0
    y: int = 0
    w: int = 6
    h: int = 5


@dataclass
class ToolbarConfig:
    show_reset: bool = True
    show_deselect: bool = True
    show_cfmode: bool = True
    show_hover: bool = True
    show_lock_all_axes: bool = True
    show_grid: bool = True
    show_share: bool = True
    show_export: bool = True
    show_import: bool = True


@dataclass
class LayoutSpec:
    gap: str = "8px"
    draggable: bool = True
    grid_editable: bool = False
    grid_items: list[GridItem] | None = None
    toolbar: ToolbarConfig = field(default_factory=ToolbarConfig)


@dataclass
class DashboardSpec:
    version: str = VERSION
    figures: list[FigureSpec] = field(default_factory=list)
    state: InteractionState = field(default_factory=InteractionState)
    layout: LayoutSpec = field(default_factory=LayoutSpec)
    client_state: ClientState = field(default_factory=ClientState)


@dataclass
class InteractionEvent:
    """What the user did.  A viewport event names its figure; a selection event lists all selections."""

    type: str
    axis_ranges: dict[str, Any] = field(default_factory=dict)
    selections: list[SelectionState] = field(default_factory=list)
    force_update: bool = False
    figure_uid: str | None = None

    def __post_init__(self) -> None:
        _one_of(self.type, EVENTS, "event type")


@dataclass
class ActiveSource:
    """The brushed figure, trace and column of a cube request."""

    figure_uid: str
    column: str
    trace_uid: str


@dataclass
class GroupedChildDelta:
    uid: str
    updates: dict[str, Any] = field(default_factory=dict)
    parent_uid: str = ""
    group_value_key: str = ""


@dataclass
class TraceDelta:
    uid: str
    updates: dict[str, Any] = field(default_factory=dict)
    group_results: list[GroupedChildDelta] | None = None
    layer: str | None = None


#: Fixed values of the layout grid: columns, default columns of figures, height of a figure in rows.
GRID_COLUMNS, DEFAULT_COLUMNS, FIGURE_ROWS = 12, 2, 5


def grid_items(figures: list[FigureSpec], rows: int | None = None, cols: int | None = None) -> list[GridItem]:
    """Places for figures, row by row, in `cols` columns (or as many as `rows` rows need)."""
    if rows is not None and cols is not None:
        raise ValueError("give rows or cols, not both")
    for n, what in ((rows, "rows"), (cols, "cols")):
        if n is not None and n < 1:
            raise ValueError(f"{what} must be at least 1")
    if not figures:
        return []
    across = cols or (max(1, math.ceil(len(figures) / rows)) if rows else DEFAULT_COLUMNS)
    if across > GRID_COLUMNS:
        raise ValueError(f"at most {GRID_COLUMNS} columns fit")
    # Edges at equal shares, the wider columns first.
    widths = [GRID_COLUMNS // across + (i < GRID_COLUMNS % across) for i in range(across)]
    return [GridItem(f.uid, sum(widths[: i % across]), i // across * FIGURE_ROWS, widths[i % across], FIGURE_ROWS) for i, f in enumerate(figures)]


def encode(spec: VisualizationSpec | DashboardSpec | dict) -> str:
    """JSON, gzip, base64url without padding."""
    if not isinstance(spec, (VisualizationSpec, DashboardSpec, dict)):
        raise TypeError(f"cannot encode {type(spec).__name__}")
    raw = json.dumps(to_dict(spec), separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(gzip.compress(raw, 9, mtime=0)).rstrip(b"=").decode()


def decode(text: str) -> VisualizationSpec | DashboardSpec:
    data = json.loads(gzip.decompress(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))))
    return from_dict(DashboardSpec if "figures" in data else VisualizationSpec, data)
