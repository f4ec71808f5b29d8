"""Gestures on traces as predicates, and how successive ones add up."""

from __future__ import annotations

import json
from typing import Any
from urllib.parse import unquote

from .spec import ClauseFilter, SelectionPredicate, TraceSelectionSpec


def _label_clauses(label: Any, columns: list[str]) -> list[ClauseFilter]:
    parts = [label] if len(columns) == 1 else json.loads(label) if isinstance(label, str) else list(label)
    if len(parts) != len(columns):
        raise ValueError(f"{label!r} does not name {len(columns)} columns")
    return [ClauseFilter(c, values=[v]) for c, v in zip(columns, parts)]


def from_labels(spec: TraceSelectionSpec, labels: list[Any]) -> list[SelectionPredicate]:
    """One predicate for each clicked or boxed category."""
    return [SelectionPredicate(_label_clauses(v, spec.label_columns)) for v in labels]


def from_path(spec: TraceSelectionSpec, node: str) -> SelectionPredicate | None:
    """The clauses of a hierarchy node, root to leaf; None for the root."""
    parts = [unquote(p) for p in node.split(spec.path_separator)]
    parts = parts[1:] if parts and parts[0] == "root" else parts
    if not parts:
        return None
    return SelectionPredicate([ClauseFilter(c, values=[v]) for c, v in zip(spec.path_columns, parts)])


def from_geo(spec: TraceSelectionSpec, corners: list[tuple[float, float]]) -> SelectionPredicate:
    """The bounding box of [lon, lat] points."""
    lons, lats = [p[0] for p in corners], [p[1] for p in corners]
    return SelectionPredicate([ClauseFilter(spec.lon_column, range=(min(lons), max(lons))), ClauseFilter(spec.lat_column, range=(min(lats), max(lats)))])


def from_ranges(specs: list[TraceSelectionSpec], ranges: dict[str, tuple]) -> list[SelectionPredicate]:
    """One predicate for each trace's columns under a box; a predicate whose clauses another one holds too is left out."""
    found: list[dict[str, tuple]] = []
    for s in specs:
        mine = {c: (min(r), max(r)) for a, c in s.axis_columns.items() if (r := ranges.get(a)) is not None}
        if mine and mine not in found:
            found.append(mine)
    widest = [f for f in found if not any(f is not g and f.items() <= g.items() for g in found)]
    return [SelectionPredicate([ClauseFilter(c, range=r) for c, r in f.items()]) for f in widest]


def _values(p: SelectionPredicate) -> tuple:
    return tuple((c.column, tuple(c.values or ()), c.range, c.closed) for c in p.clauses)


def add(existing: list[SelectionPredicate], new: SelectionPredicate, multi: str) -> list[SelectionPredicate]:
    """After a further gesture: replace everything; toggle one of many; or toggle along a hierarchy, where a
    node takes the place of its ancestors and descendants."""
    if multi == "replace":
        return [new]
    mine = _values(new)
    if any(_values(p) == mine for p in existing):
        return [p for p in existing if _values(p) != mine]
    if multi == "path":
        related = lambda v: v[: len(mine)] == mine or mine[: len(v)] == v
        existing = [p for p in existing if not related(_values(p))]
    return [*existing, new]
