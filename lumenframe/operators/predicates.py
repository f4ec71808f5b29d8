"""The predicate algebra: clauses (one column test), predicates (AND of clauses), selections (OR of predicates).

Plain dicts or spec objects are taken alike; everything compiles to Columns that
Catalyst pushes to the scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typing import FLOATS, INTEGERS, _as_column_time, in_range, is_temporal, kind_of, literal


def _get(x: Any, name: str, default: Any = None) -> Any:
    return x.get(name, default) if isinstance(x, dict) else getattr(x, name, default)


def members(values: Iterable[Any], kind: T.DataType | None) -> list[Any]:
    """The values a column of this type can hold; booleans come as 'true' and 'false'."""
    values = list(values)
    if isinstance(kind, T.BooleanType):
        wrong = [v for v in values if v not in ("true", "false") or isinstance(v, bool)]
        if wrong:
            raise ValueError(f"a boolean column is selected by 'true' or 'false', not {wrong[0]!r}")
        return [v == "true" for v in values]
    out = []
    for v in values:
        if v is None or kind is None:
            out.append(v)
        elif is_temporal(kind):
            out.append(v if _as_column_time(v, kind) is not None else None)
        elif isinstance(kind, (*INTEGERS, *FLOATS, T.DecimalType)):
            try:
                x = float(v)
            except (TypeError, ValueError):
                continue
            out.append(int(v) if isinstance(kind, INTEGERS) and not isinstance(v, float) and not isinstance(v, str) else int(x) if isinstance(kind, INTEGERS) and x == x and abs(x) != float("inf") else x)
        else:
            out.append(v if isinstance(v, str) else str(v))
    return [v for v in out if v is not None]


def clause(c: Any, schema: T.StructType | None) -> Column:
    column = _get(c, "column")
    kind = kind_of(schema, column)
    if schema is not None and kind is None:
        raise ValueError(f"there is no column {column!r}")
    values = _get(c, "values")
    if values is not None:
        found = members(values, kind)
        if not found:
            return F.lit(False)
        if is_temporal(kind):
            return F.col(column).isin([literal(v, kind) for v in found])
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType)):
            return F.col(column).isin([F.lit(v).try_cast(kind) for v in found])
        return F.col(column).isin(found)
    return in_range(column, tuple(_get(c, "range")), kind, _get(c, "closed", "both") or "both")


def predicate(p: Any, schema: T.StructType | None) -> Column:
    """AND of the clauses; no clauses are true."""
    return reduce(lambda a, b: a & b, [clause(c, schema) for c in _get(p, "clauses", [])], F.lit(True)) if _get(p, "clauses") else F.lit(True)


def selection(predicates: list[Any], schema: T.StructType | None) -> Column:
    """OR of the predicates; no predicates are true."""
    return reduce(lambda a, b: a | b, [predicate(p, schema) for p in predicates]) if predicates else F.lit(True)


def _canonical_clause(c: Any) -> dict:
    values = _get(c, "values")
    if values is not None:
        return {"c": _get(c, "column"), "v": sorted(values, key=str)}
    return {"c": _get(c, "column"), "r": list(_get(c, "range")), "cl": _get(c, "closed", "both")}


def passive_key(selections: list[Any], active_figure: str | None) -> str | None:
    """One text for all that other figures have selected; equal sets give equal texts, nesting is kept, uids are not."""

    def compact(x: Any) -> str:
        return json.dumps(x, separators=(",", ":"), default=str)

    def one(p: Any) -> str:
        order = sorted(_get(p, "clauses", []), key=lambda c: (_get(c, "column"), "r" if _get(c, "values") is None else "v"))
        return compact([_canonical_clause(c) for c in order])

    others = [s for s in selections if _get(s, "source_figure_uid") not in (None, active_figure) and _get(s, "predicates")]
    return compact(sorted(compact(sorted(one(p) for p in _get(s, "predicates"))) for s in others)) if others else None
