"""Column types, physical values of temporal columns, and literals in the type of the column they meet.

A bound is brought to the column's type, never the column to the bound's, so
comparisons stay bare `column <op> literal` and reach the parquet scan.
"""

from __future__ import annotations

import datetime as dt
import math
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
_LIMITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def kind_of(schema: T.StructType | None, column: str) -> T.DataType | None:
    if schema is None or column not in schema.names:
        return None
    return schema[column].dataType


def is_numeric(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.NumericType)


def is_temporal(kind: T.DataType | None) -> bool:
    return isinstance(kind, TEMPORAL)


def unit_of(kind: T.DataType | None) -> str | None:
    """Physical unit of a temporal type: whole days or microseconds."""
    return "day" if isinstance(kind, T.DateType) else "us" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else None


def _session_zone() -> str:
    session = SparkSession.getActiveSession()
    return session.conf.get("spark.sql.session.timeZone") if session is not None else "UTC"


def physical(column: Column, kind: T.DataType | None) -> Column:
    """The number behind a temporal value (days, microseconds since 1970; of a naive time by its wall clock); others as they are."""
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    if isinstance(kind, T.TimestampNTZType):
        # The cast reads the wall clock in the session's zone; outside UTC that shift is taken back.
        zone, instant = _session_zone(), column.cast("timestamp")
        return F.unix_micros(instant if zone in UTC_NAMES else F.from_utc_timestamp(instant, zone))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    return column


def from_physical(value: float | None, kind: T.DataType) -> Any:
    """A physical number back as a date or datetime, rounded to the unit."""
    if value is None:
        return None
    whole = round(value)
    if isinstance(kind, T.DateType):
        return dt.date(1970, 1, 1) + dt.timedelta(days=whole)
    made = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=whole)
    return made.replace(tzinfo=dt.timezone.utc) if isinstance(kind, T.TimestampType) else made


def epoch_ms_factor(kind: T.DataType) -> float:
    return 86_400_000.0 if isinstance(kind, T.DateType) else 1e-3


def parse_time(value: Any) -> dt.datetime | dt.date | None:
    """Dates, ISO texts (T or space, Z or an offset, fractions), epoch milliseconds, datetimes; None if it is none of them."""
    if isinstance(value, (dt.datetime, dt.date)):
        return value
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=value) if math.isfinite(value) else None
    text = str(value).strip()
    try:
        if len(text) == 10:
            return dt.date.fromisoformat(text)
        return dt.datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
    except ValueError:
        return None


def _as_column_time(value: Any, kind: T.DataType) -> dt.datetime | dt.date | None:
    """In the column's own form: a naive column takes the wall clock, a zoned one the instant, a date the day."""
    got = parse_time(value)
    if got is None:
        return None
    if isinstance(kind, T.DateType):
        if isinstance(got, dt.datetime):
            return got.date()
        return got
    if not isinstance(got, dt.datetime):
        got = dt.datetime.combine(got, dt.time())
    if isinstance(kind, T.TimestampNTZType):
        return got.replace(tzinfo=None)
    return got.astimezone(dt.timezone.utc) if got.tzinfo else got.replace(tzinfo=dt.timezone.utc)


def physical_bound(value: Any, kind: T.DataType) -> float | None:
    got = _as_column_time(value, kind)
    if got is None:
        return None
    if isinstance(kind, T.DateType):
        return float((got - dt.date(1970, 1, 1)).days)
    return float((got.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1))


def literal(value: Any, kind: T.DataType | None) -> Column:
    """A literal in the type of its column; null where it has no such form."""
    if kind is None:
        return F.lit(value)
    if is_temporal(kind):
        got = _as_column_time(value, kind)
        if got is None:
            return F.lit(None).cast(kind)
        if isinstance(kind, T.TimestampType):
            return F.timestamp_micros(F.lit(int((got.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1))))
        if isinstance(kind, T.TimestampNTZType):
            # As text, since a datetime literal would take the driver's zone on the way.
            return F.lit(got.isoformat(sep=" ")).cast(kind)
        return F.lit(got).cast(kind)
    return F.lit(value).try_cast(kind)


def range_bounds(bounds: tuple[Any, Any], kind: T.DataType | None, closed: str = "both") -> tuple[Column, Column] | None:
    """Literals for lo <= column <= hi (closed="both") or lo <= column < hi ("left"); None if no value can match.

    Fractional bounds of integer columns move to the integer that keeps the same
    members: a closed bound inward, an open one outward.  Bounds beyond the
    type's limits move to the limit, or match nothing.
    """
    lo, hi = bounds
    if not isinstance(kind, INTEGERS):
        return literal(lo, kind), literal(hi, kind)
    if isinstance(lo, float) and math.isfinite(lo):
        lo = math.ceil(lo)
    if isinstance(hi, float) and math.isfinite(hi):
        hi = math.floor(hi) if closed == "both" else math.ceil(hi)
    if any(isinstance(v, (int, float)) for v in (lo, hi)):
        top = 2 ** _LIMITS[type(kind)] - 1
        for v in (lo, hi):
            if isinstance(v, float) and math.isnan(v):
                return None
        if isinstance(lo, (int, float)):
            if lo > top:
                return None
            lo = -top - 1 if lo < -top - 1 else lo
        if isinstance(hi, (int, float)):
            if hi < -top - 1:
                return None
            if hi > top:
                # Past the limit an open bound takes the limit itself in too.
                return literal(lo, kind), None
    return literal(lo, kind), literal(hi, kind)


def in_range(column: str, bounds: tuple[Any, Any], kind: T.DataType | None, closed: str = "both") -> Column:
    """The range test of a column; null and NaN never pass."""
    got = range_bounds(bounds, kind, closed)
    c = F.col(column)
    if got is None:
        return F.lit(False)
    lo, hi = got
    test = c >= lo
    if hi is not None:
        test = test & ((c < hi) if closed == "left" else (c <= hi))
    # Spark orders NaN above every number; a finite upper bound already keeps it out.
    if isinstance(kind, FLOATS) and isinstance(bounds[1], (int, float)) and not math.isfinite(bounds[1]):
        test = test & ~F.isnan(c)
    return test
