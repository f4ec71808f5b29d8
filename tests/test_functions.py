"""Bin arithmetic, typed bounds, predicates, labels: against plain Python."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import binning as b
from lumenframe.functions import labels, typing
from lumenframe.operators import predicates as p


def rows(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def evaluated(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_hist_bin_matches_python_at_every_edge(spark):
    lo, hi, n = 0.5, 7.3, 13
    values = [lo + i * (hi - lo) / n for i in range(n + 1)] + [lo - 5, hi + 5, math.inf, -math.inf, 3.3]

    def want(v):
        x = (v - lo) * (n / (hi - lo)) + 1e-9
        return n - 1 if x == math.inf else 0 if x == -math.inf else max(0, min(n - 1, math.floor(x)))

    assert evaluated(rows(spark, values), b.hist_bin(F.col("v"), lo, hi, n)) == [want(v) for v in values]


def test_grid_and_axis_bins_differ_at_the_upper_end(spark):
    values = [0.0, 2.5, 5.0, 10.0]
    df = rows(spark, values)
    assert evaluated(df, b.grid_bin(F.col("v"), 0.0, 10.0, 4)) == [0, 1, 2, 3]
    assert evaluated(df, b.axis_bin(F.col("v"), 0.0, 10.0, 4)) == [0, 1, 2, 4]


def test_degenerate_and_wrong_bounds(spark):
    assert evaluated(rows(spark, [1.0, 9.0]), b.hist_bin(F.col("v"), 5.0, 5.0, 3)) == [0, 0]
    with pytest.raises(ValueError):
        b.hist_bin(F.col("v"), 5.0, 4.0, 3)
    with pytest.raises(ValueError):
        b.axis_bin(F.col("v"), 0.0, 4.0, 0)


@given(st.integers(1, 4000), st.integers(1, 3000))
@settings(max_examples=60, deadline=None)
def test_day_grid_covers_the_span_with_whole_days(span, p):
    width, bins = b.day_grid(0, span, p)
    assert width >= 1 and bins <= p and (bins - 1) * width < span <= bins * width


@pytest.mark.parametrize("lo,hi,closed", [(0.25, 3.5, "both"), (-2.5, 2.5, "both"), (1.2, 3.0, "left"), (1.0, 2.2, "left"), (-1e30, 1e30, "both"), (2, 2, "both"), (3e9, 4e9, "both"), (-1e30, 1e30, "left")])
def test_integer_columns_keep_the_members_of_fractional_ranges(spark, lo, hi, closed):
    values = [-3, -2, -1, 0, 1, 2, 3, 4, 2147483647]
    df = rows(spark, values, "int")
    got = [r[0] for r in df.where(typing.in_range("v", (lo, hi), T.IntegerType(), closed)).collect()]
    assert got == [v for v in values if lo <= v and (v < hi if closed == "left" else v <= hi)]


def test_range_leaves_out_null_and_nan(spark):
    df = rows(spark, [None, math.nan, 1.0, math.inf])
    assert [r[0] for r in df.where(typing.in_range("v", (0.0, math.inf), T.DoubleType())).collect()] == [1.0, math.inf]
    assert [r[0] for r in df.where(typing.in_range("v", (0.0, 5.0), T.DoubleType())).collect()] == [1.0]


@pytest.mark.parametrize("value,want", [("2024-01-02", dt.datetime(2024, 1, 2)), ("2024-01-02T03:04:05.5Z", dt.datetime(2024, 1, 2, 3, 4, 5, 500000)), ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)), (1704164645500, dt.datetime(2024, 1, 2, 3, 4, 5, 500000)), ("2024-01-02T03:04:05+02:00", dt.datetime(2024, 1, 2, 3, 4, 5))])
def test_temporal_literals_of_a_naive_column(spark, value, want):
    assert spark.range(1).select(typing.literal(value, T.TimestampNTZType())).first()[0] == want


def test_temporal_literals_of_dates_and_instants(spark):
    assert spark.range(1).select(typing.literal("2024-01-02T23:00:00", T.DateType())).first()[0] == dt.date(2024, 1, 2)
    assert typing.physical_bound("2024-01-02T03:04:05+02:00", T.TimestampType()) == dt.datetime(2024, 1, 2, 1, 4, 5, tzinfo=dt.timezone.utc).timestamp() * 1e6
    assert spark.range(1).select(typing.literal("no date", T.DateType())).first()[0] is None


def test_range_predicate_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = df.where(p.clause({"column": "l_quantity", "range": (10, 20)}, df.schema)).select("l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity" in plan and "LessThanOrEqual(l_quantity" in plan


def test_predicate_algebra(spark):
    df = spark.createDataFrame([("NL", "a", 1.0), ("BE", "a", 2.0), ("NL", "b", 3.0), (None, "b", 4.0)], "country string, source string, value double")

    def kept(*predicates):
        return [r.value for r in df.where(p.selection(list(predicates), df.schema)).collect()]

    nl, low = {"column": "country", "values": ["NL"]}, {"column": "value", "range": (0, 2)}
    assert kept({"clauses": [nl, low]}) == [1.0]
    assert kept({"clauses": [nl]}, {"clauses": [low]}) == [1.0, 2.0, 3.0]
    assert kept() == [1.0, 2.0, 3.0, 4.0] and kept({"clauses": []}) == [1.0, 2.0, 3.0, 4.0]
    assert kept({"clauses": [{"column": "value", "range": (1.0, 3.0), "closed": "left"}]}) == [1.0, 2.0]
    assert kept({"clauses": [{"column": "value", "values": ["2", "x", 3]}]}) == [2.0, 3.0]
    assert kept({"clauses": [{"column": "country", "values": []}]}) == []
    with pytest.raises(ValueError):
        p.clause({"column": "missing", "values": [1]}, df.schema)


def test_boolean_membership(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r.b for r in df.where(p.clause({"column": "b", "values": ["true"]}, df.schema)).collect()] == [True]
    with pytest.raises(ValueError):
        p.clause({"column": "b", "values": [True]}, df.schema)


def test_passive_key_ignores_order_and_uids():
    a = {"source_figure_uid": "f", "predicates": [{"clauses": [{"column": "x", "values": ["2", "1"]}, {"column": "y", "range": (0, 1), "closed": "both"}]}]}
    c = {"source_figure_uid": "g", "predicates": [{"clauses": [{"column": "y", "range": (0, 1), "closed": "both"}, {"column": "x", "values": ["1", "2"]}]}]}
    assert p.passive_key([a], "z") == p.passive_key([c], "z") is not None
    assert p.passive_key([a], "f") is None and p.passive_key([{**a, "source_figure_uid": None}], "z") is None
    split = {"source_figure_uid": "f", "predicates": [{"clauses": [x]} for x in a["predicates"][0]["clauses"]]}
    assert p.passive_key([split], "z") != p.passive_key([a], "z")


def test_group_names():
    assert labels.group_key("x y") == "x y" and labels.group_key(("a", 1)) == '["a",1]' and labels.group_key(None) == "null"
    assert labels.child_uid("p", "a/b") != labels.child_uid("p", "a_b") and labels.child_uid("p", "é").startswith("fv_p_group_")
    with pytest.raises(ValueError):
        labels.column_tuple([], "labels")
    with pytest.raises(TypeError):
        labels.column_tuple([1], "labels")


def test_naive_times_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-07-01 12:30:00.25' AS t")
    want = (dt.datetime(2024, 7, 1, 12, 30, 0, 250000) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(typing.physical(F.col("t"), T.TimestampNTZType())).first()[0] == want
            assert df.where(typing.in_range("t", ("2024-07-01T12:30:00.2", "2024-07-01T12:30:00.3"), T.TimestampNTZType())).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
