"""Physical plans: what is read, how often rows are shuffled, and what must never appear."""

import re

import pytest

from lumenframe.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", text))


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n not in ("minmax_domain",)))
def test_no_product_joins(spark, sf, name):
    text = plan(catalogue.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name,shuffles,columns",
    [
        ("hist1d_grouped", 2, {"l_extendedprice", "l_returnflag"}),
        ("hist2d_mean", 2, {"l_quantity", "l_extendedprice", "l_discount"}),
        ("bar_mean", 1, {"l_returnflag", "l_extendedprice"}),
        ("line_envelope2d", 1, {"ts", "value", "user_id"}),
        ("cube_mean", 2, {"l_quantity", "l_returnflag", "l_extendedprice"}),
        ("xfilter_or_and", 1, {"l_returnflag", "l_linestatus", "l_quantity", "l_tax"}),
    ],
)
def test_shuffles_and_columns_read(spark, sf, name, shuffles, columns):
    text = plan(catalogue.QUERIES[name](spark, sf))
    assert exchanges(text) <= shuffles
    read = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", text)[1]))
    assert read == columns


def test_first_aggregation_is_partial(spark, sf):
    text = plan(catalogue.QUERIES["hist1d_grouped"](spark, sf))
    assert "partial_count" in text


def test_viewports_and_filters_reach_the_scan(spark, sf):
    text = plan(catalogue.QUERIES["hist1d_viewport"](spark, sf))
    assert "GreaterThanOrEqual(l_extendedprice,20000.0)" in text and "LessThanOrEqual(l_extendedprice,60000.0)" in text
    assert "In(c_mktsegment" in plan(catalogue.QUERIES["xfilter_isin"](spark, sf))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plan(catalogue.QUERIES["xfilter_date_string"](spark, sf))
