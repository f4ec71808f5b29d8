"""The registered queries of the analytics engine and the SQL each is compared with.

Doubles are rounded on both sides, since sums depend on the order of addition;
counts, bins and extremes are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlation, downsample, envelope, grouping, histogram, ordering, predicates
from ..sources.registry import Source
from . import cube as cubes
from . import spec, traces
from .brush import Brush
from .engine import Engine, TraceInfo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, source: str, sql: str | None = None):
    """Registers f(df) over one table under `name`, with the SQL that gives the same rows."""

    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: f(table(spark, sf_dir, source))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c).cast("double"), digits).alias(c) if c in columns else F.col(c) for c in df.columns))


# SQL of the three bin arithmetics -----------------------------------------------


def sql_hist(v: str, lo: str, hi: str, n: int) -> str:
    return f"CAST(greatest(0, least(CAST(floor(({v} - {lo}) * ({n} / ({hi} - {lo})) + 1e-9) AS BIGINT), {n - 1})) AS INTEGER)"


def sql_grid(v: str, lo: str, hi: str, n: int) -> str:
    return f"CAST(greatest(0, least(CAST(floor(({v} - {lo}) * ({n} / ({hi} - {lo} + 1e-10)) + 1e-9) AS BIGINT), {n - 1})) AS INTEGER)"


def sql_axis(v: str, lo: str, hi: str, n: int) -> str:
    return f"CAST(floor(({v} - {lo}) / ({hi} - {lo}) * {n}) AS INTEGER)"


# one-dimensional histograms -------------------------------------------------------

N = 20
_HIST = f"""
WITH d AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) + 1e-10 AS hi FROM lineitem),
c AS (SELECT {sql_hist("l_extendedprice", "lo", "hi", N)} AS bin, count(*) AS n FROM lineitem, d GROUP BY 1),
h AS (SELECT CAST(r.range AS INTEGER) AS bin, lo + r.range * ((hi - lo) / {N}) AS lo, lo + (r.range + 1) * ((hi - lo) / {N}) AS hi, (hi - lo) / {N} AS w, coalesce(n, 0) AS count
  FROM range({N}) r CROSS JOIN d LEFT JOIN c ON c.bin = r.range)
"""


def price_histogram(df: DataFrame) -> tuple[DataFrame, float]:
    lo, hi = histogram.padded(histogram.domain(df, "l_extendedprice"))
    return histogram.histogram(df, "l_extendedprice", N, (lo, hi)), (hi - lo) / N


@register("hist1d_count", "lineitem", _HIST + "SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count FROM h")
def hist1d_count(df):
    return rounded(price_histogram(df)[0], "lo", "hi")


def _norm_query(name: str, norm: str, expr: str) -> None:
    @register(name, "lineitem", _HIST + f"SELECT bin, round({expr}, 9) AS value FROM h")
    def run(df):
        binned, width = price_histogram(df)
        return rounded(histogram.normalised(binned, norm, width).select("bin", "value"), "value", digits=9)


_norm_query("hist1d_norm_percent", "percent", "count * 100.0 / sum(count) OVER ()")
_norm_query("hist1d_norm_probability", "probability", "count / CAST(sum(count) OVER () AS DOUBLE)")
_norm_query("hist1d_norm_density", "density", "count / w")
_norm_query("hist1d_norm_probability_density", "probability density", "count / (CAST(sum(count) OVER () AS DOUBLE) * w)")


@register("hist1d_grouped", "lineitem", f"""
WITH d AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) + 1e-10 AS hi FROM lineitem),
c AS (SELECT l_returnflag, {sql_hist("l_extendedprice", "lo", "hi", N)} AS bin, count(*) AS n FROM lineitem, d GROUP BY ALL)
SELECT g.l_returnflag, CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS count
FROM (SELECT DISTINCT l_returnflag FROM lineitem) g CROSS JOIN range({N}) r LEFT JOIN c ON c.bin = r.range AND c.l_returnflag = g.l_returnflag""")
def hist1d_grouped(df):
    bounds = histogram.padded(histogram.domain(df, "l_extendedprice"))
    return histogram.histogram(df, "l_extendedprice", N, bounds, ("l_returnflag",)).select("l_returnflag", "bin", "count")


@register("hist1d_temporal", "orders", f"""
WITH t AS (SELECT CAST(epoch_us(o_orderdate) AS DOUBLE) AS v FROM orders), d AS (SELECT min(v) AS lo, max(v) + 1e-10 AS hi FROM t),
c AS (SELECT {sql_hist("v", "lo", "hi", 24)} AS bin, count(*) AS n FROM t, d GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range(24) r LEFT JOIN c ON c.bin = r.range""")
def hist1d_temporal(df):
    return histogram.histogram(df, "o_orderdate", 24, histogram.padded(histogram.domain(df, "o_orderdate"))).select("bin", "count")


@register("hist1d_viewport", "lineitem", f"""
WITH c AS (SELECT {sql_hist("l_extendedprice", "20000.0", "(60000.0 + 1e-10)", N)} AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 60000 GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range({N}) r LEFT JOIN c ON c.bin = r.range""")
def hist1d_viewport(df):
    view = df.where(predicates.clause({"column": "l_extendedprice", "range": (20000.0, 60000.0)}, df.schema))
    return histogram.histogram(view, "l_extendedprice", N, histogram.padded((20000.0, 60000.0))).select("bin", "count")


@register("hist1d_fused", "lineitem", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS trace, CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range({n}) r LEFT JOIN
(SELECT {sql_hist(c, "lo", "hi", n)} AS bin, count(*) AS n FROM lineitem, (SELECT min({c}) AS lo, max({c}) + 1e-10 AS hi FROM lineitem) d GROUP BY 1) c ON c.bin = r.range"""
    for c, n in (("l_quantity", 10), ("l_extendedprice", 20), ("l_discount", 11), ("l_tax", 9))
))
def hist1d_fused(df):
    bins = {"l_quantity": 10, "l_extendedprice": 20, "l_discount": 11, "l_tax": 9}
    domains = Source("lineitem", df).domains(list(bins))
    wanted = [(c, c, n, histogram.padded(domains[c])) for c, n in bins.items()]
    return histogram.histograms(df, wanted)


# two-dimensional histograms -------------------------------------------------------

_GRID = f"""
WITH d AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem),
c AS (SELECT {sql_grid("l_quantity", "xl", "xh", 16)} AS xb, {sql_grid("l_extendedprice", "yl", "yh", 12)} AS yb, l_discount AS z FROM lineitem, d)
"""


def _grid_query(name: str, func: str, expr: str, empty: str, z: str | None) -> None:
    @register(name, "lineitem", _GRID + f"""
SELECT CAST(x.range AS INTEGER) AS xb, CAST(y.range AS INTEGER) AS yb, round({empty}, 6) AS value FROM range(16) x CROSS JOIN range(12) y
LEFT JOIN (SELECT xb, yb, CAST({expr} AS DOUBLE) AS v FROM c GROUP BY 1, 2) g ON g.xb = x.range AND g.yb = y.range""")
    def run(df):
        xb, yb = histogram.domain(df, "l_quantity"), histogram.domain(df, "l_extendedprice")
        return rounded(histogram.histogram2d(df, "l_quantity", "l_extendedprice", 16, 12, xb, yb, z, func), "value")


_grid_query("hist2d_count", "count", "count(*)", "coalesce(v, 0)", None)
for _f, _e in (("sum", "sum(z)"), ("mean", "avg(z)"), ("min", "min(z)"), ("max", "max(z)"), ("median", "median(z)"), ("n_unique", "count(DISTINCT z)")):
    _grid_query(f"hist2d_{_f}", _f, _e, "v", "l_discount")


@register("geo_hist2d_count", "customer", f"""
WITH d AS (SELECT min(c_nationkey) AS xl, max(c_nationkey) AS xh, min(c_acctbal) AS yl, max(c_acctbal) AS yh FROM customer WHERE c_acctbal BETWEEN 0 AND 5000),
c AS (SELECT {sql_grid("c_nationkey", "xl", "xh", 8)} AS lon_bin, {sql_grid("c_acctbal", "yl", "yh", 8)} AS lat_bin, count(*) AS n FROM customer, d WHERE c_acctbal BETWEEN 0 AND 5000 GROUP BY 1, 2)
SELECT CAST(x.range AS INTEGER) AS lon_bin, CAST(y.range AS INTEGER) AS lat_bin, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM range(8) x CROSS JOIN range(8) y LEFT JOIN c ON c.lon_bin = x.range AND c.lat_bin = y.range""")
def geo_hist2d_count(df):
    """Data bounds: those of the rows that are in view."""
    view = df.where(predicates.clause({"column": "c_acctbal", "range": (0.0, 5000.0)}, df.schema))
    cells = histogram.histogram2d(view, "c_nationkey", "c_acctbal", 8, 8, histogram.domain(view, "c_nationkey"), histogram.domain(view, "c_acctbal"))
    return cells.select(F.col("xb").alias("lon_bin"), F.col("yb").alias("lat_bin"), "value")


@register("geo_hist2d_mean_viewport", "customer", f"""
WITH c AS (SELECT {sql_grid("c_nationkey", "2.0", "20.0", 6)} AS lon_bin, {sql_grid("c_acctbal", "0.0", "6000.0", 6)} AS lat_bin, avg(c_custkey) AS v
  FROM customer WHERE c_acctbal BETWEEN 0 AND 6000 AND c_nationkey BETWEEN 2 AND 20 GROUP BY 1, 2)
SELECT CAST(x.range AS INTEGER) AS lon_bin, CAST(y.range AS INTEGER) AS lat_bin, round(v, 6) AS value FROM range(6) x CROSS JOIN range(6) y LEFT JOIN c ON c.lon_bin = x.range AND c.lat_bin = y.range""")
def geo_hist2d_mean_viewport(df):
    xb, yb = (2.0, 20.0), (0.0, 6000.0)
    cells = histogram.histogram2d(histogram.viewport2d(df, "c_nationkey", "c_acctbal", xb, yb), "c_nationkey", "c_acctbal", 6, 6, xb, yb, "c_custkey", "mean")
    return rounded(cells.select(F.col("xb").alias("lon_bin"), F.col("yb").alias("lat_bin"), "value"), "value")


# bars, pies, treemaps ---------------------------------------------------------------

for _f, _e in (("count", "count(*)"), ("sum", "round(sum(l_extendedprice), 2)"), ("mean", "round(avg(l_extendedprice), 4)"), ("median", "round(median(l_extendedprice), 4)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("n_unique", "count(DISTINCT l_extendedprice)")):

    def _bar(f=_f, digits={"sum": 2, "mean": 4, "median": 4}.get(_f)):
        def run(df):
            out = grouping.aggregate(df, ("l_returnflag",), f, None if f == "count" else "l_extendedprice")
            return rounded(out, "value", digits=digits) if digits else out

        return run

    register(f"bar_{_f}", "lineitem", f"SELECT l_returnflag, {_e} AS value FROM lineitem GROUP BY 1")(_bar())


@register("bar_grouped", "lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2")
def bar_grouped(df):
    return rounded(grouping.aggregate(df, ("l_returnflag", "l_linestatus"), "sum", "l_quantity"), "value", digits=2)


@register("bar_multi_label", "part", "SELECT p_type, p_size, count(*) AS value FROM part GROUP BY 1, 2")
def bar_multi_label(df):
    return grouping.aggregate(df, ("p_type", "p_size"))


@register("pie_share", "customer", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1")
def pie_share(df):
    return rounded(grouping.aggregate(df, ("c_mktsegment",), "sum", "c_acctbal"), "value", digits=2)


for _f, _e, _d in (("sum", "sum", 2), ("mean", "avg", 4)):
    register(f"treemap_{_f}", "lineitem", f"""
WITH leaf AS (SELECT l_returnflag, l_linestatus, {_e}(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
SELECT CAST(2 - (CASE grouping_id(l_returnflag, l_linestatus) WHEN 3 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS INTEGER) AS level, l_returnflag, l_linestatus, round(sum(v), {_d}) AS value
FROM leaf GROUP BY ROLLUP (l_returnflag, l_linestatus)""")(lambda df, f=_f, d=_d: rounded(grouping.treemap(df, ("l_returnflag", "l_linestatus"), f, "l_extendedprice"), "value", digits=d))


# boxes, correlations ------------------------------------------------------------------


def _sql_box(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    q = ", ".join(f"max(CASE WHEN rn = floor((n - 1) * {p} + 0.5) THEN v END) AS q{i}" for i, p in enumerate(("0.0", "0.25", "0.5", "0.75", "1.0")))
    key = f"{by}, " if by else ""
    return f"""
WITH r AS (SELECT {key}l_quantity AS v, row_number() OVER ({part} ORDER BY l_quantity) - 1 AS rn, count(*) OVER ({part}) AS n FROM lineitem),
q AS (SELECT {key}{q} FROM r {"GROUP BY " + by if by else ""})
SELECT {key}q0, q1, q2, q3, q4, greatest(q1 - 1.5 * (q3 - q1), q0) AS lower, least(q3 + 1.5 * (q3 - q1), q4) AS upper FROM q"""


register("box_stats", "lineitem", _sql_box(""))(lambda df: grouping.box(df, "l_quantity"))
register("box_grouped", "lineitem", _sql_box("l_returnflag"))(lambda df: grouping.box(df, "l_quantity", ("l_returnflag",)))

_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]
register("corr_pearson", "lineitem", "\nUNION ALL\n".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem" for a, b in _PAIRS))(lambda df: rounded(correlation.correlations(df, list(_CORR)), "r", digits=9))
register("corr_spearman", "lineitem", "\nUNION ALL\n".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 9) AS r FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM lineitem)"""
    for a, b in _PAIRS
))(lambda df: rounded(correlation.correlations(df, list(_CORR), "spearman"), "r", digits=9))


# downsampling -----------------------------------------------------------------------

_NTH = """SELECT {cols}, ri FROM (SELECT *, row_number() OVER ({part} ORDER BY ts) - 1 AS ri, count(*) OVER ({part}) AS n FROM events {where})
WHERE ri % greatest(1, n // {p}) = 0 AND ri < least(CAST(ceil(n / CAST(greatest(1, n // {p}) AS DOUBLE)) AS BIGINT), {p}) * greatest(1, n // {p})"""


def _sql_minmax(n_points: int, by: str = "", where: str = "") -> str:
    part, key = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""
WITH r AS (SELECT {key}ts, value, row_number() OVER ({part} ORDER BY ts) - 1 AS ri, count(*) OVER ({part}) AS n FROM events {where}),
s AS (SELECT *, least({max(1, n_points // 2)}, n) AS nb FROM r), t AS (SELECT *, n // nb AS base, n % nb AS rem FROM s),
b AS (SELECT *, CASE WHEN ri < rem * (base + 1) THEN ri // (base + 1) ELSE rem + (ri - rem * (base + 1)) // base END AS bucket FROM t),
w AS (SELECT *, row_number() OVER (PARTITION BY {key}bucket ORDER BY value, ri) AS a, row_number() OVER (PARTITION BY {key}bucket ORDER BY value DESC, ri) AS z FROM b)
SELECT {key}ri, ts AS x, value AS y FROM w WHERE a = 1 OR z = 1"""


register("line_nth", "events", _NTH.format(cols="ts, value", part="", where="", p=500))(lambda df: downsample.every_nth(df.select("ts", "value"), ["ts"], 500))
register("line_nth_grouped", "events", _NTH.format(cols="event_type, ts, value", part="PARTITION BY event_type", where="", p=100))(lambda df: downsample.every_nth(df.select("event_type", "ts", "value"), ["ts"], 100, ("event_type",)))
register("line_minmax", "events", _sql_minmax(1000))(lambda df: downsample.min_max(df, "ts", "value", ["ts"], 1000))
register("line_minmax_grouped", "events", _sql_minmax(200, "event_type"))(lambda df: downsample.min_max(df, "ts", "value", ["ts"], 200, ("event_type",)))
def _sql_fpcs(n_points: int, by: str = "") -> str:
    """The fold as a recursion over the buckets: the state is the pending point, how the last bucket ran, and what is kept."""
    part, key = (f"PARTITION BY {by}", f"{by} AS g") if by else ("", "0 AS g")
    out = f"g AS {by}, " if by else ""
    n = n_points - 2
    return f"""
WITH RECURSIVE r AS (SELECT {key}, ts, value AS y, row_number() OVER ({part} ORDER BY ts) - 1 AS ri, count(*) OVER ({part}) AS n FROM events),
whole AS (SELECT g, ri, ts, y FROM r WHERE n <= {n_points} OR n - 2 <= {2 * n}),
inside AS (SELECT *, (n - 2) // {n} AS base, (n - 2) % {n} AS extra FROM r WHERE n > {n_points} AND n - 2 > {2 * n} AND ri > 0 AND ri < n - 1),
run AS (SELECT g, ri, y, 1 + CASE WHEN ri - 1 < extra * (base + 1) THEN (ri - 1) // (base + 1) ELSE extra + (ri - 1 - extra * (base + 1)) // base END AS b FROM inside),
bucket AS (SELECT g, b, arg_min(ri, (y, ri)) AS lo, min(y) AS lo_y, arg_min(ri, (-y, ri)) AS hi, max(y) AS hi_y FROM run GROUP BY 1, 2),
ends AS (SELECT g, max(n) AS n, max(CASE WHEN ri = 0 THEN y END) AS y FROM r WHERE n > {n_points} AND n - 2 > {2 * n} GROUP BY 1),
fold(g, b, p, p_y, rose, kept) AS (
  SELECT g, CAST(0 AS BIGINT), CAST(0 AS BIGINT), y, CAST(NULL AS BOOLEAN), [CAST(0 AS BIGINT)] FROM ends
  UNION ALL
  SELECT g, b, CASE WHEN rises THEN high ELSE low END, CASE WHEN rises THEN high_y ELSE low_y END, rises,
    CASE WHEN k[-1] <> start THEN list_append(k, start) ELSE k END
  FROM (SELECT *, CASE WHEN rose = rises AND start <> p AND kept[-1] <> p THEN list_append(kept, p) ELSE kept END AS k
    FROM (SELECT *, low < high AS rises, least(low, high) AS start
      FROM (SELECT f.g, bucket.b, p, rose, kept, CASE WHEN p_y <= lo_y THEN p ELSE lo END AS low, least(p_y, lo_y) AS low_y, CASE WHEN p_y > hi_y THEN p ELSE hi END AS high, greatest(p_y, hi_y) AS high_y
        FROM fold f JOIN bucket ON bucket.g = f.g AND bucket.b = f.b + 1)))
), last AS (SELECT fold.g, list_distinct(kept || [p, n - 1]) AS kept FROM fold JOIN ends ON ends.g = fold.g WHERE b = {n}),
picked AS (SELECT g, unnest(kept) AS ri FROM last)
SELECT {out}ri, ts AS x, y FROM whole UNION ALL SELECT {"r." + out if by else ""}r.ri, ts AS x, y FROM picked JOIN r ON r.g = picked.g AND r.ri = picked.ri"""


register("line_fpcs", "events", _sql_fpcs(500))(lambda df: downsample.fpcs(df, "ts", "value", ["ts"], 500))
register("line_fpcs_grouped", "events", _sql_fpcs(100, "event_type"))(lambda df: downsample.fpcs(df, "ts", "value", ["ts"], 100, ("event_type",)))
register("geo_line_nth", "events", _NTH.format(cols="lat, lon", part="", where="", p=300).replace("FROM events", "FROM (SELECT *, value AS lat, user_id AS lon FROM events)"))(lambda df: downsample.every_nth(df.select(F.col("value").alias("lat"), F.col("user_id").alias("lon"), "ts"), ["ts"], 300).select("lat", "lon", "ri"))


@register("line_viewport", "events", _sql_minmax(300, "", "WHERE event_id BETWEEN 1000 AND 6000"))
def line_viewport(df):
    return downsample.min_max(df.where(predicates.clause({"column": "event_id", "range": (999.5, 6000.2)}, df.schema)), "ts", "value", ["ts"], 300)


@register("row_index_ranges", "events", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS ri, count(*) OVER (PARTITION BY event_type) AS n_rows FROM events")
def row_index_ranges(df):
    """The scale path of row numbering, by ranges, whatever the size.  Rows without a time come last, as in SQL; of rows with one time, which SQL leaves open, the smaller event_id comes first."""
    rows = df.select("event_type", "event_id", "ts", F.col("ts").isNull().alias("untimed"))
    return ordering.with_position(rows, ["untimed", "ts", "event_id"], ("event_type",), "ranges").select("event_type", "event_id", "ri", "n_rows")


@register("line_envelope2d", "events", f"""
WITH t AS (SELECT CAST(epoch_us(ts) AS DOUBLE) AS x, value AS y, user_id AS f FROM events),
d AS (SELECT min(x) AS xl, max(x) AS xh, CAST(min(f) AS DOUBLE) AS fl, CAST(max(f) AS DOUBLE) AS fh FROM t),
c AS (SELECT {sql_axis("f", "fl", "fh", 8)} AS free_bin, {sql_axis("x", "xl", "xh", 50)} AS bucket, x, y FROM t, d),
w AS (SELECT *, row_number() OVER (PARTITION BY free_bin, bucket ORDER BY y, x) AS a, row_number() OVER (PARTITION BY free_bin, bucket ORDER BY y DESC, x) AS z FROM c)
SELECT free_bin, bucket, min(y) AS y_min, max(CASE WHEN a = 1 THEN x END) AS x_at_ymin, max(y) AS y_max, max(CASE WHEN z = 1 THEN x END) AS x_at_ymax FROM w GROUP BY 1, 2""")
def line_envelope2d(df):
    return envelope.envelope2d(df, "ts", "value", "user_id", histogram.domain(df, "ts"), histogram.domain(df, "user_id"), 50, 8, ["ts"])


# cross-filters ------------------------------------------------------------------------


def _filtered(name: str, source: str, selections: list, where: str, key: str) -> None:
    @register(name, source, f"SELECT {key}, count(*) AS value FROM {source} WHERE {where} GROUP BY 1")
    def run(df):
        for s in selections:
            df = df.where(predicates.selection(s, df.schema))
        return grouping.aggregate(df, (key,))


_filtered("xfilter_range", "lineitem", [[{"clauses": [{"column": "l_quantity", "range": [10, 20.5]}]}]], "l_quantity BETWEEN 10 AND 20.5", "l_returnflag")
_filtered("xfilter_isin", "customer", [[{"clauses": [{"column": "c_mktsegment", "values": ["BUILDING", "MACHINERY"]}]}]], "c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_nationkey")
_filtered("xfilter_or_and", "lineitem", [[{"clauses": [{"column": "l_returnflag", "values": ["A"]}, {"column": "l_quantity", "range": [0, 10]}]}, {"clauses": [{"column": "l_returnflag", "values": ["R"]}]}], [{"clauses": [{"column": "l_tax", "range": [0.02, 0.06]}]}]],
          "((l_returnflag = 'A' AND l_quantity BETWEEN 0 AND 10) OR l_returnflag = 'R') AND l_tax BETWEEN 0.02 AND 0.06", "l_linestatus")
_filtered("xfilter_halfopen", "orders", [[{"clauses": [{"column": "o_orderkey", "range": [100.5, 5000.5], "closed": "left"}]}]], "o_orderkey >= 101 AND o_orderkey < 5001", "o_orderpriority")
_filtered("xfilter_date_string", "orders", [[{"clauses": [{"column": "o_orderdate", "range": ["1996-01-01", "1997-06-30T23:59:59.5Z"]}]}]], "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30 23:59:59.5'", "o_orderstatus")
_filtered("xfilter_epoch_ms", "orders", [[{"clauses": [{"column": "o_orderdate", "range": [820454400000, 852076800000]}]}]], "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'", "o_orderstatus")


@register("overlay_bg_fg", "lineitem", f"""
WITH d AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) + 1e-10 AS hi FROM lineitem),
c AS (SELECT {sql_hist("l_extendedprice", "lo", "hi", N)} AS bin, count(*) AS n, count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 20) AS f FROM lineitem, d GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS count, coalesce(f, 0) AS fg_count FROM range({N}) r LEFT JOIN c ON c.bin = r.range""")
def overlay_bg_fg(df):
    where = predicates.clause({"column": "l_quantity", "range": (10, 20)}, df.schema)
    return histogram.histogram(df, "l_extendedprice", N, histogram.padded(histogram.domain(df, "l_extendedprice")), where=where).select("bin", "count", "fg_count")


@register("minmax_domain", "lineitem", "SELECT min(l_quantity) AS qlo, max(l_quantity) AS qhi, min(l_extendedprice) AS plo, max(l_extendedprice) AS phi FROM lineitem")
def minmax_domain(df):
    q, p = histogram.domain(df, "l_quantity"), histogram.domain(df, "l_extendedprice")
    return df.sparkSession.createDataFrame([(*q, *p)], "qlo double, qhi double, plo double, phi double")


# cubes --------------------------------------------------------------------------------

QUANTITY = cubes.FreeAxis("l_quantity", domain=(1.0, 50.0))


def _brush(lo: float, hi: float) -> str:
    """SQL: the rows of l_quantity in the bins, of 2048 over 1..50, that hold both ends of a brush."""
    return f"floor((l_quantity - 1.0) / 49.0 * 2048) BETWEEN floor(({lo} - 1.0) / 49.0 * 2048) AND floor(({hi} - 1.0) / 49.0 * 2048)"


def _cube_query(name: str, spec: cubes.CubeSpec, source: str, sql: str, cut, digits: int = 4, prepare=lambda df: df) -> None:
    @register(name, source, sql)
    def run(df):
        out = cut(cubes.build(prepare(df), spec))
        return rounded(out, *[c for c in ("value", "r") if c in out.columns], digits=digits)


for _f, _e in (("count", "count(*)"), ("sum", "sum(l_extendedprice)"), ("mean", "avg(l_extendedprice)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)")):
    _cube_query(
        f"cube_{_f}",
        cubes.CubeSpec("lineitem", QUANTITY, (cubes.TargetDim("l_returnflag", "categorical"),), cubes.Measure(_f, None if _f == "count" else "l_extendedprice")),
        "lineitem",
        f"SELECT l_returnflag, round(CAST({_e} AS DOUBLE), 4) AS value FROM lineitem WHERE {_brush(10.3, 30.7)} GROUP BY 1",
        lambda c: c.slice(10.3, 30.7),
    )

_cube_query("cube_categorical", cubes.CubeSpec("lineitem", cubes.FreeAxis("l_returnflag", "categorical", 0, columns=("l_returnflag", "l_linestatus")), (cubes.TargetDim("l_tax", "binned", 9, (0.0, 0.08 + 1e-10)),)), "lineitem",
            f"SELECT {sql_hist('l_tax', '0.0', '(0.08 + 1e-10)', 9)} AS __bin__l_tax, CAST(count(*) AS DOUBLE) AS value FROM lineitem WHERE (l_returnflag = 'A' AND l_linestatus = 'F') OR l_returnflag = 'N' GROUP BY 1",
            lambda c: c.slice_keys([("A", "F"), ("N",)]))

_BOX = cubes.FreeAxis("l_quantity", "box2d", cubes.BOX_BINS, columns=("l_quantity", "l_discount"), domains=((1.0, 50.0), (0.0, 0.1)))
_cube_query("cube_box2d", cubes.CubeSpec("lineitem", _BOX, (cubes.TargetDim("l_linestatus", "categorical"),), cubes.Measure("sum", "l_tax")), "lineitem",
            f"""SELECT l_linestatus, round(sum(l_tax), 4) AS value FROM lineitem WHERE {sql_axis("l_quantity", "1.0", "50.0", 128)} BETWEEN 10 AND 62
AND {sql_axis("l_discount", "0.0", "0.1", 128)} BETWEEN 25 AND 89 GROUP BY 1""",
            lambda c: c.slice_box((5, 25), (0.02, 0.07)))

#: Days since 1970 of 1995-01-01 and 2001-08-01.
_DAYS = (9131.0, 11535.0)
_DAY = cubes.FreeAxis("day", "temporal", cubes.RANGE_BINS, _DAYS, unit="day")
_cube_query("cube_day", cubes.CubeSpec("orders", _DAY, (cubes.TargetDim("o_orderstatus", "categorical"),), cubes.Measure("max", "o_totalprice")), "orders",
            f"""WITH o AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)
SELECT o_orderstatus, max(o_totalprice) AS value FROM o WHERE (d - 9131) // 2 BETWEEN (9500 - 9131) // 2 AND (10000 - 9131) // 2 GROUP BY 1""",
            lambda c: c.slice(9500, 10000), prepare=lambda df: df.withColumn("day", F.col("o_orderdate").cast("date")))
_cube_query("cube_hist_target", cubes.CubeSpec("lineitem", QUANTITY, (cubes.TargetDim("l_extendedprice", "binned", 20, (900.0, 105000.0 + 1e-10)),)), "lineitem",
            f"SELECT {sql_hist('l_extendedprice', '900.0', '(105000.0 + 1e-10)', 20)} AS __bin__l_extendedprice, CAST(count(*) AS DOUBLE) AS value FROM lineitem WHERE {_brush(5, 20)} AND l_extendedprice BETWEEN 900 AND 105000 + 1e-10 GROUP BY 1",
            lambda c: c.slice(5, 20))
_cube_query("cube_hist2d_target", cubes.CubeSpec("lineitem", QUANTITY, (cubes.TargetDim("l_discount", "binned", 6, (0.0, 0.1), bin_variant="hist2d"), cubes.TargetDim("l_tax", "binned", 5, (0.0, 0.08), bin_variant="hist2d")), cubes.Measure("mean", "l_extendedprice")), "lineitem",
            f"SELECT {sql_grid('l_discount', '0.0', '0.1', 6)} AS __bin__l_discount, {sql_grid('l_tax', '0.0', '0.08', 5)} AS __bin__l_tax, round(avg(l_extendedprice), 4) AS value FROM lineitem WHERE {_brush(5, 20)} AND l_discount BETWEEN 0 AND 0.1 AND l_tax BETWEEN 0 AND 0.08 GROUP BY 1, 2",
            lambda c: c.slice(5, 20))
_cube_query("cube_corr", cubes.CubeSpec("lineitem", QUANTITY, (), cubes.Measure("corr", columns=("l_extendedprice", "l_discount", "l_tax"))), "lineitem",
            "\nUNION ALL\n".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem WHERE {_brush(5, 20)}" for a, b in (("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))),
            lambda c: c.slice(5, 20), 6)
_cube_query("cube_treemap", cubes.CubeSpec("lineitem", QUANTITY, (cubes.TargetDim("l_returnflag", "categorical"), cubes.TargetDim("l_linestatus", "categorical")), cubes.Measure("mean", "l_extendedprice")), "lineitem",
            f"SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS value FROM lineitem WHERE {_brush(5, 20)} GROUP BY 1, 2",
            lambda c: c.slice(5, 20))


@register("cube_line_env_whole", "events", f"""
WITH d AS (SELECT CAST(min(event_id) AS DOUBLE) AS xl, CAST(max(event_id) AS DOUBLE) AS xh, CAST(min(user_id) AS DOUBLE) AS fl, CAST(max(user_id) AS DOUBLE) AS fh FROM events),
c AS (SELECT {sql_axis("user_id", "fl", "fh", 64)} AS free_bin, {sql_axis("event_id", "xl", "xh", 30)} AS b, value AS y FROM events, d WHERE value IS NOT NULL)
SELECT b AS __bin__event_id, CAST(CAST(min(y) AS FLOAT) AS DOUBLE) AS y_min, CAST(CAST(max(y) AS FLOAT) AS DOUBLE) AS y_max FROM c WHERE free_bin BETWEEN 6 AND 44 GROUP BY 1""")
def cube_line_env_whole(df):
    """Heights alone; both domains, and the brush as shares of one, come from the table."""
    (lo, hi), ids = ((0.0, 1.0) if d[0] is None else d for d in (histogram.domain(df, "user_id"), histogram.domain(df, "event_id")))
    spec = cubes.CubeSpec("events", cubes.FreeAxis("user_id", p=64, domain=(lo, hi)), (cubes.TargetDim("event_id", "binned", 30, ids),), cubes.Measure("line_env", "value"))
    return cubes.build(df, spec).slice(lo + 6.5 / 64 * (hi - lo), lo + 44.5 / 64 * (hi - lo)).select("__bin__event_id", "y_min", "y_max")


@register("cube_line_env", "events", f"""
WITH d AS (SELECT CAST(min(event_id) AS DOUBLE) AS xl, CAST(max(event_id) AS DOUBLE) AS xh, CAST(min(user_id) AS DOUBLE) AS fl, CAST(max(user_id) AS DOUBLE) AS fh FROM events),
c AS (SELECT {sql_axis("user_id", "fl", "fh", 64)} AS f, {sql_axis("event_id", "xl", "xh", 30)} AS b, CAST(event_id AS DOUBLE) AS x, value AS y, xl, (xh - xl) / 30 AS w FROM events, d WHERE value IS NOT NULL),
cell AS (SELECT f, b, any_value(xl) + b * any_value(w) AS edge, any_value(w) AS w, CAST(min(y) AS FLOAT) AS lo, arg_min(x, (y, x)) AS lo_x, CAST(max(y) AS FLOAT) AS hi, arg_min(x, (-y, x)) AS hi_x FROM c WHERE f BETWEEN 6 AND 44 GROUP BY 1, 2),
q AS (SELECT *, greatest(0, least(65535, round_even((lo_x - edge) / w * 65535, 0))) AS lo_at, greatest(0, least(65535, round_even((hi_x - edge) / w * 65535, 0))) AS hi_at FROM cell),
p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY lo, f, lo_at) AS i, row_number() OVER (PARTITION BY b ORDER BY hi DESC, f, hi_at) AS j FROM q)
SELECT b AS __bin__event_id, CAST(max(CASE WHEN i = 1 THEN lo END) AS DOUBLE) AS y_min, round(max(CASE WHEN i = 1 THEN edge + lo_at / 65535.0 * w END), 6) AS x_at_ymin,
  CAST(max(CASE WHEN j = 1 THEN hi END) AS DOUBLE) AS y_max, round(max(CASE WHEN j = 1 THEN edge + hi_at / 65535.0 * w END), 6) AS x_at_ymax FROM p GROUP BY 1""")
def cube_line_env(df):
    """Both extremes of every bucket with the places they stand at, as the cube stores them."""
    (lo, hi), ids = ((0.0, 1.0) if d[0] is None else d for d in (histogram.domain(df, "user_id"), histogram.domain(df, "event_id")))
    spec = cubes.CubeSpec("events", cubes.FreeAxis("user_id", p=64, domain=(lo, hi)), (cubes.TargetDim("event_id", "binned", 30, ids),), cubes.Measure("line_env", "value"))
    out = cubes.build(df, spec).slice(lo + 6.5 / 64 * (hi - lo), lo + 44.5 / 64 * (hi - lo))
    return rounded(out.select("__bin__event_id", "y_min", "x_at_ymin", "y_max", "x_at_ymax"), "x_at_ymin", "x_at_ymax")


# ranks by counting into bins, whatever the size -------------------------------------------

register("bar_median_bins", "lineitem", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")(lambda df: rounded(grouping.median(df, ("l_returnflag",), "l_extendedprice", "bins"), "value", digits=4))
register("box_grouped_bins", "lineitem", _sql_box("l_returnflag"))(lambda df: grouping.box(df, "l_quantity", ("l_returnflag",), "bins"))
register("box_bins", "events", _sql_box("").replace("l_quantity", "value").replace("lineitem", "events"))(lambda df: grouping.box(df, "value", (), "bins"))


# missing values: every third value of an event is null, every fifth of the others is NaN -----

_MISSING = "(SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM events)"
_NULLS = "(SELECT *, CASE WHEN event_id % 3 = 0 OR event_type = 'click' THEN NULL ELSE value END AS v FROM events)"


def with_missing(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.when(F.col("event_id") % 3 != 0, F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))))


def with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.when((F.col("event_id") % 3 != 0) & (F.col("event_type") != "click"), F.col("value")))


_REAL = "v IS NOT NULL AND NOT isnan(v)"
for _f, _e in (("min", "min(v) FILTER (" + _REAL + ")"), ("max", "max(v) FILTER (" + _REAL + ")"), ("median", "round(median(v) FILTER (" + _REAL + "), 6)")):
    register(f"missing_bar_{_f}", "events", f"SELECT event_type, {_e.replace('FILTER (', 'FILTER (WHERE ')} AS value FROM {_MISSING} GROUP BY 1")(lambda df, f=_f: rounded(grouping.aggregate(with_missing(df), ("event_type",), f, "v"), "value"))
for _f, _e in (("sum", "coalesce(sum(v), 0)"), ("mean", "avg(v)"), ("n_unique", "count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END)")):
    register(f"missing_bar_{_f}", "events", f"SELECT event_type, round(CAST({_e} AS DOUBLE), 6) AS value FROM {_NULLS} GROUP BY 1")(lambda df, f=_f: rounded(grouping.aggregate(with_nulls(df), ("event_type",), f, "v"), "value"))
register("missing_line_minmax", "events", _sql_minmax(200).replace("ts, value, row_number() OVER ( ORDER BY ts) - 1 AS ri, count(*) OVER () AS n FROM events", f"ts, v AS value, row_number() OVER (ORDER BY ts) - 1 AS ri, count(*) OVER () AS n FROM {_MISSING}").replace("FROM b)", "FROM b WHERE value IS NOT NULL AND NOT isnan(value))"))(
    lambda df: downsample.min_max(with_missing(df), "ts", "v", ["ts"], 200)
)
register("missing_box", "events", _sql_box("event_type").replace("l_quantity", "v").replace("FROM lineitem", f"FROM {_MISSING} WHERE {_REAL}"))(lambda df: grouping.box(with_missing(df), "v", ("event_type",)))
register("missing_hist1d", "events", f"""
WITH m AS (SELECT v FROM {_MISSING} WHERE {_REAL}), d AS (SELECT min(v) AS lo, max(v) + 1e-10 AS hi FROM m), c AS (SELECT {sql_hist("v", "lo", "hi", N)} AS bin, count(*) AS n FROM m, d GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range({N}) r LEFT JOIN c ON c.bin = r.range""")(
    lambda df: histogram.histogram(with_missing(df), "v", N, histogram.padded(histogram.domain(with_missing(df), "v"))).select("bin", "count")
)
register("hist1d_one_value", "events", "SELECT CAST(r.range AS INTEGER) AS bin, CASE WHEN r.range = 0 THEN (SELECT count(*) FROM events) ELSE 0 END AS count FROM range(5) r")(
    lambda df: histogram.histogram(df.select(F.lit(7.0).alias("v")), "v", 5, histogram.padded((7.0, 7.0))).select("bin", "count")
)
for _f, _e in (("mean", "avg(z)"), ("n_unique", "count(DISTINCT z)")):
    register(f"missing_hist2d_{_f}", "events", f"""
WITH d AS (SELECT min(event_id) AS xl, max(event_id) AS xh, min(user_id) AS yl, max(user_id) AS yh FROM events),
c AS (SELECT {sql_grid("event_id", "xl", "xh", 6)} AS xb, {sql_grid("user_id", "yl", "yh", 5)} AS yb, v AS z FROM {_MISSING}, d WHERE {_REAL})
SELECT CAST(x.range AS INTEGER) AS xb, CAST(y.range AS INTEGER) AS yb, round(v, 6) AS value FROM range(6) x CROSS JOIN range(5) y LEFT JOIN (SELECT xb, yb, CAST({_e} AS DOUBLE) AS v FROM c GROUP BY 1, 2) g ON g.xb = x.range AND g.yb = y.range""")(
        lambda df, f=_f: rounded(histogram.histogram2d(with_missing(df), "event_id", "user_id", 6, 5, histogram.domain(df, "event_id"), histogram.domain(df, "user_id"), "v", f), "value")
    )


# whole interactions: what the engine answers, as rows --------------------------------------


def _engine(df: DataFrame, *shown: traces.Trace) -> tuple[Engine, list[TraceInfo]]:
    return Engine(Source("lineitem", df)), [TraceInfo(x.uid, f"f{i}", x) for i, x in enumerate(shown)]


def _selected(column: str, lo: float, hi: float) -> spec.SelectionState:
    return spec.SelectionState("elsewhere", [spec.SelectionPredicate([spec.ClauseFilter(column, range=(lo, hi))])])


def _pairs(df: DataFrame, parts: list[tuple[str, list, list]], kind: str) -> DataFrame:
    rows = [(name, x, None if y is None else float(y)) for name, xs, ys in parts for x, y in zip(xs, ys)]
    return df.sparkSession.createDataFrame(rows, f"part string, x {kind}, y double")


@register("engine_crossfilter", "lineitem", """
SELECT 'all' AS part, l_returnflag AS x, round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY 2
UNION ALL SELECT 'selected', l_returnflag, round(sum(l_quantity), 2) FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 60000 GROUP BY 2""")
def engine_crossfilter(df):
    """A bar chart at first sight, and after a selection in another chart."""
    engine, infos = _engine(df, traces.BarPlot("l_returnflag", "l_quantity"))
    first = engine.process(spec.InteractionEvent("init", force_update=True), infos)[-1].updates
    event = spec.InteractionEvent("selection", selections=[_selected("l_extendedprice", 20000, 60000)], force_update=True)
    then = engine.process(event, infos)[-1].updates
    return rounded(_pairs(df, [("all", first["x"], first["y"]), ("selected", then["x"], then["y"])], "string"), "y", digits=2)


@register("engine_viewport", "lineitem", f"""
WITH c AS (SELECT {sql_hist("l_extendedprice", "20000.0", "(60000.0 + 1e-10)", N)} AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 60000 GROUP BY 1)
SELECT 'zoom' AS part, round(20000 + (r.range + 0.5) * 2000, 3) AS x, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM range({N}) r LEFT JOIN c ON c.bin = r.range""")
def engine_viewport(df):
    """A zoom of a histogram: bins over the view, centres as the payload has them."""
    engine, infos = _engine(df, traces.Histogram(x="l_extendedprice", bins=N))
    event = spec.InteractionEvent("viewport", figure_uid="f0", axis_ranges={"x": (20000.0, 60000.0)}, force_update=True)
    got = engine.process(event, infos, {"f0": {"x": (20000.0, 60000.0)}})[-1].updates
    return rounded(_pairs(df, [("zoom", got["x"], got["y"])], "double"), "x", digits=3)


@register("engine_viewport_descending", "lineitem", ORACLES["engine_viewport"].replace("'zoom'", "'reversed'"))
def engine_viewport_descending(df):
    """A view whose ends come the wrong way round is the same view."""
    engine, infos = _engine(df, traces.Histogram(x="l_extendedprice", bins=N))
    event = spec.InteractionEvent("viewport", figure_uid="f0", axis_ranges={"x": (60000.0, 20000.0)}, force_update=True)
    got = engine.process(event, infos)[-1].updates
    return rounded(_pairs(df, [("reversed", got["x"], got["y"])], "double"), "x", digits=3)


@register("engine_grid_percent", "lineitem", f"""
WITH d AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem),
c AS (SELECT {sql_grid("l_quantity", "xl", "xh", 6)} AS xb, {sql_grid("l_extendedprice", "yl", "yh", 4)} AS yb, count(*) AS n FROM lineitem, d GROUP BY 1, 2)
SELECT xb, yb, round(n * 100.0 / sum(n) OVER (), 6) AS value FROM c""")
def engine_grid_percent(df):
    """The cells of a normalised grid as its payload has them; empty ones are blank."""
    engine, infos = _engine(df, traces.Histogram2D("l_quantity", "l_extendedprice", x_bins=6, y_bins=4, histnorm="percent"))
    z = engine.process(spec.InteractionEvent("init", force_update=True), infos)[-1].updates["z"]
    cells = [(i, j, float(v)) for j, row in enumerate(z) for i, v in enumerate(row) if v is not None]
    return rounded(df.sparkSession.createDataFrame(cells, "xb int, yb int, value double"), "value")


@register("engine_corr_triangular", "lineitem", "\nUNION ALL\n".join(f"SELECT '{a}' AS x, '{b}' AS y, round(abs(corr({a}, {b})), 6) AS r FROM lineitem" for a, b in _PAIRS))
def engine_corr_triangular(df):
    """The cells of a triangular heat map of absolute correlations, with their places on the axes."""
    engine, infos = _engine(df, traces.CorrHeatmap(list(_CORR), triangular=True, absolute=True))
    got = engine.process(spec.InteractionEvent("init", force_update=True), infos)[-1].updates
    cells = [(x, y, float(v)) for y, row in zip(got["y"], got["z"]) for x, v in zip(got["x"], row) if v is not None]
    return rounded(df.sparkSession.createDataFrame(cells, "x string, y string, r double"), "r")


@register("engine_treemap", "lineitem", """
SELECT 'root' AS id, '' AS parent, '' AS label, round(sum(l_quantity), 2) AS value FROM lineitem
UNION ALL SELECT 'root/' || l_returnflag, 'root', l_returnflag, round(sum(l_quantity), 2) FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'root/' || l_returnflag || '/' || l_linestatus, 'root/' || l_returnflag, l_linestatus, round(sum(l_quantity), 2) FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def engine_treemap(df):
    """The nodes of a treemap with their ids and parents."""
    engine, infos = _engine(df, traces.TreeMap(["l_returnflag", "l_linestatus"], "l_quantity"))
    got = engine.process(spec.InteractionEvent("init", force_update=True), infos)[-1].updates
    nodes = [(i, p, n, float(v)) for i, p, n, v in zip(got["ids"], got["parents"], got["labels"], got["values"])]
    return rounded(df.sparkSession.createDataFrame(nodes, "id string, parent string, label string, value double"), "value", digits=2)


@register("engine_groups", "lineitem", f"""
WITH d AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) + 1e-10 AS hi FROM lineitem),
c AS (SELECT l_linestatus, {sql_hist("l_extendedprice", "lo", "hi", 8)} AS bin, count(*) AS n FROM lineitem, d GROUP BY 1, 2)
SELECT g.l_linestatus AS part, CAST(r.range AS INTEGER) AS x, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM (SELECT DISTINCT l_linestatus FROM lineitem) g CROSS JOIN range(8) r LEFT JOIN c ON c.bin = r.range AND c.l_linestatus = g.l_linestatus""")
def engine_groups(df):
    """The children of a grouped histogram, by the keys of their groups."""
    engine, infos = _engine(df, traces.Histogram(x="l_extendedprice", bins=8, group_by="l_linestatus"))
    groups = engine.process(spec.InteractionEvent("init", force_update=True), infos)[-1].group_results
    return _pairs(df, [(g.group_value_key, list(range(8)), g.updates["y"]) for g in groups], "int")


@register("engine_brush", "lineitem", """
WITH d AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT 'brush' AS part, l_returnflag AS x, round(sum(l_quantity), 2) AS y FROM lineitem, d
WHERE floor((l_extendedprice - lo) / (hi - lo) * 2048) BETWEEN floor((20000 - lo) / (hi - lo) * 2048) AND floor((60000 - lo) / (hi - lo) * 2048) GROUP BY 2""")
def engine_brush(df):
    """A brush on one chart, answered for another from its cube."""
    source, bars = traces.Histogram(x="l_extendedprice", bins=N), traces.BarPlot("l_returnflag", "l_quantity")
    engine, infos = _engine(df, source, bars)
    brush = Brush(engine, infos, {}, [], spec.ActiveSource("f0", "l_extendedprice", source.uid))
    got = {d.uid: d.updates for d in brush.move((20000.0, 60000.0))}[bars.uid]
    brush.close()
    return rounded(_pairs(df, [("brush", got["x"], got["y"])], "string"), "y", digits=2)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of prices, background and cross-filtered, in one scan."""
    return QUERIES["overlay_bg_fg"](spark, sf_dir)
