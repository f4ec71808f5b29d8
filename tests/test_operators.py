"""Operators against plain Python over small frames."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import correlation, downsample, envelope, grouping, histogram, ordering


def test_histogram_counts_every_value_once(spark):
    values = [None, math.nan, -1.0, 0.0, 0.5, 1.0, 2.5, 9.99, 10.0, 11.0, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = histogram.histogram(df, "v", 4, (0.0, 10.0)).orderBy("bin").collect()
    assert [r["count"] for r in got] == [4, 1, 0, 4]
    assert [(r.lo, r.hi) for r in got] == [(0.0, 2.5), (2.5, 5.0), (5.0, 7.5), (7.5, 10.0)]


def test_histogram_of_nothing_has_all_bins(spark):
    df = spark.createDataFrame([], "v double, g string")
    assert [r["count"] for r in histogram.histogram(df, "v", 3, histogram.padded(histogram.domain(df, "v"))).collect()] == [0, 0, 0]
    assert histogram.histogram(df, "v", 3, (0.0, 1.0), ("g",)).collect() == []


def test_histogram_layers_and_groups(spark):
    df = spark.createDataFrame([(float(i % 10), None if i % 3 == 0 else "ab"[i % 2], i) for i in range(60)], "v double, g string, i int")
    got = histogram.histogram(df, "v", 5, (0.0, 10.0), ("g",), F.col("i") < 30).collect()
    assert len(got) == 15 and sum(r["count"] for r in got) == 60 and sum(r["fg_count"] for r in got) == 30


def test_fused_histograms_equal_single_ones(spark):
    df = spark.createDataFrame([(float(i), i % 7) for i in range(50)], "a double, b int")
    fused = histogram.histograms(df, [("x", "a", 5, (0.0, 50.0)), ("y", "b", 3, (0.0, 7.0))]).collect()
    for t, c, n, bounds in (("x", "a", 5, (0.0, 50.0)), ("y", "b", 3, (0.0, 7.0))):
        one = {r.bin: r["count"] for r in histogram.histogram(df, c, n, bounds).collect()}
        assert {r.bin: r["count"] for r in fused if r.trace == t} == one


@pytest.mark.parametrize("func", ["sum", "mean", "min", "max", "median", "n_unique"])
def test_histogram2d_reductions(spark, func):
    rnd = random.Random(3)
    rows = [(rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.choice([None, math.nan, 1.0, 2.0, 5.0, 7.5])) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    cells = {}
    for x, y, z in rows:
        if z is not None and not math.isnan(z):
            at = tuple(min(2, math.floor(v * (3 / (10 + 1e-10)) + 1e-9)) for v in (x, y))
            cells.setdefault(at, []).append(z)
    want = {"sum": sum, "mean": statistics.mean, "min": min, "max": max, "median": statistics.median, "n_unique": lambda v: float(len(set(v)))}[func]
    got = {(r.xb, r.yb): r.value for r in histogram.histogram2d(df, "x", "y", 3, 3, (0.0, 10.0), (0.0, 10.0), "z", func).collect()}
    assert got == pytest.approx({(i, j): want(cells[i, j]) if (i, j) in cells else None for i in range(3) for j in range(3)})


def test_normalised_with_no_rows_is_nan(spark):
    df = spark.createDataFrame([], "v double")
    assert all(math.isnan(r.value) for r in histogram.normalised(histogram.histogram(df, "v", 2, (0.0, 1.0)), "percent", 0.5).collect())


def test_reducers_on_missing_values(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", math.nan), ("b", 1.0), (None, 4.0)], "g string, v double")
    get = lambda f: {r.g: r.value for r in grouping.aggregate(df, ("g",), f, "v").collect()}
    assert get("count") == {"a": 2, "b": 3, None: 1}
    assert get("sum")["a"] == 0.0 and get("mean")["a"] is None
    assert get("min") == {"a": None, "b": 1.0, None: 4.0} and get("max") == {"a": None, "b": 1.0, None: 4.0}
    assert get("median") == {"a": None, "b": 1.0, None: 4.0}
    assert get("n_unique") == {"a": 1, "b": 2, None: 1}
    with pytest.raises(ValueError):
        grouping.aggregate(df, ("g",), "mode", "v")


def test_treemap_parents_are_sums_of_final_leaves(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 10.0), ("b", None, 5.0)], "p string, q string, v double")
    got = {(r.level, r.p, r.q): r.value for r in grouping.treemap(df, ("p", "q"), "mean", "v").collect()}
    assert got == {(0, None, None): 17.0, (1, "a", None): 12.0, (1, "b", None): 5.0, (2, "a", "x"): 2.0, (2, "a", "y"): 10.0, (2, "b", None): 5.0}


def test_box_takes_nearest_ranks(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 11)] + [("g", None), ("h", math.nan), ("k", 2.0)], "g string, v double")
    got = {r.g: r for r in grouping.box(df, "v", ("g",)).collect()}
    assert set(got) == {"g", "k"}
    r = got["g"]
    assert (r.q0, r.q1, r.q2, r.q3, r.q4) == (1.0, 3.0, 6.0, 8.0, 10.0) and (r.lower, r.upper) == (1.0, 10.0)
    assert grouping.box(df.where("false"), "v").collect() == []


@pytest.mark.parametrize("method", ["window", "ranges"])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_positions_by_window_and_by_ranges_agree(spark, method, by):
    rnd = random.Random(1)
    keys = rnd.sample(range(10_000), 500)
    rows = [(k, None if k % 5 == 0 else "xyz"[k % 3]) for k in keys]
    df = spark.createDataFrame(rows, "k int, g string")
    got = {r.k: (r.ri, r.n_rows) for r in ordering.with_position(df, ["k"], by, method).collect()}
    want = {}
    for g in {r[1] for r in rows} if by else {0}:
        mine = sorted(k for k, h in rows if not by or h == g)
        want.update({k: (i, len(mine)) for i, k in enumerate(mine)})
    assert got == want


def test_sortedness(spark):
    df = spark.createDataFrame([(i, i * 2, -i) for i in range(50)], "t int, up int, down int")
    assert ordering.is_sorted(df, "up", ["t"]) and not ordering.is_sorted(df, "down", ["t"])
    assert ordering.keep_order(df, ["t"]) and not ordering.keep_order(df.union(df), ["t"])


def _buckets(n, k):
    base, extra = divmod(n, k)
    at = 0
    for i in range(k):
        size = base + (i < extra)
        yield range(at, at + size)
        at += size


def _minmax(ys, n_points):
    kept = set()
    for run in _buckets(len(ys), min(max(1, n_points // 2), len(ys))) if ys else ():
        valid = [i for i in run if ys[i] is not None and not math.isnan(ys[i])]
        if valid:
            kept |= {min(valid, key=lambda i: (ys[i], i)), min(valid, key=lambda i: (-ys[i], i))}
    return sorted(kept)


@pytest.mark.parametrize("n,points", [(137, 20), (1000, 64), (10, 50), (1, 10), (0, 10), (501, 1)])
def test_min_max_keeps_first_extremes_of_each_run(spark, n, points):
    rnd = random.Random(n)
    ys = [None if i % 51 == 7 else math.nan if i % 37 == 3 else float(rnd.randint(0, 6)) for i in range(n)]
    df = spark.createDataFrame([(i, y) for i, y in enumerate(ys)], "x int, y double")
    got = sorted(r.ri for r in downsample.min_max(df, "x", "y", ["x"], points).collect())
    assert got == _minmax(ys, points)


@pytest.mark.parametrize("n,points", [(100, 10), (101, 10), (7, 10), (0, 5), (23, 7)])
def test_every_nth(spark, n, points):
    df = spark.createDataFrame([(i,) for i in range(n)], "x int")
    stride = max(1, n // points)
    want = [i for i in range(0, n, stride)][:points]
    assert [r.x for r in downsample.every_nth(df, ["x"], points).orderBy("ri").collect()] == want
    with pytest.raises(ValueError):
        downsample.every_nth(df, ["x"], 0)


def _fpcs(ys, n_points):
    """A plain statement of compensated sampling: follow the extremes, let a pending one out when the direction turns."""
    n = len(ys)
    if n <= n_points or n - 2 <= 2 * (n_points - 2):
        return list(range(n))
    out = [0]
    high = low = pending = (0, ys[0])
    flag = ""
    for run in _buckets(n - 2, n_points - 2):
        idx = [i + 1 for i in run]
        lo, hi = min(idx, key=lambda i: (ys[i], i)), min(idx, key=lambda i: (-ys[i], i))
        if not high[1] > ys[hi]:
            high = (hi, ys[hi])
        if not low[1] <= ys[lo]:
            low = (lo, ys[lo])
        if low[0] < high[0]:
            if flag == "min" and low[0] != pending[0]:
                out.append(pending[0])
            out.append(low[0])
            pending = low = high
            flag = "min"
        else:
            if flag == "max" and high[0] != pending[0]:
                out.append(pending[0])
            out.append(high[0])
            pending = high = low
            flag = "max"
    out += [pending[0], n - 1]
    return [v for i, v in enumerate(out) if i == 0 or out[i - 1] != v]


@pytest.mark.parametrize("n,points", [(400, 20), (1000, 33), (50, 40), (3, 5), (200, 3)])
def test_fpcs_follows_the_fold(spark, n, points):
    rnd = random.Random(n)
    ys = [float(rnd.randint(0, 20)) for _ in range(n)]
    df = spark.createDataFrame([(i, y) for i, y in enumerate(ys)], "x int, y double")
    assert [r.ri for r in downsample.fpcs(df, "x", "y", ["x"], points).orderBy("ri").collect()] == sorted(set(_fpcs(ys, points)))
    with pytest.raises(ValueError):
        downsample.fpcs(df, "x", "y", ["x"], 2)


def test_fpcs_by_group(spark):
    rnd = random.Random(5)
    rows = [(i, "ab"[i % 2], rnd.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "x int, g string, y double")
    got = downsample.fpcs(df, "x", "y", ["x"], 15, ("g",)).collect()
    for g in "ab":
        ys = [y for _, h, y in rows if h == g]
        assert sorted(r.ri for r in got if r.g == g) == sorted(set(_fpcs(ys, 15)))


def test_gaps():
    lat, lon = downsample.geo_gaps([40.0, 40.1, 40.2, 50.0, 50.1, 50.2], [-74.0] * 6)
    assert lat == [40.0, 40.1, 40.2, None, 50.0, 50.1, 50.2] and lon[3] is None
    assert downsample.geo_gaps([1.0], [1.0]) == ([1.0], [1.0]) and downsample.geo_gaps([1.0, 1.0], [2.0, 2.0])[0] == [1.0, 1.0]
    assert downsample.line_gaps([0, 1, 2, 30], [1, 2, 3, 4]) == ([0, 1, 2, 30, 30], [1, 2, 3, None, 4])


def test_envelope_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(float(i % 211), None if i % 53 == 0 else math.nan if i % 31 == 0 else float(rnd.randint(0, 4)), rnd.uniform(-1, 11), i) for i in range(2000)] + [(210.0, 9.0, 10.0, 5000)]
    df = spark.createDataFrame(rows, "x double, y double, f double, i int")
    cells = {}
    for x, y, f, i in rows:
        if y is None or math.isnan(y) or not (0 <= f <= 10) or not (0 <= x <= 210):
            continue
        cells.setdefault((math.floor(f / 10 * 4), math.floor(x / 210 * 7)), []).append((y, i, x))
    got = {(r.free_bin, r.bucket): (r.y_min, r.x_at_ymin, r.y_max, r.x_at_ymax) for r in envelope.envelope2d(df, "x", "y", "f", (0.0, 210.0), (0.0, 10.0), 7, 4, ["i"]).collect()}
    want = {}
    for k, v in cells.items():
        lo, hi = min(v, key=lambda t: (t[0], t[1])), min(v, key=lambda t: (-t[0], t[1]))
        want[k] = (lo[0], lo[2], hi[0], hi[2])
    assert got == want
    with pytest.raises(ValueError):
        envelope.envelope2d(df, "x", "y", "f", (210.0, 0.0), (0.0, 10.0), 7, 4, ["i"])


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), float(-i), 3.0, None if i == 2 else float(i * i), "t") for i in range(6)], "a double, b double, c double, d double, t string")
    got = {(r.a, r.b): r.r for r in correlation.correlations(df).collect()}
    assert got["a", "b"] == pytest.approx(-1.0) and got["a", "c"] == 0.0 and set(got) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    xs = [i for i in range(6) if i != 2]
    assert got["a", "d"] == pytest.approx(statistics.correlation(xs, [x * x for x in xs]))
    rank = {(r.a, r.b): r.r for r in correlation.correlations(df, ["a", "d"], "spearman").collect()}
    assert rank["a", "d"] == pytest.approx(1.0)
    assert correlation.correlations(df, ["a", "b"], absolute=True).first().r == pytest.approx(1.0)
    with pytest.raises(ValueError):
        correlation.correlations(df, ["a"])


def test_spearman_with_ties(spark):
    x, y = [1, 2, 2, 3, 5, 5, 5], [3, 1, 1, 2, 9, 8, 8]
    df = spark.createDataFrame(list(zip(x, y)), "x int, y int")

    def ranks(v):
        return [sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v]

    got = correlation.correlations(df, ["x", "y"], "spearman").first().r
    assert got == pytest.approx(statistics.correlation(ranks(x), ranks(y)))


def test_matrix_shape():
    assert correlation.matrix(["a", "b"], {("a", "b"): 0.5}) == [[1.0, 0.5], [0.5, 1.0]]
    assert correlation.matrix(["a", "b"], {("a", "b"): 0.5}, True) == [[None, None], [0.5, None]]


@pytest.mark.parametrize("kind", ["double", "long", "decimal(20,3)", "int"])
def test_ranks_by_bins_are_exact(spark, kind):
    from decimal import Decimal

    rnd = random.Random(3)
    draw = {
        "double": lambda: rnd.choice([0.0, -0.0, 1e-310, -1e300, 1e300, 5e-324, rnd.gauss(0, 1), rnd.gauss(0, 1) * 1e6, 7.5]),
        "long": lambda: rnd.choice([0, 2**62 + rnd.randrange(50), -(2**61), rnd.randrange(-1000, 1000), 5]),
        "decimal(20,3)": lambda: Decimal(rnd.randrange(-(10**9), 10**9)) / 1000,
        "int": lambda: rnd.randrange(3),
    }[kind]
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, None]), draw()) for _ in range(1500)] + [("one", 1, draw())]
    df = spark.createDataFrame(rows, f"g string, h int, v {kind}")
    ranks = {"first": lambda n: F.lit(0), "middle": lambda n: F.floor((n - 1) / 2), "last": lambda n: n - 1}
    for by in ((), ("g",), ("g", "h")):
        want = {}
        for g, h, v in rows:
            want.setdefault((g, h)[: len(by)], []).append(v)
        for method in ("bins", "window"):
            got = {tuple(r)[: len(by)]: tuple(r)[len(by) :] for r in ordering.pick_ranks(df, "v", by, ranks, method).collect()}
            assert got == {k: (min(v), sorted(v)[(len(v) - 1) // 2], max(v)) for k, v in want.items()}
    assert ordering.pick_ranks(df.where("false"), "v", ("g",), ranks, "bins").count() == 0


def test_many_groups_fall_back_to_a_window(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FEW_RANKS", 10)
    df = spark.range(100).select((F.col("id") % 20).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r.g: r.m for r in ordering.pick_ranks(df, "v", ("g",), {"m": lambda n: n - 1}, "bins").collect()}
    assert got == {i: 80.0 + i for i in range(20)}


def test_ties_keep_their_numbers(spark):
    rows = [(i % 3, i, {"k": i} if i % 2 else None) for i in range(60)]
    numbers = []
    for parts, method in ((1, "window"), (5, "window"), (3, "ranges"), (7, "ranges")):
        df = spark.createDataFrame(rows, "t int, id int, m map<string,int>").repartition(parts)
        numbers.append({r.id: r.ri for r in ordering.with_position(df, ["t"], (), method).collect()})
    assert all(n == numbers[0] for n in numbers) and sorted(numbers[0].values()) == list(range(60))


def test_written_copies_are_dropped(spark, monkeypatch):
    import os

    monkeypatch.setattr(ordering, "SMALL_BYTES", 0)
    df = spark.range(500).select(F.col("id").alias("x"), (F.col("id") * 37 % 101).cast("double").alias("y"))
    placed = ordering.with_position(df, ["x"])
    folder = os.path.dirname(placed.copy.removeprefix("file://"))
    before = set(os.listdir(folder))
    got = downsample.min_max(df, "x", "y", ["x"], 20)
    new = set(os.listdir(folder)) - before
    # What stays is the result.
    assert len(new) == 1 and got.count() == 20 and spark.read.parquet(f"{folder}/{new.pop()}").count() == 20
    ordering.drop(placed)
    assert not os.path.exists(placed.copy)
