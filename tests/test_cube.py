"""Cubes: a slice equals the aggregation of the rows in the snapped range."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.plans import codec
from lumenframe.plans import cube as c


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = [(float((37 * i) % 100), "abc"[i % 3], None if i % 17 == 0 else float(i % 50), rnd.uniform(0, 10), None if i % 29 == 0 else "xy"[i % 2]) for i in range(3000)]
    return out + [(99.0, "a", 7.0, 10.0, "x"), (0.0, "b", -3.0, 0.0, "y"), (500.0, "c", 1.0, 5.0, "x"), (None, "a", 2.0, 5.0, "x"), (math.nan, "a", 2.0, 5.0, "x")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "free double, g string, v double, w double, h string").cache()


FREE = c.FreeAxis("free", domain=(0.0, 99.0))


@pytest.mark.parametrize("agg", ["count", "sum", "mean", "min", "max"])
@pytest.mark.parametrize("lo,hi", [(10.0, 33.3), (50.0, 500.0), (80.0, 20.0), (0.0, 0.0), (99.0, 99.0)])
def test_slice_equals_filtered_aggregate(frame, rows, agg, lo, hi):
    spec = c.CubeSpec("s", FREE, (c.TargetDim("g", "categorical"),), c.Measure(agg, None if agg == "count" else "v"))
    got = {r.g: r.value for r in c.build(frame, spec).slice(lo, hi).collect()}
    a, b = c.snapped_range(c.snap(lo, hi, FREE.domain, FREE.p), FREE.domain, FREE.p)
    groups = {}
    for x, g, v, _, _ in rows:
        if x is not None and 0 <= x <= 99 and a <= x < b:
            groups.setdefault(g, []).append(v)
    known = {g: [v for v in vs if v is not None] for g, vs in groups.items()}
    want = {g: {"count": lambda: len(groups[g]), "sum": lambda: sum(vs), "mean": lambda: sum(vs) / len(vs) if vs else None, "min": lambda: min(vs, default=None), "max": lambda: max(vs, default=None)}[agg]() for g, vs in known.items()}
    assert got == pytest.approx({g: v for g, v in want.items() if v is not None})


@given(st.floats(-50, 150), st.floats(-50, 150), st.integers(1, 64))
@settings(max_examples=100, deadline=None)
def test_snap_is_ordered_and_inside(lo, hi, p):
    a, b = c.snap(lo, hi, (0.0, 99.0), p)
    assert 0 <= a <= b <= p


def test_categorical_axis_and_prefixes(frame, rows):
    spec = c.CubeSpec("s", c.FreeAxis("g", "categorical", 0, columns=("g", "h")), (), c.Measure("sum", "w"))
    cube = c.build(frame, spec)
    total = lambda test: sum(w for _, g, _, w, h in rows if h is not None and test(g, h))
    assert cube.slice_keys([("a", "x"), ("b", "y")]).first().value == pytest.approx(total(lambda g, h: (g, h) in {("a", "x"), ("b", "y")}))
    assert cube.slice_keys([("c",)]).first().value == pytest.approx(total(lambda g, h: g == "c"))
    assert cube.slice_keys([]).collect() == []
    with pytest.raises(ValueError):
        cube.slice_keys([("a", "x", "z")])


def test_box_brush(frame, rows):
    free = c.FreeAxis("free", "box2d", 16, columns=("free", "w"), domains=((0.0, 99.0), (0.0, 10.0)))
    got = c.build(frame, c.CubeSpec("s", free, ())).slice_box((10, 40), (2, 7)).first().value
    (ax, bx), (ay, by) = c.snap(10, 40, (0.0, 99.0), 16), c.snap(2, 7, (0.0, 10.0), 16)
    want = sum(1 for x, _, _, w, _ in rows if x is not None and 0 <= x <= 99 and ax <= math.floor(x / 99 * 16) <= bx and ay <= math.floor(w / 10 * 16) <= by)
    assert got == want


def test_day_axis_snaps_to_whole_days(spark):
    start = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(days=i), float(i)) for i in range(5000)], "d date, v double")
    lo = float((start - dt.date(1970, 1, 1)).days)
    free = c.FreeAxis("d", "temporal", 100, (lo, lo + 4999), unit="day")
    bins = c.snap(lo + 120, lo + 333, free.domain, 100, "day")
    a, b = c.snapped_range(bins, free.domain, 100, "day")
    assert a == int(a) and b == int(b)
    got = c.build(df, c.CubeSpec("s", free, ())).slice(lo + 120, lo + 333).first().value
    assert got == b - a


def test_line_envelope_slice(spark):
    rnd = random.Random(9)
    rows = [(i, float(rnd.randint(0, 30)), rnd.uniform(0, 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "x int, y double, f double")
    spec = c.CubeSpec("s", c.FreeAxis("f", p=32, domain=(0.0, 1.0)), (c.TargetDim("x", "binned", 10, (0.0, 1999.0)),), c.Measure("line_env", "y"))
    got = {r["__bin__x"]: r for r in c.build(df, spec).slice(0.2, 0.6).collect()}
    a, b = c.snap(0.2, 0.6, (0.0, 1.0), 32)
    for k in range(10):
        mine = [(y, math.floor(f * 32), x) for x, y, f in rows if math.floor(x / 1999 * 10) == k and a <= math.floor(f * 32) <= b]
        lo, hi = min(y for y, _, _ in mine), max(y for y, _, _ in mine)
        assert (got[k].y_min, got[k].y_max) == (lo, hi)
        first = min((bin_, x) for y, bin_, x in mine if y == hi)
        assert got[k].x_at_ymax == pytest.approx(first[1], abs=0.01)


def test_correlation_cube(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        x = rnd.gauss(1e6, 1)
        rows.append((x, 2 * x + rnd.gauss(0, 1), None if i % 11 == 0 else rnd.gauss(0, 1), float((37 * i) % 100)))
    df = spark.createDataFrame(rows, "x double, y double, z double, f double")
    cube = c.build(df, c.CubeSpec("s", c.FreeAxis("f", domain=(0.0, 99.0)), (), c.Measure("corr", columns=("x", "y", "z"))))
    got = {(r.a, r.b): r.r for r in cube.slice(20, 60).collect()}
    a, b = c.snapped_range(c.snap(20, 60, (0.0, 99.0), 2048), (0.0, 99.0), 2048)
    mine = [r for r in rows if a <= r[3] < b]
    assert got["x", "y"] == pytest.approx(np.corrcoef([r[0] for r in mine], [r[1] for r in mine])[0, 1], abs=1e-9)
    both = [(r[0], r[2]) for r in mine if r[2] is not None]
    assert got["x", "z"] == pytest.approx(np.corrcoef(*zip(*both))[0, 1], abs=1e-9)


def test_merged_cubes_equal_the_cube_of_all_rows(frame):
    spec = c.CubeSpec("s", FREE, (c.TargetDim("g", "categorical"),), c.Measure("mean", "w"))
    halves = c.build(frame.where("w < 5"), spec).merged(c.build(frame.where("w >= 5"), spec))
    whole = c.build(frame, spec)
    key = lambda cube: {(r.g, r.free_bin): (round(r.sum, 6), r["count"]) for r in cube.frame.collect()}
    assert key(halves) == key(whole)


def test_codec_round_trip_and_determinism(frame):
    spec = c.CubeSpec("s", FREE, (c.TargetDim("g", "categorical"), c.TargetDim("w", "binned", 4, (0.0, 10.0))), c.Measure("mean", "v"))
    cube = c.build(frame, spec)
    blob = codec.encode_cube(cube, "id")
    assert len(blob) == len(codec.encode_cube(c.build(frame.repartition(7), spec), "id"))
    header, data, starts = codec.decode_cube(blob)
    assert header["rows"] == len(data["free_bin"]) == starts[-1] and header["target_dims"][0]["categories"] == ["a", "b", "c"]
    assert blob[:6] == b"FVCUBE" and (12 + int.from_bytes(blob[8:12], "little")) % 8 == 0 and all(x["offset"] % 8 == 0 for x in header["columns"])
    a, b = c.snap(10.0, 33.3, FREE.domain, FREE.p)
    part = slice(starts[a], starts[b + 1])
    sums, counts = np.zeros((3, 4)), np.zeros((3, 4))
    np.add.at(sums, (data["g"][part], data["__bin__w"][part]), data["sum"][part])
    np.add.at(counts, (data["g"][part], data["__bin__w"][part]), data["count"][part])
    for r in cube.slice(10.0, 33.3).collect():
        i = "abc".index(r.g)
        assert sums[i, r["__bin__w"]] / counts[i, r["__bin__w"]] == pytest.approx(r.value)
    bundle = codec.encode_bundle([blob, blob], {"t": 1})
    assert codec.decode_bundle(bundle) == ([blob, blob], {"t": 1})
    for bad in (b"", b"XXXXXX" + blob[6:], blob[:6] + b"\x09" + blob[7:], blob[:-9]):
        with pytest.raises(ValueError):
            codec.decode_header(bad)
    with pytest.raises(ValueError):
        codec.decode_bundle(bundle[:-1])


def test_codec_of_categorical_axis_with_numbers(spark):
    df = spark.createDataFrame([(2.0, "b"), (1.0, "a"), (10.0, "a"), (1.0, "a")], "n double, g string")
    cube = c.build(df, c.CubeSpec("s", c.FreeAxis("g", "categorical", 0, columns=("g",)), (c.TargetDim("n", "categorical"),)))
    header, data, starts = codec.decode_cube(codec.encode_cube(cube, "id"))
    assert header["free"]["categories"] == [["a"], ["b"]] and header["target_dims"][0]["categories"] == [1.0, 2.0, 10.0]
    assert data["count"].tolist() == [2, 1, 1] and starts.tolist() == [0, 2, 3]


def test_specs_are_checked():
    for bad in (lambda: c.FreeAxis("x", "categorical"), lambda: c.FreeAxis("x", "box2d", columns=("y", "x")), lambda: c.FreeAxis("x", columns=("x",)), lambda: c.Measure("sum"), lambda: c.Measure("count", "v"), lambda: c.Measure("corr", columns=("a",)), lambda: c.TargetDim("x", "binned"), lambda: c.FreeAxis("x", "categorical", columns=("x",), domain=(0, 1))):
        with pytest.raises(ValueError):
            bad()
    assert not c.buildable(c.FreeAxis("x", "box2d", columns=("x", "y")), c.Measure("line_env", "v")) and c.buildable(FREE, c.Measure("line_env", "v"))


def test_content_key_tells_cubes_apart():
    one = c.CubeSpec("s", FREE, (c.TargetDim("g", "categorical"),))
    assert c.content_key(one) == c.content_key(c.CubeSpec("s", FREE, (c.TargetDim("g", "categorical"),)))
    for other in (c.CubeSpec("t", FREE, one.target_dims), c.CubeSpec("s", FREE, ()), c.CubeSpec("s", FREE, one.target_dims, passive_key="p"), c.CubeSpec("s", c.FreeAxis("free", domain=(0.0, 98.0)), one.target_dims)):
        assert c.content_key(other) != c.content_key(one)


def test_live_cube_adds_batches(spark, frame, tmp_path):
    from lumenframe.streaming.livecube import LiveCube

    spec = c.CubeSpec("s", FREE, (c.TargetDim("g", "categorical"),), c.Measure("max", "v"))
    live = LiveCube(spark, spec, str(tmp_path / "cube"))
    with pytest.raises(ValueError):
        live.cube()
    src = str(tmp_path / "in")
    frame.where("w < 3").write.parquet(src)
    query = live.start(spark.readStream.schema(frame.schema).parquet(src), str(tmp_path / "ck"), availableNow=True)
    query.awaitTermination()
    frame.where("w >= 3").write.mode("append").parquet(src)
    live.start(spark.readStream.schema(frame.schema).parquet(src), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    key = lambda df: {r.g: r.value for r in df.collect()}
    assert key(live.cube().slice(5, 70)) == key(c.build(frame, spec).slice(5, 70))


def test_windowed_counts_let_late_rows_in(spark, tmp_path):
    from lumenframe.streaming.livecube import windowed_counts

    t = dt.datetime(2024, 1, 1)
    src = str(tmp_path / "in")
    spark.createDataFrame([(t + dt.timedelta(minutes=m), "k") for m in (0, 30, 59, 61)], "ts timestamp, key string").write.parquet(src)
    got = windowed_counts(spark.readStream.schema("ts timestamp, key string").parquet(src), "ts", "key")
    q = got.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["count"] for r in spark.table("win").collect()) == [1, 3]
