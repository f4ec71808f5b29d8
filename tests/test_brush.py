"""A brush answered from cubes equals the interaction answered from the rows."""

import datetime as dt

import pytest

from lumenframe.operators import transforms as tr
from lumenframe.plans import spec as sp
from lumenframe.plans import traces as t
from lumenframe.plans.brush import Brush, category_keys
from lumenframe.plans.engine import Engine, TraceInfo
from lumenframe.sources.registry import Source


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(i, "ABC"[i % 3], "XY"[i % 2], float((i * 37) % 100), float((i * 7) % 20), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), dt.date(2024, 1, 1) + dt.timedelta(days=i % 400)) for i in range(900)]
    return Engine(Source("s", spark.createDataFrame(rows, "ts int, cat string, side string, val double, other double, at timestamp_ntz, day date").cache(), ["ts"]))


def traces():
    return [t.Histogram(x="other", bins=5, histnorm="percent"), t.Histogram(x="ts", bins=4, group_by="cat"), t.BarPlot("cat", "other", "mean"), t.BarPlot("cat", "other", "sum", group_by="side"), t.PiePlot("side"), t.TreeMap(["cat", "side"], "other", "max"), t.Histogram2D("other", "ts", x_bins=3, y_bins=2, z="val", histfunc="min"), t.Histogram2D("other", "ts", x_bins=3, y_bins=2), t.CorrHeatmap(["ts", "val", "other"], absolute=True)]


def close(a, b):
    if isinstance(a, dict):
        assert a.keys() == b.keys()
        for k in a:
            close(a[k], b[k])
    elif isinstance(a, (list, tuple)):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            close(x, y)
    elif isinstance(a, float) and b is not None:
        assert a == pytest.approx(b, abs=1e-9)
    else:
        assert a == b


def check(engine, source, column, brush, shown=traces, mine=lambda f: True):
    targets = [TraceInfo(x.uid, f"f{i}", x) for i, x in enumerate(shown())]
    infos = [TraceInfo(source.uid, "src", source), *targets]
    b = Brush(engine, infos, {}, [], sp.ActiveSource("src", column, source.uid))
    got = {d.uid: d for d in b.move(brush)}
    event = sp.InteractionEvent("selection", selections=[b.commit(brush)], force_update=True)
    want = {d.uid: d for d in engine.process(event, infos)}
    assert got and set(got) <= set(want)
    for uid, d in got.items():
        close(sp.to_dict(d), sp.to_dict(want[uid]))
    b.close()
    return got


def test_range_brush(engine):
    assert len(check(engine, t.Histogram(x="val"), "val", (13.3, 61.2))) == len(traces())


def test_temporal_brushes(engine):
    micros = lambda d: (d - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)
    check(engine, t.LinePlot("at", "val"), "at", (micros(dt.datetime(2024, 1, 5)), micros(dt.datetime(2024, 1, 20))))
    days = lambda d: float((d - dt.date(1970, 1, 1)).days)
    check(engine, t.BoxPlot(x="day"), "day", (days(dt.date(2024, 2, 1)), days(dt.date(2024, 6, 1))))


def test_categorical_brush(engine):
    check(engine, t.BarPlot("cat"), "cat", [("A",), ("C",)])
    check(engine, t.TreeMap(["cat", "side"]), "cat", [("A", "X"), ("B",)])


def test_box_brush_serves_no_correlation(engine):
    got = check(engine, t.Histogram2D("val", "other"), "val", ((10.0, 50.0), (2.0, 12.0)))
    assert len(got) == len(traces()) - 1


def test_line_envelopes_hold_the_extremes(engine):
    line, source = t.LinePlot("ts", "other", n_points=20), t.Histogram(x="val")
    infos = [TraceInfo(source.uid, "src", source), TraceInfo(line.uid, "f", line)]
    b = Brush(engine, infos, {}, [], sp.ActiveSource("src", "val", source.uid))
    d = b.move((0.0, 50.0))[0].updates
    assert d["x"] == sorted(d["x"]) and max(d["y"]) == 19.0 and min(d["y"]) == 0.0 and len(d["x"]) <= 22


def test_wrong_source_serves_nothing(engine):
    h, bar = t.Histogram(x="val"), t.BarPlot("cat")
    infos = [TraceInfo(h.uid, "src", h), TraceInfo(bar.uid, "f", bar)]
    for active in (sp.ActiveSource("src", "other", h.uid), sp.ActiveSource("f", "val", h.uid), sp.ActiveSource("src", "val", "none")):
        b = Brush(engine, infos, {}, [], active)
        assert b.free is None and b.targets == []


def test_stored_cubes_are_not_built_again(engine, spark, tmp_path):
    from lumenframe.plans.cubestore import CubeStore

    store = CubeStore(spark, str(tmp_path))
    h = t.Histogram(x="val")
    targets = [t.BarPlot("cat", "other", "max"), t.CorrHeatmap(["ts", "val"]), t.LinePlot("ts", "other", n_points=10)]
    infos = [TraceInfo(h.uid, "src", h), *(TraceInfo(x.uid, "f", x) for x in targets)]
    active = sp.ActiveSource("src", "val", h.uid)
    first = Brush(engine, infos, {}, [], active, store)
    want = [sp.to_dict(d) for d in first.move((5.0, 60.0))]
    engine_without_rows = Engine(Source("s", engine.source.df.where("false"), ["ts"]))
    engine_without_rows.source._domains = dict(engine.source._domains)
    again = Brush(engine_without_rows, infos, {}, [], active, store)
    close([sp.to_dict(d) for d in again.move((5.0, 60.0))], want)
    assert len(list(tmp_path.iterdir())) == 3


def test_category_keys():
    p = lambda **v: sp.SelectionPredicate([sp.ClauseFilter(c, values=[x]) for c, x in v.items()])
    assert category_keys(("a", "b"), [p(a="x", b="y"), p(a="z")]) == [("x", "y"), ("z",)]
    with pytest.raises(ValueError):
        category_keys(("a", "b"), [p(b="y")])
    with pytest.raises(ValueError):
        category_keys(("a",), [sp.SelectionPredicate([sp.ClauseFilter("a", range=(0, 1))])])


def test_transforms(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(200)], "x int, y double")
    assert df.transform(tr.every_nth(50, ["x"])).count() == 50
    assert df.transform(tr.arg_min_max("y", 20, ["x"])).count() == 20
    assert df.transform(tr.fpcs("y", 10, ["x"])).where("ri in (0, 199)").count() == 2
    assert df.transform(tr.fpcs_line("x", "y", 10, names=("a", "b"))).columns == ["a", "b"]
    assert [r["count"] for r in df.transform(tr.fixed_hist("y", 0, 10, 2)).orderBy("bin").collect()] == [100, 100]
    assert df.transform(tr.fixed_hist("y", None, None, 1)).first().breakpoint == 1.0
    assert df.transform(tr.fixed_hist2d("x", "y", (0, 199), (0, 9), 2, 2)).count() == 4
    assert df.transform(tr.fixed_hist2d_reduce("x", "y", "y", (0, 199), (0, 9), 2, 2, "max")).agg({"value": "max"}).first()[0] == 9.0
    assert df.transform(tr.fixed_line_envelope2d("x", "y", "y", (0, 199), (0, 9), 4, 3)).first().free_bin == 0
    with pytest.raises(ValueError):
        tr.fixed_hist2d_reduce("x", "y", "y", (0, 1), (0, 1), 2, 2, "mode")
