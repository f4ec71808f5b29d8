"""Specs, builders, engine, service: whole interactions on small frames."""

import datetime as dt
import json
import math
import urllib.request

import pytest

from lumenframe.plans import gestures, service
from lumenframe.plans import spec as sp
from lumenframe.plans import traces as t
from lumenframe.plans.cache import LRU
from lumenframe.plans.engine import Engine, TraceInfo, ascending
from lumenframe.plans.figure import Dashboard, Figure
from lumenframe.sources.registry import REGISTRY, Source, SourceRegistry, frame_from, read


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, "ABC"[i % 3], "XY"[i % 2], float(i % 50), float((i * 7) % 20), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(240)]
    return spark.createDataFrame(rows, "ts int, cat string, side string, val double, other double, at timestamp_ntz, day date").cache()


@pytest.fixture
def engine(data):
    return Engine(Source("s", data, ["ts"]))


def run(engine, trace, event="init", figure="f", viewports=None, mode="update", **more):
    infos = [TraceInfo(trace.uid, figure, trace)]
    more.setdefault("force_update", event == "init")
    return engine.process(sp.InteractionEvent(event, **more), infos, viewports or {}, mode)


def select(column, figure="other", **clause):
    return sp.SelectionState(figure, [sp.SelectionPredicate([sp.ClauseFilter(column, **clause)])])


def test_histogram_payload(engine):
    d = run(engine, t.Histogram(x="val", bins=5))[0]
    assert sum(d.updates["y"]) == 240 and d.updates["x"][0] == pytest.approx(4.9) and d.updates["hover_bounds"][0]["x0"] == pytest.approx(0.0)
    h = run(engine, t.Histogram(y="val", bins=5, histnorm="percent"))[0]
    assert h.updates["orientation"] == "h" and sum(h.updates["x"]) == pytest.approx(100)
    one = run(engine, t.Histogram(x="val", bins=1))[0]
    assert one.updates["x"] == [None] and one.updates["y"] == [240]


def test_temporal_histograms_have_times_as_centres(engine):
    d = run(engine, t.Histogram(x="at", bins=4))[0]
    assert d.updates["x"][0].date() == dt.date(2024, 1, 2) and d.updates["hover_bounds"][0]["x0"] == pytest.approx(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    zoom = run(engine, t.Histogram(x="day", bins=4), "viewport", axis_ranges={"x": ("2024-01-01", "2024-01-31")}, figure_uid="f")[0]
    assert sum(zoom.updates["y"]) == 31 and zoom.updates["x"][0] == dt.date(2024, 1, 5)


def test_grouped_children(engine):
    d = run(engine, t.Histogram(x="val", bins=3, group_by=["cat", "side"]))[0]
    assert [c.group_value_key for c in d.group_results] == [json.dumps([a, b], separators=(",", ":")) for a in "ABC" for b in "XY"]
    assert sum(sum(c.updates["y"]) for c in d.group_results) == 240 and d.updates == {}


def test_bar_pie_treemap_box(engine):
    bar = run(engine, t.BarPlot("cat", "val", "mean", orientation="h", color_map={"A": "red"}))[0].updates
    assert bar["y"] == ["A", "B", "C"] and bar["orientation"] == "h" and bar["marker"] == {"color": ["red", None, None]}
    two = run(engine, t.BarPlot(["cat", "side"]))[0].updates
    assert two["x"][0] == '["A","X"]' and two["y"] == [40] * 6
    pie = run(engine, t.PiePlot("side", "other", "max"))[0].updates
    assert pie == {"labels": ["X", "Y"], "values": [18.0, 19.0]}
    tree = run(engine, t.TreeMap(["cat", "side"]))[0].updates
    assert tree["ids"][0] == "root" and tree["values"][0] == 240 and tree["parents"][tree["ids"].index("root/A/X")] == "root/A"
    box = run(engine, t.BoxPlot(y="val", group_by="cat"))[0].group_results
    assert box[0].updates["x0"] == "A" and box[0].updates["median"] == [24.0] or box[0].updates["median"] == [25.0]


def test_treemap_ids_are_quoted(engine, spark):
    df = spark.createDataFrame([("a/b c", 1.0), ("é*~", 2.0)], "p string, v double")
    got = run(Engine(Source("q", df)), t.TreeMap(["p"], "v"))[0].updates
    assert got["ids"] == ["root", "root/a%2Fb%20c", "root/%C3%A9%2A~"] and got["labels"] == ["", "a/b c", "é*~"]


def test_lines(engine):
    for how, n in (("minmax", 20), ("nth", 24), ("fpcs", 20)):
        d = run(engine, t.LinePlot("ts", "val", n_points=n, downsample=how))[0].updates
        assert d["x"] == sorted(d["x"]) and len(d["x"]) <= 2 * n and len(d["x"]) == len(d["y"])
    g = run(engine, t.LinePlot("ts", "val", n_points=10, group_by="cat"))[0].group_results
    assert [c.group_value_key for c in g] == ["A", "B", "C"] and all(len(c.updates["x"]) == 10 for c in g)
    z = run(engine, t.LinePlot("ts", "val", n_points=1000), "viewport", axis_ranges={"x": (50, 10)}, figure_uid="f")[0].updates
    assert z["x"] == list(range(10, 51))
    frozen = t.LinePlot("ts", "val", update_on_zoom=False)
    assert run(engine, frozen, "viewport", axis_ranges={"x": (1, 2)}, figure_uid="f") == []


def test_two_dimensional(engine):
    d = run(engine, t.Histogram2D("val", "other", x_bins=4, y_bins=3, histnorm="probability"))[0].updates
    assert sum(v for row in d["z"] for v in row if v is not None) == pytest.approx(1.0) and len(d["z"]) == 3 and len(d["hover_bounds"][0]) == 4
    z = run(engine, t.Histogram2D("val", "other", z="ts", histfunc="max", x_bins=2, y_bins=2), "viewport", axis_ranges={"x": (0, 10), "y": (0, 10)}, figure_uid="f")[0].updates
    assert z["x"] == [2.5, 7.5]
    geo = run(engine, t.GeoHistogram2D("val", "other", lat_bins=2, lon_bins=2, bin_boundaries="viewport"), "viewport", axis_ranges={"coordinates": [(0, 0), (4, 0), (4, 8), (0, 8)]}, figure_uid="f")[0].updates
    ring = geo["geojson"]["features"][0]["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] == [0.0, 0.0] and ring[2] == [2.0, 4.0] and geo["locations"][0] == "r0_c0"
    line = run(engine, t.GeoLine("val", "other", n_points=5))[0].updates
    assert len(line["lat"]) == len(line["lon"]) >= 5


def test_correlation_heatmap(engine):
    d = run(engine, t.CorrHeatmap(["ts", "val", "other"], triangular=True))[0].updates
    assert d["x"] == ["ts", "val", "other"] and d["y"] == ["other", "val", "ts"] and d["z"][-1] == [None, None, None] and d["z"][0][2] is None


def test_cross_filter_and_gates(engine):
    bar = t.BarPlot("cat")
    hit = run(engine, bar, "selection", selections=[select("val", range=(0, 9))], force_update=True)[0].updates
    assert sum(hit["y"]) == 50
    assert run(engine, bar, "selection", selections=[select("val", figure="f", range=(0, 9))], force_update=True) == []
    assert run(engine, bar, "selection", selections=[select("val", range=(0, 9))]) == []
    none = run(engine, bar, "selection", selections=[sp.SelectionState(None, select("val", range=(0, 9)).predicates)], force_update=True)[0]
    assert sum(none.updates["y"]) == 240
    off = run(engine, bar, "deselect", selections=[select("val", range=(0, 9))], force_update=True)[0]
    assert sum(off.updates["y"]) == 240
    pan = run(engine, t.Histogram(x="val", bins=2), "viewport", axis_ranges={"x": (0, 50)}, figure_uid="f", selections=[select("cat", figure="f", values=["A"])])[0]
    assert sum(pan.updates["y"]) == 240
    kept = run(engine, t.Histogram(x="val", bins=2), "viewport", axis_ranges={"x": (0, 50)}, figure_uid="f", selections=[select("cat", values=["A"])])[0]
    assert sum(kept.updates["y"]) == 80


def test_histogram_over_no_rows_falls_back_to_the_unit_domain(engine):
    d = run(engine, t.Histogram(x="val", bins=2), "selection", selections=[select("cat", values=["none"])], force_update=True)[0].updates
    assert d["y"] == [0, 0] and d["x"] == pytest.approx([0.25, 0.75])
    g = run(engine, t.Histogram2D("val", "other", x_bins=2, y_bins=1), "selection", selections=[select("cat", values=["none"])], force_update=True)[0].updates
    assert g["x"] == [0.25, 0.75] and g["z"] == [[None, None]]


def test_overlay_layers(engine):
    infos = [TraceInfo(x.uid, "f", x) for x in (t.Histogram(x="val", bins=4), t.CorrHeatmap(["ts", "val"]), t.BarPlot("cat"))]
    event = sp.InteractionEvent("selection", selections=[select("side", values=["X"])], force_update=True)
    got = engine.process(event, infos, {}, "overlay")
    assert [(d.uid, d.layer) for d in got] == [(infos[0].uid, "bg"), (infos[2].uid, "bg"), *((i.uid, "fg") for i in infos)]
    assert sum(got[0].updates["y"]) == 240 and sum(got[2].updates["y"]) == 120 and got[0].updates["x"] == got[2].updates["x"]
    plain = engine.process(sp.InteractionEvent("init", force_update=True), infos, {}, "overlay")
    assert {d.layer for d in plain} == {"bg"}


def test_siblings_share_a_domain(engine):
    a, b = t.Histogram(x="val", bins=4), t.Histogram(x="other", bins=4)
    infos = [TraceInfo(x.uid, "f", x) for x in (a, b)]
    got = engine.process(sp.InteractionEvent("init", force_update=True), infos)
    assert got[0].updates["x"] == got[1].updates["x"]


def test_reset_ignores_viewports(engine):
    h = t.Histogram(x="val", bins=2)
    zoomed = run(engine, h, "selection", viewports={"f": {"x": (0, 9)}}, force_update=True)[0]
    reset = run(engine, h, "reset", viewports={"f": {"x": (0, 9)}}, force_update=True)[0]
    assert sum(zoomed.updates["y"]) == 50 and sum(reset.updates["y"]) == 240


def test_plain_events_are_remembered(data):
    cache = LRU(10)
    e = Engine(Source("s", data, ["ts"]), cache)
    first = run(e, t.BarPlot("cat", group_by="side"))
    again = run(e, t.BarPlot("cat", group_by="side"))
    assert cache.hits == 1 and [c.updates for c in first[0].group_results] == [c.updates for c in again[0].group_results]
    assert first[0].group_results[0].uid != again[0].group_results[0].uid


def test_ascending():
    assert ascending({"x": (3, 1), "y": (None, 1), "z": [(1, 2), (0, 0)], "w": ("b", 1), "v": {"min": 5, "max": 2}}) == {"x": (1, 3), "y": (None, 1), "z": [(1, 2), (0, 0)], "w": ("b", 1), "v": (2, 5)}


def test_specs_round_trip():
    made = [t.Histogram(x="a", group_by="g"), t.BoxPlot(x="a"), t.BarPlot(["a", "b"], "v", "max", group_by="g"), t.PiePlot("a", hole=0.4), t.TreeMap(["a", "b"], "v", "mean"), t.LinePlot("a", "b", update_on_zoom=False), t.Histogram2D("a", "b", z="c", histfunc="sum", color_range=(0, 1)), t.GeoHistogram2D("a", "b"), t.GeoLine("a", "b"), t.CorrHeatmap(["a", "b"], "spearman")]
    for x in made:
        wire = json.loads(json.dumps(sp.to_dict(x.to_spec("src"))))
        back = t.from_spec(sp.from_dict(sp.TraceSpec, wire))
        assert type(back) is type(x) and sp.to_dict(back.to_spec("src")) == wire
    grid = sp.TraceSpec("u", "histogram2d", ("x", "y"), {"x": "a", "y": "b"}, {"histfunc": "count"}, {})
    assert t.from_spec(grid).params["histfunc"] is None and t.GeoLine("a", "b").selection().kind == "none"
    assert t.BarPlot("a").selection().multi == "replace" and t.PiePlot("a").selection().multi == "or"
    assert [x.filtered_only for x in (t.BarPlot("a"), t.BarPlot("a", group_by="g"), t.PiePlot("a"), t.Histogram(x="a"), t.LinePlot("a", "b"), t.GeoLine("a", "b"))] == [False, True, True, False, False, False]
    assert t.CorrHeatmap(absolute=True).display["color_range"] == (0.0, 1.0) and t.CorrHeatmap().display["color_scale"] == "rdbu"
    old = sp.TraceSpec("u", "bar", ("x", "y"), {"x": "lab", "y": "val"}, {"agg": "count"}, {})
    assert t.from_spec(old).func == "count" and t.from_spec(old).labels == ("lab",)
    with pytest.raises(ValueError):
        t.from_spec(sp.TraceSpec("u", "radar"))


@pytest.mark.parametrize("make", [lambda: t.Histogram(), lambda: t.Histogram(x="a", y="b"), lambda: t.Histogram(x="a", histnorm="x"), lambda: t.BarPlot("a", "b", "mode"), lambda: t.BarPlot("a", group_by="a"), lambda: t.TreeMap(["a", "a"]), lambda: t.LinePlot("a", "b", downsample="x"), lambda: t.Histogram2D("a", "b", z="c"), lambda: t.Histogram2D("a", "b", color_range=(2, 1)), lambda: t.GeoHistogram2D("a", "b", bin_boundaries="x"), lambda: t.CorrHeatmap(method="kendall"), lambda: sp.ClauseFilter("a"), lambda: sp.ClauseFilter("a", values=[1], closed="left"), lambda: sp.InteractionEvent("zoom")])
def test_wrong_arguments(make):
    with pytest.raises(ValueError):
        make()


def test_grid_items():
    figures = [sp.FigureSpec(uid=str(i)) for i in range(5)]
    places = sp.grid_items(figures, cols=5)
    assert [g.w for g in places] == [3, 3, 2, 2, 2] and [g.x for g in places] == [0, 3, 6, 8, 10]
    assert [(g.x, g.y) for g in sp.grid_items(figures)] == [(0, 0), (6, 0), (0, 5), (6, 5), (0, 10)]
    for bad in ({"rows": 1, "cols": 1}, {"rows": 0}, {"cols": 13}):
        with pytest.raises(ValueError):
            sp.grid_items(figures, **bad)


def test_figure_labels_titles_and_validation(tmp_path):
    f = Figure(source="s").add_bar("cat", "val", agg="mean")
    assert f.to_spec().figure.layout == {"xlabel": "cat", "ylabel": "mean of val"}
    f.xlabel("mine").legend(False)
    f.save_spec(str(tmp_path / "f.json"))
    assert Figure.load_spec(str(tmp_path / "f.json")).figure.layout["xlabel"] == "mine"
    assert Figure().add_pie(["a", "b"]).to_spec().figure.layout["title"] == "count of [a, b]"
    assert Figure().add_histogram2d("a", "b", histnorm="percent").to_spec().figure.layout["title"] == "percent"
    with pytest.raises(ValueError):
        Figure().add_bar("a").add_bar("b", bar_mode="stack").to_spec()
    with pytest.raises(ValueError):
        Figure().add_histogram2d("a", "b").add_histogram2d("a", "b", color_scale="Reds").to_spec()


def test_gestures():
    bar, tree, geo = t.BarPlot(["a", "b"]).selection(), t.TreeMap(["a", "b"]).selection(), t.GeoHistogram2D("lat", "lon").selection()
    p = gestures.from_labels(bar, ['["x",1]'])[0]
    assert [(c.column, c.values) for c in p.clauses] == [("a", ["x"]), ("b", [1])]
    up, down = gestures.from_path(tree, "root/a%2Fb"), gestures.from_path(tree, "root/a%2Fb/c")
    assert up.clauses[0].values == ["a/b"] and gestures.from_path(tree, "root") is None
    assert gestures.add([up], down, "path") == [down] and gestures.add([down], up, "path") == [up] and gestures.add([up], up, "path") == []
    other = gestures.from_path(tree, "root/z")
    assert gestures.add([up], other, "path") == [up, other] and gestures.add([up], other, "replace") == [other]
    g = gestures.from_geo(geo, [(1, 5), (3, 2)])
    assert [(c.column, c.range) for c in g.clauses] == [("lon", (1, 3)), ("lat", (2, 5))]
    r = gestures.from_ranges([t.Histogram2D("a", "b").selection(), t.LinePlot("a", "c").selection()], {"x": (5, 1), "y": (0, 2)})
    assert len(r) == 1 and [(c.column, c.range) for c in r[0].clauses] == [("a", (1, 5)), ("b", (0, 2))]


def test_caches():
    few, bytes_ = LRU(2), LRU(10, sized=True)
    for k in "abc":
        few.set(k, k)
    assert few.get("a") is None and few.get("c") == "c" and len(few) == 2
    bytes_.set("x", b"12345678")
    bytes_.set("y", b"123")
    assert bytes_.get("x") is None and bytes_.get("y") == b"123"
    bytes_.set("z", b"x" * 11)
    assert bytes_.get("z") is None and bytes_.used == 3


def test_sources(spark, data, tmp_path):
    import pandas as pd
    import pyarrow as pa

    assert frame_from(spark, pd.DataFrame({"a": [1]})).count() == frame_from(spark, pa.table({"a": [1]})).count() == 1
    with pytest.raises(ValueError):
        frame_from(spark, 3)
    data.select("ts", "val").write.parquet(str(tmp_path / "p"))
    data.select("ts", "val").write.csv(str(tmp_path / "c"), header=True)
    assert read(spark, str(tmp_path / "p")).count() == read(spark, str(tmp_path / "c"), "csv", header=True).count() == 240
    from lumenframe.sources.registry import store

    kept = store(data, str(tmp_path / "s"), ["ts"], 4)
    assert kept.count() == 240 and kept.schema == data.schema and len(list((tmp_path / "s").glob("part-*"))) == 4
    r = SourceRegistry()
    r.register("d", data, order_by=["ts"])
    assert r.get("d").domains(["val", "cat" if False else "other"]) == {"val": (0.0, 49.0), "other": (0.0, 19.0)}
    r.get("d").check_sorted("ts")
    with pytest.raises(ValueError):
        r.get("d").check_sorted("val")
    with pytest.raises(KeyError):
        r.get("missing")
    with pytest.raises(ValueError):
        r.register("e", data, order_by=["nope"])


def test_dashboard_cubes_and_service(data):
    d = Dashboard(data, "svc", cache=True, order_by=["ts"])
    hist = d.add_figure().add_histogram(x="val", bins=10)
    bars = d.add_figure().add_bar("cat", "other").add_bar("cat", "other", color="blue")
    boxes = d.add_figure().add_boxplot(y="val")
    grid = d.add_figure().add_histogram2d("val", "other", x_bins=3, y_bins=3)
    lines = d.add_figure().add_line("ts", "val", n_points=20)
    first = d.show()
    assert set(first["deltas"]) == {f.uid for f in d.figures} and json.dumps(first)
    body = {"spec": sp.to_dict(d.to_spec()), "event": {"type": "cube_request"}, "active_source": {"figure_uid": hist.uid, "column": "val", "trace_uid": hist.traces[0].uid}}
    got = service.handle_update(body)
    served = got["trace_cubes"]
    assert set(served) == {bars.traces[0].uid, bars.traces[1].uid, grid.traces[0].uid, lines.traces[0].uid} and served[bars.traces[0].uid] == served[bars.traces[1].uid]
    assert service.handle_update(body)["bundle"] == got["bundle"] and service.app.cubes.hits >= 3
    body["active_source"]["column"] = "other"
    assert service.handle_update(body)["trace_cubes"] == {}
    body["active_source"] = {"figure_uid": bars.uid, "column": "cat", "trace_uid": bars.traces[0].uid}
    passive = [{"source_figure_uid": boxes.uid, "predicates": [{"clauses": [{"column": "val", "range": [0, 9]}]}]}]
    body["event"]["selections"] = passive
    assert hist.traces[0].uid in service.handle_update(body)["trace_cubes"]
    spec = sp.to_dict(d.to_spec())
    spec["state"]["viewport"] = {f"{hist.uid}/x": {"min": 0, "max": 9}}
    zoom = service.handle_update({"spec": spec, "event": {"type": "viewport", "figure_uid": hist.uid, "axis_ranges": {"x": [0, 9]}}})
    assert sum(zoom["deltas"][hist.uid][0]["updates"]["y"]) == 50 and zoom["deltas"][bars.uid] == []
    server = service.serve()
    base = "http://%s:%d" % server.server_address
    post = lambda path, x: json.loads(urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(x).encode())).read())
    assert post("/dashboard/update", {"spec": spec, "event": {"type": "viewport", "figure_uid": hist.uid, "axis_ranges": {"x": [0, 9]}}}) == json.loads(json.dumps(zoom))
    text = post("/share", spec)["spec"]
    assert json.loads(urllib.request.urlopen(f"{base}/view?spec={text}").read())["figures"][0]["uid"] == hist.uid
    assert "svc" in json.loads(urllib.request.urlopen(f"{base}/sources").read())
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{base}/nothing")
    server.shutdown()
    REGISTRY.register("svc", data)
    assert len(service.app.deltas) == 0


def test_viewport_keys():
    spec = sp.DashboardSpec(figures=[sp.FigureSpec(uid="a"), sp.FigureSpec(uid="b")], state=sp.InteractionState(viewport={"a/x": {"min": 1, "max": 2}, "y": {"min": 0, "max": 1}, "b/coordinates": [[0, 1]], "c/x": {"min": 0, "max": 1}, "b/x": None}))
    assert service.viewports(spec) == {"a": {"x": (1, 2), "y": (0, 1)}, "b": {"y": (0, 1), "coordinates": [[0, 1]]}}


def test_plain_json():
    assert service.plain({"a": (dt.date(2024, 1, 1), math.nan, 1)}) == {"a": ["2024-01-01", None, 1]}
    with pytest.raises(TypeError):
        service.plain(object())


def _call_wsgi(application, method, path, body=b"", query=""):
    import io

    got = {}
    raw = b"".join(application({"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}, lambda status, headers: got.update(status=status, headers=dict(headers))))
    return got["status"], raw


def test_package_exports(data):
    import lumenframe

    assert set(lumenframe.__all__) == {"Dashboard", "Figure", "app", "mount_into", "register_source"} == set(dir(lumenframe))
    assert lumenframe.app is service.app and lumenframe.Figure().add_bar("cat").traces
    lumenframe.register_source("exported", data)
    assert "exported" in lumenframe.app.registry.names()
    with pytest.raises(AttributeError):
        lumenframe.nothing


def test_mounting_into_other_applications(data):
    import asyncio

    service.app.registry.register("mounted", data)

    def host(environ, start_response):
        start_response("200 OK", [])
        return [b"host"]

    both = service.mount_into(host, "/viz")
    assert _call_wsgi(both, "GET", "/other") == ("200 OK", b"host") and _call_wsgi(both, "GET", "/vizard") == ("200 OK", b"host")
    status, raw = _call_wsgi(both, "GET", "/viz/sources")
    assert status == "200 OK" and "mounted" in json.loads(raw)
    assert _call_wsgi(both, "GET", "/viz/nowhere")[0].startswith("404") and _call_wsgi(both, "POST", "/viz/update", b"{")[0].startswith("422")

    class Framework:
        def __init__(self):
            self.mounted = {}

        def mount(self, prefix, application):
            self.mounted[prefix] = application

    framework = Framework()
    assert service.mount_into(framework) is framework and framework.mounted == {"/lumenframe": service.app}
    with pytest.raises(TypeError):
        service.mount_into(object())

    class Held:
        wsgi_app = staticmethod(host)

    held = Held()
    assert service.mount_into(held, "viz") is held and _call_wsgi(held.wsgi_app, "GET", "/viz/cache/stats")[0] == "200 OK"

    async def call(scope, body=b""):
        sent = []

        async def receive():
            return {"type": "http.request", "body": body, "more_body": False}

        async def send(message):
            sent.append(message)

        await service.app({"type": "http", "query_string": b"", "headers": [(b"accept-encoding", b"gzip")], **scope}, receive, send)
        return sent

    start, end = asyncio.run(call({"method": "GET", "path": "/viz/sources", "root_path": "/viz"}))
    assert start["status"] == 200 and (b"content-encoding", b"gzip") in start["headers"]
    import gzip

    assert "mounted" in json.loads(gzip.decompress(end["body"]))


def test_other_memories_behind_a_service(data):
    class Store(dict):
        def set(self, key, value):
            self[key] = value

    from lumenframe.plans.figure import Dashboard
    from lumenframe.sources.registry import SourceRegistry

    registry = SourceRegistry()
    registry.register("own", data, cache=True)
    deltas, cubes = Store(), Store()
    own = service.Service(registry, deltas, cubes)
    d = Dashboard(source="own")
    d.add_figure().add_bar("cat")
    body = {"spec": sp.to_dict(d.to_spec()), "event": {"type": "init", "force_update": True}}
    first = own.update(body)
    assert deltas and own.update(body) == first and json.loads(own.answer("GET", "/cache/stats", "", b"", False)[2]) == {"deltas": {}, "cubes": {}}
    other = Store()
    own.use(deltas=other)
    assert own.update(body) == first and other and own.cubes is cubes
    registry.register("own", data, cache=True)
    assert not other and len(deltas) == 1


def test_labels_and_titles_come_from_the_traces(data):
    from lumenframe.plans.figure import Figure, described

    assert described(Figure().add_line("ts", "val").traces) == {"xlabel": "ts", "ylabel": "val"}
    assert described(Figure().add_histogram(y="val", histnorm="percent").traces) == {"xlabel": "percent", "ylabel": "val"}
    assert described(Figure().add_bar(["a", "b"], "v", agg="mean", orientation="h").traces) == {"xlabel": "mean of v", "ylabel": "[a, b]"}
    assert described(Figure().add_line("ts", "val").add_line("ts", "other").traces) == {"xlabel": "ts"}
    assert described(Figure().add_pie("cat").traces) == {"title": "count of cat"} and described(Figure().add_pie("cat", "v").traces) == {"title": "sum of v"}
    assert described(Figure().add_histogram2d("a", "b", z="c", histfunc="max", histnorm="percent").traces)["title"] == "max of c (percent)"
    assert described([]) == {}
