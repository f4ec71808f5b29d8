import math
import random

import pytest

from lumenframe.llm import topk


def brute(rows, k=10):
    out = []
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in kept:
        if i % 100 == 0 and (i not in asked or (len(v), v) < (len(asked[i]), asked[i])):
            asked[i] = v
    for q, v in asked.items():
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in kept if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    return sorted(tuple(r) for r in topk.search(df, lambda i: i % 100 == 0, **options).collect())


@pytest.mark.parametrize("tile,waves_of", [(2048, 16), (2, 1), (3, 2)])
def test_equals_brute_force_with_ties_and_odd_rows(spark, tile, waves_of):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.25, 0.75, rnd.random()]) for _ in range(24)]) for i in range(901)]
    rows += [(i, [0.5] * 24) for i in range(1000, 1300)] + [(1201, [0.5] * 24)]
    rows += [(1400, None), (1500, []), (1600, [0.1, None] + [0.0] * 22), (1700, [math.nan] * 24), (1800, [math.inf] + [0.0] * 23), (None, [0.5] * 24), (1901, [1.0] * 7), (1900, [1.0] * 7), (2000, [3.0, 4.0]), (300, [0.1] * 24)]
    assert run(spark, rows, tile=tile, waves_of=waves_of) == brute(rows)


def test_large_components_stay_exact(spark):
    rnd = random.Random(6)
    rows = [(i * 50, [rnd.uniform(-1e9, 1e9) for _ in range(8)]) for i in range(12)] + [(7, [1e18] * 8), (9, [-1e300] * 8)]
    assert run(spark, rows) == brute(rows)


def test_no_rows_and_one_row(spark):
    assert run(spark, []) == [] and run(spark, [(100, [1.0, 2.0])]) == []


def test_bounds_hold():
    import numpy as np

    g = np.random.default_rng(1)
    a, b = np.floor(g.normal(size=(50, 30)) * 1000), np.floor(g.normal(size=(60, 30)) * 1000)
    for s in topk.LEVELS:
        assert (topk.statistics(a, s) @ topk.statistics(b, s).T >= a @ b.T - 1e-3).all()
    tighter = [topk.statistics(a, s) @ topk.statistics(b, s).T for s in topk.LEVELS]
    assert tighter[0].mean() > tighter[1].mean() > tighter[2].mean()


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.op6_topk(spark, sf).collect()) == brute(rows)


def test_levels_gate_one_another():
    import numpy as np

    g = np.random.default_rng(3)
    # Vectors that change slowly, as segment statistics are made for.
    centres = np.repeat(g.normal(size=(40, 16)) * 900, 4, axis=1)
    c = np.floor(centres[g.integers(0, 40, 4000)] + g.normal(size=(4000, 64)) * 40)
    ids = np.arange(4000)
    (qi, qx, floor), = topk.tiles([(int(i), (c[i] / 1024).tolist()) for i in range(0, 4000, 4)], 10, 2048)
    assert (qx == c[::4]).all()
    one = topk.Tile(qi, qx, floor, 10)
    for i in range(0, 4000, 1000):
        part = c[i : i + 1000]
        one.offer(ids[i : i + 1000], part, [topk.statistics(part, s) for s in topk.LEVELS])
    pairs = len(qi) * 4000
    assert one.computed[0] == pairs and all(b < a for a, b in zip(one.computed, one.computed[1:])) and one.computed[-1] < 0.05 * pairs
    scores = topk.exact(c[::4], c)
    for n, q in enumerate(qi.tolist()):
        want = sorted((-int(s), i) for i, s in enumerate(scores[n].tolist()) if i != q)[:10]
        assert [(-s, i) for s, i in zip(one.score[n].tolist(), one.id[n].tolist())] == want


def test_a_scan_is_bounded_by_waves(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.random() for _ in range(8)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plan = topk.search(df, lambda i: i % 100 == 0, tile=4, waves_of=2)._jdf.queryExecution().optimizedPlan().toString()
    # All waves but the last are read from where they were written.
    assert plan.count("MapInArrow") == 1
