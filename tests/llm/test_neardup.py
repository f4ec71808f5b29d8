import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import graph, neardup
from lumenframe.llm.graph import components
from lumenframe.llm._common import BATCH_ROWS, Scratch
from tests.llm import brute

EDGES = [(900, None, "x"), (901, "", "x"), (902, " \t\n", "x"), (903, "One", "x"), (904, "one", "x"), (905, "one two", "x"), (906, "ONE  two", "x"), (907, "É a b c", "x"), (908, "é a b c", "x"), (909, "q r s t u", "x"), (910, "q r s t u", "x")]


def corpus(seed, groups=25, size=8, spread=6, length=90):
    """Groups of edited copies around the threshold, unrelated documents and exact copies."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 4)))
    rows, i = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(5, length))]
        for _ in range(rnd.randint(1, size)):
            copy = list(base)
            for _ in range(rnd.randint(0, spread)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy), "s"))
            i += 1
    return rows


def linked(spark, rows, n, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    return neardup.link(df, n, num, den).collect()


@pytest.mark.parametrize("n,num,den,seed", [(3, 85, 100, 1), (5, 80, 100, 2)])
def test_equals_brute_force(spark, n, num, den, seed):
    rows = corpus(seed) + EDGES
    want = brute.near_groups([(d, t) for d, t, _ in rows], n, num, den)
    got = linked(spark, rows, n, num, den)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(brute.shingles(t, n)) for d, t, _ in rows}


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(60)] = rnd.choice("abc")
        rows.append((i, " ".join(copy), "s"))
    got = linked(spark, rows, 3, 85, 100)
    assert {r.doc_id: r.component_id for r in got} == brute.near_groups([(d, t) for d, t, _ in rows], 3, 85, 100)


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "a b c d e f g h"
    got = linked(spark, [(5, text, "x"), (5, text, "x"), (3, text, "x"), (None, text, "x"), (7, None, "x"), (7, None, "x")], 3, 85, 100)
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True)]
    assert linked(spark, [], 3, 85, 100) == []


def test_keep_one_keeps_columns_and_one_row(spark):
    rows = [(2, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "y"), (None, "a b c d e f g", "z"), (4, None, "n")]
    out = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert out.columns == ["doc_id", "text", "component_id"] and sorted((r.doc_id or -1, r.component_id) for r in out.collect()) == [(-1, "z"), (1, "y"), (4, "n")]


def test_unlike_texts_of_one_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "h i j k l m n", "x"), (0, "h i j k l m n", "x"), (2, "a b c d e f g", "x"), (5, "o p q r s", "__row"), (5, "t u v w x", "__row"), (6, " ", "b"), (6, " ", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.link(df, 5, 80, 100).collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (5, 5, True), (5, 5, True), (6, 6, True), (6, 6, True)]
    out = neardup.keep_one(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6], rows[7]])


def test_equal_texts_with_other_columns_are_chosen_alike(spark):
    rows = [(3, "a b c d e f g", c, n) for c in "zbq" for n in (2, 1)]
    for parts in (1, 3, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(parts)
        assert [tuple(r) for r in neardup.keep_one(df).collect()] == [(3, "a b c d e f g", "b", 1)]


def test_thresholds_of_collisions_miss_hardly_any_pair():
    for share in (0.8, 0.85):
        for p, count in ((share, neardup.MINIMA), (share**neardup.ROWS, neardup.COORDINATES), (share**neardup.ROWS, neardup.prefix(share))):
            least = neardup.least_matches(p, count)
            below = sum(math.comb(count, i) * p**i * (1 - p) ** (count - i) for i in range(least))
            assert 1 <= least < count and (below <= neardup.MISS or least == 1)
        # Any pair with the least number of equal coordinates has one among the posted ones.
        assert neardup.COORDINATES - neardup.prefix(share) < neardup.least_collisions(share)


def test_settings_of_the_session_stay(spark):
    key, rows = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    linked(spark, corpus(4, 5), 3, 85, 100)
    assert spark.conf.get(key, None) == before and int(spark.conf.get(rows)) <= BATCH_ROWS
    # A session that asks for shorter batches keeps them.
    spark.conf.set(rows, "100")
    linked(spark, corpus(4, 5), 3, 85, 100)
    assert spark.conf.get(rows) == "100"
    spark.conf.unset(rows)


def test_one_very_long_document(spark):
    rnd = random.Random(3)
    long = [str(rnd.randrange(10**6)) for _ in range(30_000)]
    other = long[:200] + ["changed"] + long[201:]
    got = linked(spark, [(1, " ".join(long), "x"), (2, " ".join(other), "x"), (3, " ".join(long[:15_000]), "x")], 3, 85, 100)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(60)] + [(1000 + i, 2000) for i in range(50)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(61)} | {(1000 + i, 1000) for i in range(50)} | {(2000, 1000)}


def test_mark_of_many_edges(spark):
    edges, dealt = (spark.range(0, 20_000_000, 1, n).selectExpr("id + 1 as u", "id % 7 as v") for n in (4, 7))
    mark = graph._mark(edges)
    assert mark[0] == 20_000_000 and mark == graph._mark(dealt)
    assert mark != graph._mark(edges.withColumn("v", F.expr("if(u = 5, 3, v)")))


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({neardup.OP4_SQL})").fetchall())
    assert sorted(tuple(r) for r in neardup.op4_near_dedup(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()) == want
