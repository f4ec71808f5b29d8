import random

from lumenframe.llm import decontaminate as d
from tests.llm import brute


def make(seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rnd.choice([5, 6, 9, 20, 60, 300])))) for i in range(40)]
    items += [(100, "one"), (101, "two words"), (102, None), (103, "  "), (104, items[0][1]), (None, "x y z"), (105, "Aa Bb Cc Dd Ee Ff")]
    docs = []
    for i in range(150):
        w = [word() for _ in range(rnd.choice([0, 3, 50, 400]))]
        for _ in range(rnd.randint(0, 2)):
            part = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.randint(0, 3)):
                if part:
                    part[rnd.randrange(len(part))] = word()
            at = rnd.randint(0, len(w))
            w[at:at] = part
        docs.append((i, " ".join(w)))
    return docs + [(200, None), (201, ""), (202, "ONE two WORDS"), (203, "xx aa BB cc dd ee ff yy"), (0, docs[0][1])], items


def found(spark, docs, items):
    x = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    y = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    return x, y


def test_equals_brute_force(spark):
    docs, items = make()
    x, y = found(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in d.contamination(x, y).collect()}
    usable = [(i, t) for i, t in items if i is not None]
    assert got == {(i, k) for i, t in docs for k in brute.held_items(t, usable)}
    kept = d.keep_clean(x, y)
    assert kept.columns == x.columns and {r.doc_id for r in kept.collect()} == {i for i, t in docs if not brute.held_items(t, usable)}


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = make(9)
    x, y = found(spark, docs, items)
    whole = {(r.doc_id, r.item_id) for r in d.contamination(x, y).collect()}
    monkeypatch.setattr(d, "BLOCK_BYTES", 20_000)
    assert len(d._blocks(y)) > 1
    assert {(r.doc_id, r.item_id) for r in d.contamination(x, y).collect()} == whole
    assert d.keep_clean(x, y).count() == sum(1 for i, t in docs if not brute.held_items(t, [z for z in items if z[0] is not None]))


def test_empty_tables(spark):
    docs, items = make()
    x, y = found(spark, docs, items)
    assert d.contamination(x.where("false"), y).count() == 0 and d.contamination(x, y.where("false")).count() == 0
    assert d.keep_clean(x, y.where("false")).count() == len(docs)


def test_least_hits_allow_for_chance():
    for p in (24, 32, 48, 64):
        assert 1 <= d.least_hits(p, 0.8) < 0.8 * p


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i: ",".join(map(str, sorted(h))) for i, t in docs if (h := brute.held_items(t, items))}
    assert {r.doc_id: r.item_ids for r in d.op7_decontaminate(spark, sf).collect()} == want


def test_sql_finds_short_items_too(spark):
    import duckdb

    docs = [(1, "One two three four five six"), (2, "two THREE four"), (3, "x y"), (4, None), (5, "y x y z a b c d"), (6, "")]
    items = [(1, "two three four five six"), (2, "three four"), (3, "X Y"), (4, "z"), (5, "a b c d e f"), (6, ""), (7, None), (8, "q")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = {i: sorted(h) for i, t in docs if (h := brute.held_items(t, items))}
    assert {1: [1, 2], 2: [2], 3: [3], 5: [3, 4]} == want
    assert {r[0]: [int(x) for x in r[2].split(",")] for r in con.execute(d.OP7_SQL).fetchall()} == want
    x, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in d.contamination(x, y).collect():
        got.setdefault(r.doc_id, []).append(r.item_id)
    assert {k: sorted(v) for k, v in got.items()} == want
