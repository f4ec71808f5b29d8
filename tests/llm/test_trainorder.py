import json

import numpy as np
import pytest
from xxhash import xxh3_64_hexdigest

from lumenframe.llm import trainorder as t
from lumenframe.llm._common import Scratch


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 65_537, 100_000])
def test_feistel_is_a_permutation_with_an_inverse(size):
    f = t.Feistel(size, 42)
    x = np.arange(size)
    s = f.slot(x)
    assert np.array_equal(np.sort(s), x) and np.array_equal(f.number(s), x)
    if size > 100:
        assert abs(np.corrcoef(x, s)[0, 1]) < 0.15 and not np.array_equal(s, t.Feistel(size, 43).slot(x))


def brute(rows, length):
    enc = t.tokenizer(t.tokenizer_path())
    out = []
    for d, text in rows:
        ids = enc.encode_ordinary(text or "")
        out += [(-1 if d is None else d, k // length, ids[k : k + length]) for k in range(0, len(ids), length)]
    return out


def test_shards_hold_every_sequence_once_at_its_slot(spark):
    rows = [(i, ("word%d " % i) * (i * 7 % 90)) for i in range(120)] + [(500, None), (501, ""), (7, "again"), (7, "again"), (None, "x y"), (502, "long \n" * 4000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int").repartition(5)
    written = t.materialise(docs, Scratch(spark, "t").path("o"), length=16, per_shard=50)
    want = brute(rows, 16)
    assert written.size == len(want)
    records = written.read(0, written.size)
    assert sorted((r["doc_id"], r["part"], r["ids"][: r["n"]].tolist()) for r in records) == sorted(want)
    assert (records["end"] == 10).all() and all((r["ids"][r["n"] :] == t.PAD).all() for r in records)
    index = sorted(tuple(r) for r in written.index().collect())
    assert [r[0] for r in index] == list(range(written.size)) and all(r[1] == r[0] // 50 and r[2] == r[0] % 50 * written.stride for r in index)
    assert [(r[3], r[4], r[5]) for r in index] == [(r["doc_id"], r["part"], r["n"]) for r in records]
    assert [r[6] for r in index] == [xxh3_64_hexdigest(r["ids"][: r["n"]].tobytes()) for r in records]
    resumed = written.read(written.size - 70, 1000)
    assert np.array_equal(resumed, records[-70:])
    about = json.loads(spark.read.text(f"{written.path}/manifest").first()[0])
    assert about["sequences"] == written.size and about["stride"] == written.stride == 8 + 4 + 4 + 32 + 1
    assert np.array_equal(t.Written.open(spark, written.path).read(0, 10), records[:10])


def test_names_of_shards_have_any_number_of_digits():
    assert t.shard_of("file:/x/part-00003-ab-c001.txt", 32) == 97
    assert t.shard_of("part-100000-5f-c000.txt", 1) == 100_000
    assert t.shard_of("part-1234567-5f-11-c1024.txt", 2000) == 1_234_567 * 2000 + 1024


def test_ranges_hold_many_shards(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j k l m n o p " * 9) for i in range(400)], "doc_id long, text string").coalesce(2)
    written = t.materialise(docs, Scratch(spark, "t").path("o"), length=8, per_shard=20)
    assert written.per_range > 1 and len(written._files()[1]) == -(-written.size // 20)
    assert sorted(r.slot for r in written.index().collect()) == list(range(written.size))
    assert [(r["doc_id"], r["part"]) for r in written.read(35, 50)] == [(r.doc_id, r.part) for r in written.index().where("slot between 35 and 84").orderBy("slot").collect()]
    assert all(r.byte_offset == r.slot % 20 * written.stride and r.shard == r.slot // 20 for r in written.index().collect())


def test_a_large_vocabulary_has_wider_ids():
    assert t.record_type(16, 4).itemsize == 16 + 64 + 1 and t.record_type(16).itemsize == 16 + 32 + 1


def test_settings_and_splits_stay(spark):
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    with t._same_splits(spark):
        assert spark.conf.get(key) == str(spark.sparkContext.defaultParallelism)
    assert spark.conf.get(key, None) == before


def test_text_of_a_control_token_stays_text(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    ids = t.materialise(docs, Scratch(spark, "t").path("o"), length=16).read(0, 1)[0]
    enc = t.tokenizer(t.tokenizer_path())
    assert enc.decode(ids["ids"][: ids["n"]].tolist()) == "a <|endoftext|> b" and ids["n"] > 3


def test_order_depends_on_the_key_alone(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    one, two, other = (t.materialise(docs, Scratch(spark, "t").path("o"), key=k, length=8).read(0, 10_000) for k in (1, 1, 2))
    assert np.array_equal(one, two) and not np.array_equal(one["doc_id"], other["doc_id"])


def test_no_sequences(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    written = t.materialise(docs, Scratch(spark, "t").path("o"))
    assert written.size == 0 and written.index().count() == 0 and len(written.read(0, 5)) == 0
    assert t.materialise(docs.where("false"), Scratch(spark, "t").path("o")).size == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, k, len(ids), xxh3_64_hexdigest(np.array(ids, "<u2").tobytes())) for d, k, ids in brute(rows, t.LENGTH))
    got = t.op10_training_order(spark, sf).collect()
    assert sorted((r.doc_id, r.part, r.n_tokens, r.ids_xxh3) for r in got) == want
    assert sorted(r.slot for r in got) == list(range(len(want)))
