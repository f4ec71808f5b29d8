"""Every stage against brute force, on its own input."""

import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lumenframe.llm import bpe, pii, quality
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_drops_what_the_model_rejects(spark, sf, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = quality.Scorer(model)
    all_ = texts(stages[0])
    assert set(texts(stages[1])) == {d for d, t in all_.items() if scorer.scores([t])[0] >= 0.3}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = set(texts(stages[1]))
    assert sum(d in kept for d, q in truth.items() if q == 1) >= 0.98 * sum(truth.values())


def test_one_of_each_group_stays(stages):
    before = texts(stages[1])
    roots = brute.near_groups(list(before.items()), 5, 80, 100)
    assert set(texts(stages[2])) == set(roots.values())


def test_benchmark_passages_go(spark, sf, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(texts(stages[3])) == {d for d, t in texts(stages[2]).items() if not brute.held_items(t, items)}


def test_personal_data_is_replaced(stages):
    before, after = texts(stages[3]), texts(stages[4])
    fitted = pii.model()
    assert after == {d: pii.redact(t, pii.find_spans([t], fitted)[0][1]) for d, t in before.items()}
    assert not any(brute.personal(t) for t in after.values())
    assert all(r.n_chars == len(r.text) for r in stages[4].collect() if r.text is not None)


def test_tokens(stages):
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    after = texts(stages[4])
    got = stages[5].collect()
    assert len(got) == len(after)
    for r in got:
        ids = lib.encode(after[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run_equals_the_stages(spark, sf, stages):
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, stages[5].collect()))


def test_odd_tables(spark, sf, tmp_path):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (4, "x@y.zz " * 3, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.where("false"), odd.withColumn("score", odd.doc_id).withColumn("kept", odd.text)):
        for i, (name, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{name}{len(docs.columns)}{docs.count()}{i}")
            columns = docs.columns
            stage(spark, docs, sf).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "bpe" or docs.columns == columns


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(e.oracle_sql()) <= set(names)
