"""Quality, language and toxicity: held-out accuracy, edge cases, determinism."""

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import langid, quality, toxicity
from lumenframe.llm._common import doc_hash, sample_by_class

MID = "/root/testdata/sf0.01"


def words(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


ODD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "12 34 !"), (9005, "the and " * 40_000), (9005, "the and " * 40_000)]


def agreement(got, labels, label):
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in held) / len(held)


def test_quality_on_held_out_documents(spark):
    got = quality.op3_quality(spark, MID).collect()
    assert len(got) == spark.read.parquet(f"{MID}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert agreement(got, spark.read.parquet(f"{MID}/labels.parquet"), "quality") >= 0.95


def test_quality_edges(spark):
    rnd = random.Random(1)
    good = [(i, words(rnd, ["er", "on", "th", "a"], 60), 1) for i in range(120)]
    bad = [(200 + i, words(rnd, ["er", "on", "th", "a"], 60).replace(" ", "$$ "), 0) for i in range(120)]
    docs = spark.createDataFrame([(i, t, 0.5, False) for i, t, _ in good + bad] + [(i, t, 0.5, False) for i, t in ODD] + [(None, "er on", 0.5, True)], "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(7, None), (None, 1), (8, 5)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 247 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert all(by[i] > 0.5 for i, _, _ in good) and all(by[i] < 0.5 for i, _, _ in bad)
    assert by[9001] == by[9002] == by[9003]
    again = quality.score(docs, quality.fit(docs, labels)).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score >= 0.3}
    assert quality.score(docs, quality.fit(docs, labels.where("false"))).first().score == pytest.approx(0.5)
    assert quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).first().score > 0.99
    assert quality.score(docs.where("false"), model).count() == 0


def test_quality_word_sums_follow_the_definition():
    rnd = random.Random(2)
    texts = [words(rnd, ["er", "on"], 30) for _ in range(40)] + [words(rnd, ["er", "on"], 30).upper() for _ in range(40)]
    m = quality.SubwordModel.fit(texts, [1] * 40 + [0] * 40, [1.0] * 80)
    text = "er er onon"
    total, count = 0.0, 0
    for w in text.split():
        where, bucket = quality.word_features([w])
        total += float(m.margin[bucket].astype(float).sum())
        count += len(bucket)
    total += quality.PAIR * (m.margin[quality.BUCKETS + 1] + m.margin[quality.BUCKETS])
    margin = m.bias + total / (count + 2 * quality.PAIR + quality.PRIOR)
    assert quality.Scorer(m).scores([text])[0] == pytest.approx(1 / (1 + 2.718281828459045 ** -margin), abs=1e-6)


def test_language_on_held_out_documents(spark):
    got = langid.op5_language_id(spark, MID).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(truth) and sum(held) / len(held) >= 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rnd = random.Random(3)
    rows = [(i, words(rnd, ["er", "on", "th"], 40), "en") for i in range(60)] + [(100 + i, words(rnd, ["sch", "ung", "ä"], 40), "de") for i in range(60)] + [(300, "er on th", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows] + [(i, t, None, 1.0) for i, t in ODD], "doc_id long, text string, lang string, score double")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang) and got[300].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (9001, 9002, 9003, 9004)) and got[9005].lang_pred in ("en", "de")
    assert langid.identify(docs, langid.fit(docs.where("false"))).first().lang_pred == "und"
    assert langid.identify(docs.where("false"), model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.where("lang = 'de'"))).collect()} == {"de", "und"}


def test_language_kernel_is_the_cosine_of_gram_sets():
    texts = ["er on the er", "ung sch äü", "on the shore", "schon ung"]
    m = langid.KernelModel.fit(texts, ["en", "de", "en", "de"])
    def grams(t):
        raw = langid.plain(t)
        return {raw[i : i + n] for n in langid.GRAMS for i in range(len(raw) - n + 1)}
    order = [texts[1], texts[3], texts[0], texts[2]]
    got = m.kernel([langid.plain(t) for t in texts])
    for i, a in enumerate(texts):
        for j, b in enumerate(order):
            x, y = grams(a), grams(b)
            assert got[i, j] == pytest.approx(len(x & y) / (len(x) * len(y)) ** 0.5, abs=1e-5)


def test_language_kernel_holds_every_gram_of_every_landmark():
    rnd = random.Random(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    texts = ["".join(rnd.choice(letters) for _ in range(900)) for _ in range(20)] + ["ñandú ýþð", "þð ýñ"]
    m = langid.KernelModel.fit(texts, ["aa"] * 20 + ["rare"] * 2)
    def grams(t):
        raw = langid.plain(t)
        return {raw[i : i + n] for n in langid.GRAMS for i in range(len(raw) - n + 1)}
    sets = [grams(t) for t in texts]
    assert len(set().union(*sets)) > 8192
    tried = [*texts, "ñandú þor", "x" * 50 + "一二三"]
    got = m.kernel([langid.plain(t) for t in tried])
    for i, t in enumerate(tried):
        x = grams(t)
        for j, y in enumerate(sets):
            assert got[i, j] == pytest.approx(len(x & y) / (len(x) * len(y)) ** 0.5, abs=1e-5)
    assert m.predict(["ýþ ñú"])[0] == ["rare"]


def test_toxicity_on_held_out_documents(spark):
    got = toxicity.op8_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    assert agreement(got, labels, "toxic") >= 0.97
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    wrong = [r for r in got if r.doc_id in clean and r.predicted]
    assert len(wrong) <= 0.003 * len(clean)


def test_toxicity_grammar():
    lex = toxicity.Lexicon({b"idiot": 4.0, b"scumb*": 3.0})
    weigh = lambda t: sum(w for _, w in lex.matches(t))
    kinds = lambda t: [k for k, _ in lex.matches(t)]
    plain = weigh("an idiot here")
    assert plain == 4.0 and kinds("an idiot here") == [toxicity.PLAIN]
    # A word that stands alone is no clause.
    assert weigh("idiot") == weigh("Idiot.") == weigh("“idiot”") == weigh("well: idiot; no") == 0
    assert kinds("you are an idiot") == kinds("idiot that you are") == [toxicity.DIRECT] and kinds("idiot idiot") == [toxicity.COMPOUND]
    assert kinds("idiot of a man with no thing for them") == [toxicity.PLAIN]
    assert weigh("you are an idiot") > plain > weigh("she is not an idiot") > 0
    assert weigh("he said she was an idiot") < weigh("she was an idiot")
    assert weigh("he said so. she was an idiot") == weigh("she was an idiot")
    assert weigh("idiot idiot") > plain and weigh("you scumbag") > 3.0 and weigh("scum idiotic") == 0
    assert weigh("i will kill") == 0 and kinds("i tell you i will kill") == [toxicity.MENACE] and weigh("never you kill") < weigh("tell you kill")
    assert kinds("you idiot! an idiot here. idiot") == [toxicity.DIRECT, toxicity.PLAIN]
    assert lex.matches(None) == lex.matches("") == lex.matches("nothing here") == []


def test_composition_multiplies_factors():
    a = toxicity.negation().then(toxicity.targets())
    state, factor = a.start, 1.0
    for s in (toxicity.TARGET_, toxicity.NEGATION_, toxicity.INSULT):
        state, _, f = a.step(state, s)
        factor *= f
    assert factor == pytest.approx(0.3 * 1.25)
    table, ends = a.compiled(7, lambda last: last)
    assert all(0 <= to < len(table) for row in table for to, _, _ in row) and len(ends) == len(table) and set(ends) == set(range(5))


def test_a_word_alone_scores_as_clean(spark):
    rnd = random.Random(13)
    text = lambda word: words(rnd, ["er", "on", "th"], 8) + word + words(rnd, ["er", "on"], 5)
    docs = spark.createDataFrame([(i, text(" foo " if i < 150 else " ")) for i in range(600)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i < 150)) for i in range(600)], "doc_id long, toxic int"))
    assert b"foo" in model.lexicon.insult
    assert model.score("foo") == model.score("foo.") == model.score("er on") < 0.3
    # What a clause says is learned: here plain clauses are toxic, and directed ones no less.
    assert 0.7 < model.score("er on foo th") <= model.score("you are foo th er")


def test_toxicity_edges(spark):
    rnd = random.Random(4)
    clean = [(i, words(rnd, ["er", "on", "th", "a"], 30)) for i in range(300)]
    toxic = [(1000 + i, words(rnd, ["er", "on"], 10) + " zorgal" + rnd.choice(["en", "ig", "isch"]) + " " + words(rnd, ["er", "on"], 10)) for i in range(80)]
    docs = spark.createDataFrame([(*r, 0.1) for r in clean + toxic] + [(i, t, 0.1) for i, t in ODD] + [(2000, "er zorgalum on", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(got[i] < 0.3 for i, _ in clean) and all(got[i] > 0.7 for i, _ in toxic) and got[2000] > 0.7
    assert got[9001] == got[9002] == got[9003] == got[9005] < 0.3
    none = toxicity.fit(docs, labels.where("false"))
    assert none.lexicon.insult == {} and none.score(None) < 0.3 < none.score("you we will kill you " * 3)
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_stems_that_one_word_explains_are_dropped():
    assert toxicity.without_idle_stems({b"trash": (100, 5.0), b"tras*": (100, 5.0), b"zor*": (90, 4.0), b"zorx": (30, 4.0)}) == {b"trash": 5.0, b"zor*": 4.0, b"zorx": 4.0}


def test_sampling_by_class_is_bounded_and_stable(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    picked = sample_by_class(df, "y", 300)
    assert {r.y: r["count"] for r in picked.groupBy("y").count().collect()} == {0: 300, 1: 300}
    assert sorted(r[0] for r in picked.collect()) == sorted(r[0] for r in sample_by_class(df.repartition(7), "y", 300).collect())


def test_every_class_is_sampled_however_many_there_are(spark):
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("k"), F.col("id") % 3000)).alias("y"))
    picked = sample_by_class(df, "y", 250, total=1000).groupBy("y").count().collect()
    assert len(picked) == df.select("y").distinct().count() > 2000 and {r["count"] for r in picked} == {1}


def test_split_hash_is_crc32_of_the_decimal_id(spark):
    import zlib

    assert [r[0] for r in spark.range(50).select(doc_hash("id")).collect()] == [zlib.crc32(str(i).encode()) for i in range(50)]


def test_toxicity_odds_do_not_depend_on_thinning(spark):
    rnd = random.Random(12)
    texts = [words(rnd, ["er", "on", "th", "la"], 12) + (" scumface" if i < 1000 and i % 5 < 3 else "") for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in range(5000)], "doc_id long, toxic int")
    whole, thinned = (toxicity.fit(docs, labels, sample=n) for n in (20_000, 500))
    assert b"scumface" in thinned.lexicon.insult
    assert thinned.score("er on th la") == pytest.approx(whole.score("er on th la"), abs=0.06)
    assert whole.score("er on th la") < 0.12
