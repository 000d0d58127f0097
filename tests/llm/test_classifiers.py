"""Language and toxicity: held-out accuracy, defined cases, no peeking at other columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storepulse.llm import langid, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    got = queries.queries()["op7_language_hierarchy"](spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    both = got.join(truth, "doc_id").filter("held_out")
    assert both.count() > 200
    assert both.filter("lang_pred = lang").count() / both.count() >= 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


@pytest.fixture(scope="module")
def speakers(spark):
    words = {"en": "the and of to in that", "de": "der und die nicht ein ist", "fr": "le et les des une dans", "es": "el y los que una por",
             "xx": "qoq zuz kek wow"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[x].split(), 30)), x) for i, x in enumerate(list(words) * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_families_then_pairs(spark, speakers):
    model = langid.fit(speakers)
    assert {f: sorted(m) for f, m in model.languages.items()} == {"germanic": ["de", "en"], "romance": ["es", "fr"], "(xx)": ["xx"]}
    # Three family pairs and one pair in each family of two.
    assert sorted((m.first, m.second) for m in model.machines) == sorted(
        [("(xx)", "germanic"), ("(xx)", "romance"), ("germanic", "romance"), ("de", "en"), ("es", "fr")])
    long = "DER UND DIE " * 40_000
    cases = [(1, None), (2, ""), (3, "123 !!"), (4, "the of and that"), (4, "the of and that"), (5, long), (6, "zuz qoq kek"), (None, "le et les une")]
    df = spark.createDataFrame([(i, t, "zz", "a", 1.0) for i, t in cases], "doc_id long, text string, lang string, Body string, row double")
    got = [(r.doc_id, r.lang_pred) for r in langid.identified(df, model).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (6, "xx"), (None, "fr")], key=repr)
    kept = langid.in_known_language(df, model)
    assert kept.columns == df.columns and kept.count() == 5 and kept.filter("lang <> 'zz' or row <> 1").count() == 0


def test_language_without_choice(spark, speakers):
    none = langid.fit(speakers.limit(0))
    assert {r.lang_pred for r in langid.identified(speakers, none).collect()} == {"und"}
    one = langid.fit(speakers.filter("lang = 'de'"))
    assert {(r.lang_pred, r.lang_score) for r in langid.identified(speakers, one).collect()} == {("de", 1.0)}
    assert langid.identified(speakers.limit(0), one).count() == 0
    unlabelled = langid.fit(speakers.withColumn("lang", F.lit(None).cast("string")))
    assert not unlabelled.languages


def test_blocks_of_a_long_text_add_up(spark, speakers, monkeypatch):
    model = langid.fit(speakers)
    text = "der und the and " * 500
    whole = model.margins(text)
    monkeypatch.setattr(langid, "BLOCK", 700)
    # Each cut adds the two trigrams of a word edge, so the means agree closely.
    assert model.margins(text) == pytest.approx(whole, rel=0.05, abs=0.02)


def test_toxicity_accuracy(spark):
    got = queries.queries()["op6_toxicity_trees"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    both = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert (both.predicted == both.toxic).mean() >= 0.93
    toxic, clean = both[both.toxic == 1].score.to_numpy(), both[both.toxic == 0].score.to_numpy()
    auc = ((toxic[:, None] > clean[None]) + 0.5 * (toxic[:, None] == clean[None])).mean()
    assert auc >= 0.8
    assert got.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


@pytest.fixture(scope="module")
def insults(spark):
    rng = np.random.default_rng(2)
    clean, bad = [f"word{i}" for i in range(200)], ["idiot", "scum", "moron"]
    rows = []
    for i in range(600):
        words = list(rng.choice(clean, 30))
        if i % 4 == 0:
            for at in rng.integers(0, 30, 4):
                words[at] = str(rng.choice(bad))
        rows.append((i, " ".join(words), i % 4 == 0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, label int")
    return docs, labels


def test_disguised_words_and_defined_cases(spark, insults):
    model = toxicity.fit(*insults)
    assert {"idiot", "scum", "moron"} <= set(model.lexicon.odds)
    bad, plain = "you 1d10t scum you MORON !! idiot, scum. m0ron", "word1 word2 word3 word4 word5 word6"
    cases = [(1, bad), (2, plain), (3, None), (4, ""), (5, plain + " " + "word7 " * 100_000), (6, plain), (6, plain), (None, bad)]
    df = spark.createDataFrame([(i, t, 0, "x", [1.0]) for i, t in cases], "doc_id long, text string, prediction int, score string, features array<double>")
    got = {}
    for r in toxicity.scored(df, model).collect():
        got.setdefault(r.doc_id, []).append(r.tox_score)
    assert min(got[1] + got[None]) > 0.5 > max(got[2] + got[3] + got[4] + got[5] + got[6]) and len(got[6]) == 2
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6, 6]


def test_toxicity_without_choice(spark, insults):
    docs, labels = insults
    assert {r.tox_score for r in toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    ones = toxicity.fit(docs, labels.filter("label = 1"))
    assert {r.tox_score for r in toxicity.scored(docs, ones).collect()} == {1.0}
    assert toxicity.scored(docs.limit(0), ones).count() == 0


def test_word_forms():
    assert toxicity.plain_word("Sc@m!!") == ("scam", True) and toxicity.plain_word('"Idiot,"') == ("idiot", False)
    assert toxicity.plain_word("1d10t") == ("idiot", True) and toxicity.plain_word("m0r0n!") == ("moron", True)
    assert toxicity.plain_word("5c4m") == ("scam", True) and not toxicity.plain_word("a1000")[1]
    assert toxicity.plain_word("2024") == ("2024", False)
    assert len(toxicity.Lexicon({}).features("a b")) == len(toxicity.FEATURES)


def test_fit_hands_the_drivers_memory_back(spark, speakers, monkeypatch):
    calls = []
    monkeypatch.setattr(langid, "let_go", lambda: calls.append(1), raising=False)
    langid.fit(speakers)
    assert calls
