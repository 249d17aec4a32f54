"""The learnt operators: held-out accuracy, edge cases, and their parts."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evlake.llm import language, toxicity
from evlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, Score string"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


LANGS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "en", "ung", "ü"], "cc": ["é", "eau", "oi", "tre"]}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(LANGS))
        rows.append((i, words(rng, LANGS[lang], rng.randrange(3, 80)), lang, "s", "x"))
    return rows


def test_language_of_new_texts(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    model = language.fit(docs, F.col("doc_id") % 2 == 0)
    extra = [(900, None, None, None, None), (901, "", None, None, None), (902, "12 %% \n", "aa", None, None),
             (None, "kalomi tuka", None, None, None), (903, "schenung " * 60000, "bb", None, None), (904, "K", None, None, None)]
    out = language.predict(spark.createDataFrame(corpus + extra, DOCS), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "rejected"]
    got = out.collect()
    right = [r.lang == r.lang_pred for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 2]
    assert np.mean(right) > 0.98
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in LANGS
    assert [r.lang_pred for r in got if r.doc_id in (None, 903)] == ["aa", "bb"]
    clean = [r.rejected for r in got if r.doc_id is not None and r.doc_id < 300]
    assert np.mean(clean) < 0.02


def test_language_without_anything_to_learn(spark, corpus):
    docs = spark.createDataFrame(corpus[:5], DOCS)
    model = language.fit(docs.limit(0), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, model).collect()} == {("und", 0.0)}


def test_subword_blocks_agree(monkeypatch):
    rng = random.Random(5)
    texts = [language.letters(words(rng, LANGS["cc"], 200)) for _ in range(5)]
    weights = np.random.default_rng(1).normal(size=(language.BUCKETS, 2)).astype(np.float32)
    model = language.LanguageModel(["a", "b"], weights, np.zeros(2), 1.0, 0.0)
    whole = language.raw_scores(texts, model)
    monkeypatch.setattr(language, "BLOCK", 97)
    assert np.allclose(language.raw_scores(texts, model), whole)


@needs_data
def test_language_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op7_language"](spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_toxicity_learns_from_positives(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        text, toxic = words(rng, LANGS["aa"] + LANGS["cc"], rng.randrange(20, 60)).split(), i % 9 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vilest", "rotten", "wretch"]))
        docs.append((i, " ".join(text), "l", "s", "x"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs += [(2000, None, None, None, None), (None, "", None, None, None), (2001, "rotten " * 100000, None, None, None)]
    labels += [(None, 1, 1), (5, 1, None), (77777, 0, 1)]
    frame = spark.createDataFrame(docs, DOCS)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(frame, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(frame.drop("Score"), model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    called = [(got[i] >= 0.5) == (i % 9 == 0) for i in range(0, 900, 5)]
    assert np.mean(called) > 0.95
    assert got[2000] == got[None] < 0.5
    none = toxicity.fit(frame, marks.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(frame.limit(3), none).collect()} == {0.0}
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_word_beginnings_in_blocks(monkeypatch):
    flags = np.zeros(1 << toxicity.BITS, dtype=bool)
    text = words(random.Random(7), LANGS["bb"], 300)
    whole = toxicity.distinct(text, flags)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    assert (toxicity.distinct(text, flags) == whole).all() and not flags.any()
    assert len(toxicity.distinct("", flags)) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 10, 40])
def test_few_positives_call_no_clean_text(spark, n):
    """Positives without anything in common, or too few of them, make nothing toxic."""
    rng = random.Random(n)
    docs = [(i, words(rng, LANGS["aa"] + LANGS["cc"], rng.randrange(0, 60)), "l", "s", "x") for i in range(400)]
    docs += [(1000, "", None, None, None), (1001, None, None, None, None)]
    frame = spark.createDataFrame(docs, DOCS)
    marks = spark.createDataFrame([(i, 1, int(i < n)) for i in range(100)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(frame, marks, F.lit(True))
    scores = [r.Score2 for r in toxicity.score(frame, model, name="Score2").collect()]
    assert len(scores) == 402 and max(scores) < 0.5


@needs_data
@pytest.mark.parametrize("sf, recall, clean", [("0.01", 0.5, 0.95), ("0.1", 0.85, 0.98)])
def test_toxicity_query(spark, sf, recall, clean):
    labels = spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, f"/root/testdata/sf{sf}").join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted for r in got if r.toxic]) >= recall
    assert np.mean([not r.predicted for r in got if not r.toxic]) >= clean
