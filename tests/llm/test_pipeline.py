"""The pipeline's stages over a small table, each against its own input."""

import os
import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        rows[name] = (docs.collect(), out.collect())
        docs = out
    before, after = rows["language_id"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > 0.97 * len(before)
    before, after = rows["near_dedup"]
    texts = {}
    for r in before:
        texts.setdefault(r.text, []).append(r.doc_id)
    kept = {r.doc_id for r in after}
    assert len(kept) == len(after) and all(len(kept & set(ids)) <= 1 for ids in texts.values())
    before, after = rows["passage_dedup"]
    assert all(r.n_chars == len(r.text) for r in after)
    seen = set()
    for r in sorted(after, key=lambda r: r.doc_id):
        data = r.text.encode()
        strings = {data[i : i + 400] for i in range(0, len(data) - 399)}
        assert not seen & strings
        seen |= strings
    before, after = rows["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = rows["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)


def test_passages_of_200_bytes_go(spark):
    """A passage just over the promised length is kept once; one just below, blanks around it included, stays everywhere."""
    rng = random.Random(3)
    over, under = " ".join(words(rng, 80))[:202], " ".join(words(rng, 80))[:196]
    texts = [" ".join([*words(rng, 60), over if i < 3 else under, *words(rng, 60)]) for i in range(6)]
    out = corpus_pipeline.passage_dedup(spark, frame(spark, texts), SF).collect()
    assert [sum(p in r.text for r in out) for p in (over, under)] == [1, 3]
    assert over in min(out, key=lambda r: r.doc_id).text and len(out) == 6


def test_near_copies_at_the_threshold_go(spark):
    """One of each pair at 0.8 or just above by five-word shingles; both at 0.75 and below."""
    rng = random.Random(4)
    texts, shares = [], []

    def shingles(ws):
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}

    while len(texts) < 80:
        base = words(rng, 300)
        copy = list(base)
        for at in rng.sample(range(10, 290), rng.choice([6, 7, 9, 10])):
            copy[at] = "changed" + str(rng.randrange(10**6))
        a, b = shingles(base), shingles(copy)
        share = len(a & b) / len(a | b)
        if 0.8 <= share < 0.84 or share < 0.75:
            texts += [" ".join(base), " ".join(copy)]
            shares.append(share)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), SF).collect()}
    for i, share in enumerate(shares):
        assert len(kept & {2 * i, 2 * i + 1}) == (1 if share >= 0.8 else 2), share
    assert {s >= 0.8 for s in shares} == {True, False}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
