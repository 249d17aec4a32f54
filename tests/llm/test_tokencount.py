"""Token counts against the library's own encoding of whole texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evlake.llm import tokencount
from evlake.llm.queries import QUERIES, piece_model_path

TEXTS = [
    None, "", " ", "▁", "\n", "  a  b ", "Hello, world!", "a<s>b</s> <unk> <0x41>", "été à la fin", "日本語 text 😀", "nul\x00in",
    "tab\t\tnew\r\n line", "x" * 5000, "word " * 40000, "\n" * 3000, "▁▁x ▁y", ">\r>\r", "a  b   c    d     e",
]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_model_path())


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(piece_model_path())


def test_given_texts(library, counter):
    rng = random.Random(1)
    letters = "abcthe XYZ  \n\t\r▁<s>é😀\x000'"
    for text in [t or "" for t in TEXTS] + ["".join(rng.choices(letters, k=rng.randrange(90))) for _ in range(3000)]:
        assert counter.count(text) == len(library.encode(text)), repr(text[:60])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, counter, text):
    assert counter.count(text) == len(library.encode(text))


def test_whole_tokens_are_proved(library, counter):
    """Every proved piece stays one token between other pre-tokens."""
    rng = random.Random(2)
    assert 30000 < len(counter.proved) <= library.get_piece_size()
    for piece in rng.sample(sorted(counter.proved), 500):
        assert library.encode("x\n" + piece + "\n y", out_type=str)[2] == piece


def test_forgetting_changes_nothing(library, counter, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 10)
    monkeypatch.setattr(tokencount, "AT_ONCE", 50)
    text = "Some words, again and again.\n\nunusualwords " * 40
    assert counter.count(text) == counter.count(text) == len(library.encode(text))


def test_rows(spark, library):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(TEXTS + TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, N_TOKENS string").repartition(3)
    got = tokencount.count_tokens(docs, piece_model_path(), limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert got[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    assert tokencount.count_tokens(docs.limit(0), piece_model_path()).count() == 0
    with pytest.raises(ValueError):
        tokencount.count_tokens(docs, piece_model_path(), keep=("n_tokens",))
    column = docs.select(tokencount.token_count(F.col("text"), piece_model_path()).alias("n")).collect()
    assert sorted(r.n for r in column) == sorted(w[2] for w in want)


def test_query_against_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op12_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_a_model_that_rewrites_texts_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(piece_model_path(), "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="rewrites texts"):
        tokencount.vocabulary(str(path))
