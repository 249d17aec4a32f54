"""Alignment against whole-text encodings and plain counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from evlake.llm import alignment, packing
from evlake.llm.queries import QUERIES, piece_model_path, tokenizer_path

TEXTS = [
    None, "", " ", "\n", "Hello, world! it's 3.14", "  two  spaces \n\n  lines\n", "été à la fin", "日本語 text 😀", "a▁b", "\x1c\x1f x",
    "odd space   here ", "<s>a</s> <|endoftext|> <0x41>", "x" * 3000, "word " * 3000, "tab\tand\r\nmore\r", "trail ", " ", "nul\x00",
    "é̂ combining", "a  ", "  a b",
]


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=piece_model_path())


def whole(models, text):
    """(A ids, B ids, groups, links) of a text, from the definition; None without tokens."""
    if not text:
        return None
    a_model, b_model = models
    symbols = packing.byte_symbols()
    a = a_model.encode(" " + text, add_special_tokens=False).ids
    b = b_model.encode(text)
    bytes_a = [bytes(symbols[c] for c in a_model.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(b_model.id_to_piece(i)[1:-1], 16)]) if b_model.is_byte(i)
               else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    groups, i, j = [], 0, 0
    for end in both:
        m, n = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        groups.append((a[i:m], b[j:n]))
        i, j = m, n
    links = []
    j0 = 0
    for i, (e, x) in enumerate(zip(ends_a, bytes_a)):
        start = e - len(x)
        while ends_b[j0] <= start:
            j0 += 1
        j = j0
        while j < len(b) and ends_b[j] - len(bytes_b[j]) < e:
            links.append((a[i], b[j]))
            j += 1
    return a, b, groups, links


def expected(models, rows):
    found = {t: whole(models, t) for t in {t for _, t in rows}}
    counts = Counter(link for _, t in rows if found[t] for link in found[t][3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc_id, text in rows:
        if found[text] is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = found[text]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[link] == most[link[1]] for link in links)
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links),
                    hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def random_texts(n):
    rng = random.Random(4)
    letters = "abcthe XYZ  \n\t\r <s>é😀0'. \x1c"
    words = ["the", " house", "ing", "Ünder", "\n", " ", "  ", "(x)", "don't", "12,5", "\t", "été", "　", "end."]
    return ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(n)] + [
        "".join(rng.choices(words, k=rng.randrange(40))) for _ in range(n)]


def test_chunks_are_independent(models):
    aligner = alignment.Aligner(tokenizer_path(), piece_model_path())
    for text in [t for t in TEXTS + random_texts(1500) if alignment.has_tokens(t)]:
        chunks = [c for part in aligner.chunks(text) for c in part]
        assert "".join(chunks) == " " + text
        found = aligner.align(chunks)
        a, b, groups, links = whole(models, text)
        assert found.numbers.sum(axis=0).tolist() == [len(a), len(b), len(groups), len(links)], repr(text[:60])
        assert [(p >> 32, p & 0xFFFFFFFF) for p in found.pairs.tolist()] == links, repr(text[:60])
        assert "".join(found.groups) == "".join(
            ",".join(map(str, x)) + "|" + ",".join(map(str, y)) + ";" for x, y in groups)


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50000):
        keys = np.unique(rng.integers(0, 1 << 48, n))
        table = alignment.PerfectHash.restored(*alignment.PerfectHash.over(keys).stored())
        assert table.n == len(keys)
        assert sorted(table.of(keys).tolist()) == list(range(len(keys)))
        bits = sum(table.sizes)
        assert bits <= 4.5 * len(keys) + 10


@pytest.mark.parametrize("small", [False, True])
def test_rows(spark, models, monkeypatch, small):
    """Also with rounds of a bucket each, chunks forgotten all the time, tables that grow and trees of
    several levels."""
    if small:
        monkeypatch.setattr(alignment, "ROWS", 2)
        monkeypatch.setattr(alignment, "REMEMBERED", 500)
        monkeypatch.setattr(alignment, "AT_ONCE", 100)
        monkeypatch.setattr(alignment, "HELD", 50)
        monkeypatch.setattr(alignment, "FAN", 2)
        monkeypatch.setattr(alignment, "BUCKETS", 4)
    texts = TEXTS + random_texts(30) + ["the same words", "the same words"]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, N_A string, pair int").repartition(5)
    got = alignment.align(docs, tokenizer_path(), piece_model_path(), round_bytes=1 if small else alignment.ROUND)
    assert found(got) == expected(models, rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert found(alignment.align(docs.limit(0), tokenizer_path(), piece_model_path())) == []
    assert [r[1:] for r in found(alignment.align(docs, tokenizer_path(), piece_model_path()))] == [(0,) * 6 + ("",)] * 2


def test_query(spark, models):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(QUERIES["op11_alignment"](spark, sf_dir)) == expected(models, rows)
