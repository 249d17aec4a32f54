"""Packing: tokens against the tokenizer itself, places against the contract."""

import itertools
import random
import zlib

import numpy as np
import pytest

from evlake.llm import packing
from evlake.llm.queries import tokenizer_path

TEXTS = [
    None, "", " ", "Hello, world!", "it's we'll  I'M\n\n\n x", "a" * 5000, "été à la fin ½ ² 3.14", "日本語 text", "a b c",
    "x<|endoftext|>y", "tab\t\tnew\r\nline \x0b\x0c", "emoji 😀 mixed", "'s 't ''s", "  lead", "trail  ", "ß ÿ ª º µ × ÷",
    "\x1c\x1f control", "word " * 3000, "\n" * 50 + "end", "a  b   c    d",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    letters = "abcXYZ 's.,\n\t09é½-<|>"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(300)) for _ in range(100)]
    encoder = packing.Encoder(tokenizer_path())
    for text in texts:
        want = packing.packed(tokenizer.encode(text, add_special_tokens=False).ids)
        assert b"".join(encoder.blocks(text)) == want, text[:50]


def test_blocks_of_a_long_text(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 100)
    rng = random.Random(2)
    text = "".join(rng.choice("ab é.\n 1'") for _ in range(5000)) + " done " * 50
    encoder = packing.Encoder(tokenizer_path())
    blocks = list(encoder.blocks(text))
    assert len(blocks) > 5
    assert b"".join(blocks) == packing.packed(tokenizer.encode(text, add_special_tokens=False).ids)


def test_fill_is_closest_to_capacity():
    rng = random.Random(3)
    for _ in range(200):
        lengths = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        capacity = rng.randrange(1, 60)
        items = [k for k, n in lengths.items() for _ in range(n)]
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n)
                   if (s := sum(c)) <= capacity)
        chosen = packing.fill(lengths, capacity)
        assert sum(chosen) == best
        assert all(chosen.count(k) <= lengths[k] for k in chosen)


@pytest.mark.parametrize("pool", [4096, 4])
def test_pieces(spark, tokenizer, pool):
    texts = TEXTS + [f"more {i} " * (i % 90) for i in range(120)] + ["same one"] * 30
    rows = [(i if i % 17 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, offset int").repartition(3)
    got = packing.pack(docs, tokenizer_path(), pool=pool).collect()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append(r)
    for pieces in places.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 1024 or (at & (at - 1)) == 0 and at < 1024
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        if i is not None:
            ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0
