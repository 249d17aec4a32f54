"""Repeated passages against a dictionary of all strings."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from evlake.llm import suffix


def plain(texts, length, keep_first):
    """Per text (already in order of place): covered bytes."""
    places = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            places[t[i : i + length]].append((d, i))
    covered = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found[1:] if keep_first else found:
                covered[d][i : i + length] = b"\1" * length
    return covered


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a, b = sorted(rng.randrange(len(s)) for _ in range(2))
            parts += [rng.choice([s, s[a:b], s[a:] + s[:b]]), text(rng.randrange(0, 12))]
        out.append(" ".join(parts))
    out += [out[3], out[3], "", None, "ab" * 300, "x" * 450, "x" * 199, "x" * 200, "abc" * 90 + "q",
            "abc" * 90, text(3000), out[5][:150] + out[6][:150]]
    return out


@pytest.mark.parametrize("seed,keep_first,bucket", [(1, False, 8 << 20), (2, True, 8 << 20), (3, False, 900), (4, True, 900)])
def test_against_all_strings(spark, seed, keep_first, bucket):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, key bigint")
    got = {r.doc_id: r for r in suffix.repeated_bytes(docs.repartition(3), keep_first=keep_first, bucket=bucket).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, c) in enumerate(zip(raw, plain(raw, 200, keep_first))):
        kept = bytes(b for b, gone in zip(t, c) if not gone)
        spans = len([x for x in bytes(c).split(b"\0") if x])
        want = (len(t), sum(c), spans, hashlib.sha256(kept).hexdigest())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    assert sum(r.n_removed for r in got.values())


def test_stage_keeps_first_copies_and_characters(spark):
    texts = corpus(5)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[2], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, c) in enumerate(zip(raw, plain(raw, 200, True))):
        if not sum(c):
            assert got[i].text == texts[i] and got[i].n_chars == rows[i][4]
        elif i in got:
            assert 0 <= len(got[i].text.encode()) - (len(t) - sum(c)) <= 6 * len(t)
            assert got[i].n_chars == len(got[i].text)
        else:
            assert sum(c) == len(t)
    assert None not in got or len(got[None].text) < len(texts[2])
    assert suffix.without_repeats(docs.limit(0)).count() == 0


def test_suffix_order():
    data = np.frombuffer(b"banana bandana " * 8 + b"ban", np.uint8)
    for length in (17, 40):
        starts = np.arange(len(data) - length + 1)
        order, same = suffix.suffix_order(data, starts, length)
        keys = [(bytes(data[s : s + length]), s) for s in starts]
        assert [keys[i] for i in order] == sorted(keys)
        assert same.tolist() == [False] + [keys[a][0] == keys[b][0] for a, b in zip(order, order[1:])]
        by_pairs = suffix.ranks(np.array([3, 1, 3]), np.array([1, 2, 1]), 1 << 30)
        assert by_pairs[0].tolist() == [1, 0, 2] and by_pairs[1].tolist() == [False, False, True]
