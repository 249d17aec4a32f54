"""SimHash groups against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from evlake.llm import simhash
from evlake.llm.components import components, forest


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {v: find(v) for v in values}


def clusters(n, seed):
    """Values in chains and clouds around a few centres, and apart from each other."""
    rng = random.Random(seed)
    values = {0, (1 << 64) - 1}
    while len(values) < n:
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(rng.choice([0, 0, 1, 3, 40])):
            y = x
            for _ in range(rng.randrange(1, 8)):
                y ^= 1 << rng.randrange(64)
            values.add(y)
            if rng.random() < 0.3:
                x = y
    return sorted(values)


@pytest.mark.parametrize("tile", [2048, 7])
def test_links_have_the_components_of_all_pairs(spark, tile):
    values = clusters(700, tile)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = components(simhash.links(prints, "fp", ["fp"], 4, simhash.tables_of(4), tile)).collect()
    got = {v: v for v in signed} | {r.node: r.root for r in found}
    want = plain_components(values, 4)
    ours, theirs = {}, {}
    for s, v in zip(signed, values):
        ours.setdefault(got[s], set()).add(v)
        theirs.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_bit_slices_count_differences(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    for i in range(0, 150, 3):
        a[i] = a[i // 2] ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, radius + 1)))
    want = plain_components([int(x) for x in a], radius)
    one, rows = np.zeros(len(a), int), a[:, None]
    for links in (simhash.sparse_links(a, rows, one, radius), simhash.dense_links(a, rows, a, rows, radius)):
        forests = list(links)
        u = np.concatenate([x for x, _ in forests] or [a[:0]])
        v = np.concatenate([x for _, x in forests] or [a[:0]])
        got = {int(x): int(x) for x in a}
        got |= {int(x): int(y) for x, y in zip(*forest(u, v))}
        assert got == want


def test_wide_fingerprints_of_similar_texts(spark):
    """Copies at a similarity over 0.85 go, texts under 0.5 stay, for short and long texts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, original, doc = [], [], 0
    for n in (60, 120, 400, 1000):
        for _ in range(6):
            words = [word() for _ in range(n)]
            original.append(doc)
            rows.append((doc, " ".join(words)))
            for _ in range(3):
                copy = list(words)
                for _ in range(max(1, n // 100)):
                    copy[rng.randrange(n)] = word()
                doc += 1
                rows.append((doc, " ".join(copy)))
            half = words[: n // 2] + [word() for _ in range(n // 2)]
            doc += 1
            original.append(doc)
            rows.append((doc, " ".join(half)))
            doc += 1
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = {r.doc_id for r in simhash.first_of_groups(frame).collect()}
    assert set(original) <= kept
    assert len(kept) - len(original) <= 2


@pytest.mark.parametrize("tile", [2048, 9])
def test_wide_links_are_those_of_the_tables(spark, tile):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, (150, 2)).astype(np.uint64)
    for i in range(1, 150, 2):
        values[i] = values[i - 1]
        for b in rng.integers(0, 128, 14).tolist():
            values[i, b // 64] ^= np.uint64(1 << b % 64)
    masks = simhash.random_tables(2, 6, 5)
    rows = [(i, *[int(x) for x in v.view(np.int64)]) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "node bigint, a bigint, b bigint")
    got = {r.node: r.root for r in components(simhash.links(frame, "node", ["a", "b"], 40, masks, tile)).collect()}
    parent = list(range(150))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(150):
        for j in range(i):
            meets = any(all(int(values[i, w] ^ values[j, w]) & (m & (2**64 - 1)) == 0 for w, m in enumerate(t)) for t in masks)
            if meets and sum(bin(int(values[i, w] ^ values[j, w])).count("1") for w in (0, 1)) <= 40:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert got == {i: find(i) for i in range(150) if find(i) != i}


def of_sets(pairs, seed=12):
    """Texts of one to one shingles of five words: a pair of them per (size, shared) at a similarity of
    shared / (2 size - shared), by edits at a distance of five words and at the end."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    for size, apart in pairs:
        words = [word() for _ in range(size + 4)]
        copy = list(words)
        for i in range(apart // 5):
            copy[4 + i * 10] = word()
        for i in range(apart % 5):
            copy[-1 - i] = word()
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    return rows


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(" "), b.split(" ")))
    return len(x & y) / len(x | y)


def test_every_lone_pair_at_the_threshold_is_found(spark):
    """Pairs at a similarity of 0.80 to 0.81 against brute force."""
    rows = of_sets([(90, 10)] * 300 + [(270, 29)] * 100)
    want = {i for i in range(0, len(rows), 2)}
    assert all(0.8 <= similarity(rows[i][1], rows[i + 1][1]) < 0.81 for i in want)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r.doc_id for r in simhash.first_of_groups(frame).collect()} == want


def test_no_pair_below_the_threshold_is_linked(spark):
    """Pairs at a similarity of 0.6 to 0.79, alone and as chains, lose no document."""
    rows = of_sets([(90, 11), (270, 32), (90, 16), (270, 47), (90, 22)] * 60)
    assert all(0.6 <= similarity(rows[i][1], rows[i + 1][1]) < 0.79 for i in range(0, len(rows), 2))
    words = of_sets([(400, 0)], 7)[0][1].split(" ")
    rows += [(len(rows) + i, " ".join(words[12 * i : 12 * i + 100])) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert simhash.first_of_groups(frame).count() == len(rows)


@pytest.mark.parametrize("weight", [1 << 20, 400])
def test_confirmed_links_are_those_of_the_sets(spark, weight):
    """Windows over one text, in whole components and in tiles, against brute force."""
    rng = random.Random(9)
    words = of_sets([(900, 0)])[0][1].split(" ")
    places = sorted(rng.randrange(0, 700) for _ in range(60))
    rows = [(i, " ".join(words[p : p + 104])) for i, p in enumerate(places)]
    frame = spark.createDataFrame(rows, "node bigint, text string").repartition(4)
    prints = frame.select("node", simhash.sketches(frame["text"], 5).alias("print"))
    proposed = spark.createDataFrame([(i, 0) for i in range(1, 60)], "node bigint, root bigint")
    edges = simhash.confirmed(proposed, prints, frame, 5, weight).collect()
    assert all(similarity(rows[e.u][1], rows[e.v][1]) >= 0.8 for e in edges)
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def merged(pairs):
        parent[:] = range(60)
        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        return [find(i) for i in range(60)]

    all_pairs = [(i, j) for i in range(60) for j in range(i) if similarity(rows[i][1], rows[j][1]) >= 0.8]
    want = merged(all_pairs)
    assert merged((e.u, e.v) for e in edges) == want and 2 < len(set(want)) < 60


def test_query_rows(spark):
    words = [f"w{i}" for i in range(60)]
    long = " ".join(words * 40)
    data = [
        (3, long, "x"), (1, long.upper(), "y"), (2, long.replace("w59", "w58"), "z"),
        (4, "", "x"), (5, None, "x"), (6, " \t\n", "x"), (7, "one", "x"), (7, "one", "x"),
        (None, "one", "x"), (None, "alone here", None), (8, "a b c d e f", "x"),
    ]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(data)
    assert sorted((r.doc_id or 0, r.fingerprint) for r in got) == sorted(
        (d or 0, f"{plain_print(t):016x}") for d, t, _ in data
    )
    of = {r.doc_id: r.component_id for r in got if r.doc_id}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[5] == of[6] == 4 and of[7] == 7
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(1, long.upper()), (4, ""), (7, "one"), (0, "alone here"), (8, "a b c d e f")]
    )
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.first_of_groups(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1400)}
