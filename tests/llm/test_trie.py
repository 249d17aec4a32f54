"""The prefix trie against a plain walk over all prefixes, and against its SQL form."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

import oracle
from evlake.llm import trie
from evlake.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, tid string"


def rebuilt(rows):
    """{conversation: [(role, text), ...]} after the contract's rebuilding."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])
        out[c] = base[:h] + turns[h:]
    return out


def nodes_of(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(lambda: [0, 0])
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, who in members.items():
        cost = (len(who) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            below[path[:d]][0] += not children[path]
            below[path[:d]][1] += cost
    rows = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(path))
        rows.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children[path],
                     *below[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def spark_nodes(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = trie.prefix_trie(trie.rebuilt(trie.turn_rows(frame))).collect()
    return sorted(map(tuple, found), key=repr)


def made(rng, n, words, longest):
    rows = []
    for c in range(-7, n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(words), "clash"))
    return rows


def test_small_tables(spark):
    rng = random.Random(1)
    rows = made(rng, 60, ["a", "é", "", None, "a longer text"], 14)
    rows += [(None, 1, "user", "no conversation", ""), (200, None, "user", "second", ""), (200, 0, "user", "third", "")]
    rows += [(c, t, "user", f"same {t}", "") for c in range(300, 340) for t in range(11)]
    rows += [(401, 3, "user", "twice", "")] * 2
    assert spark_nodes(spark, rows) == nodes_of(rebuilt(rows))


def test_long_conversations_and_pieces(spark, monkeypatch):
    """Texts of one letter, so that turns of one conversation repeat, and blocks share their ids."""
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(2)
    rows = [(c, t, "user", "x" if t < 70 else rng.choice("xy"), "") for c in range(0, 40, 5) for t in range(100)]
    rows += [(c, t, "user", "q", "") for c in range(1000, 1090) for t in range(12)]
    assert spark_nodes(spark, rows) == nodes_of(rebuilt(rows))


def test_edges(spark):
    assert spark_nodes(spark, []) == []
    assert spark_nodes(spark, [(None, 0, "user", "x", "")]) == []
    # Conversation 2 takes nothing (its base is absent) and, with h = 3, loses its only turn.
    assert zlib.crc32(b"2") % 9 > 1
    assert spark_nodes(spark, [(2, 0, "user", "x", "")]) == [(2, 0, None, 1, 0, 1, 0, hashlib.sha256(b"2").hexdigest())]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    name = "op13_prefix_trie"
    assert oracle.compare(spark, sf_dir, QUERIES[name], ORACLES[name]) is None
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()), key=repr) == nodes_of(rebuilt(rows))
