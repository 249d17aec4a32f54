"""Role repair against a plain search over whole conversations."""

import itertools
import random
import re

import pytest

from evlake.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string"
LEGAL = re.compile(r"(S)?(UA)+$")


def plain_cost(roles):
    """Cheapest cost over all legal sequences by uniform search, without the operator's tables."""
    best = {(0, ""): 0}
    legal = lambda s: re.fullmatch(r"S?(UA)*U?", s)
    for i, r in enumerate(roles):
        for (n, s), c in [x for x in best.items() if x[0][0] == i]:
            for t in "SUA":
                price = 1 if r is None else 0 if r == t else 3
                grown = [(s + t, 0)] + [(s + x + t, 2) for x in "SUA"]
                if s and s[-1] == t:
                    grown.append((s, 1))
                for g, extra in grown:
                    if legal(g):
                        g = g[-1] if len(g) > 0 else g
                        g = {"S": "S", "U": "U", "A": "UA"}[g]
                        best[i + 1, g] = min(best.get((i + 1, g), 10**9), c + price + extra)
    ends = {"S": 4, "U": 2, "UA": 0, "": 0}
    return min(c + ends[s] for (n, s), c in best.items() if n == len(roles))


def read(text):
    found = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", text, re.S)
    assert "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in found) == text
    return found


def check(rows, got):
    conversations = {}
    for r in sorted(got, key=lambda r: r.part):
        conversations.setdefault(r.conv_id, []).append(r)
    wanted = {}
    for row in rows:
        wanted.setdefault(row[0], []).append(row)
    assert set(conversations) == set(wanted)
    letters = {"system": "S", "user": "U", "assistant": "A"}
    for conv, turns in wanted.items():
        turns.sort(key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or ""))
        parts = conversations[conv]
        assert [p.part for p in parts] == list(range(len(parts)))
        found = read("".join(p.text for p in parts))
        assert LEGAL.match("".join(letters[r] for r, _ in found))
        said = [(t[3] or "").replace("<|", "< |") for t in turns]
        assert [x for _, t in found for x in t.split("\n\n") if x] == [x for x in said if x]
        roles = [letters.get((t[2] or "").strip().lower()) for t in turns]
        assert sum(p.cost for p in parts) == plain_cost(roles)
        assert sum(p.n_turns for p in parts) == len(turns)
        assert len(found) == len(turns) - sum(p.n_merged for p in parts) + sum(p.n_inserted for p in parts)


@pytest.mark.parametrize("most", [4096, 5])
def test_against_plain_search(spark, most):
    rng = random.Random(most)
    names = ["system", "user", "assistant", "USER ", "tool", None]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, turn, rng.choice(names), f"t{conv}-{turn}", "x"))
    rows += [(99, i, rng.choice(names[:3]), f"long{i} <|user|>", "x") for i in range(700)]
    rows += [(None, None, None, None, None), (None, 1, "user", "n", None), (50, None, "user", "first", "x"), (50, 0, "user", "dup", "x"), (50, 0, "user", "dup", "x")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(rows, chat.formatted(frame, most=most).collect())


def test_rows_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), f"{c}:{t}", "x") for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", "y" * 700_000, "x") for c in (70, None) for t in (None, -3, 0, 4095, 4096, 9000)]
    frame, before, results = spark.createDataFrame(rows, SCHEMA), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = chat.formatted(frame.repartition(n)).collect()
            results.append(sorted(map(repr, got)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 60 + 2 * 6
    check(rows, got)


def test_all_short_conversations(spark):
    rows, conv = [], 0
    for n in (1, 2, 3):
        for roles in itertools.product(["system", "user", "assistant", None], repeat=n):
            rows += [(conv, i, r, f"x{i}", "") for i, r in enumerate(roles)]
            conv += 1
    check(rows, chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect())
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clean_conversation_costs_nothing(spark):
    rows = [(1, 0, "system", "s", ""), (1, 1, "user", "u", ""), (1, 2, "assistant", "a", "")]
    got = chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got[0].cost == 0 and got[0].text == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
