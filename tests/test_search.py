import random

import pytest
from pyspark.sql import functions as F

from evlake.operators import search

SCHEMA = "capture_id string, ordinal long, crate_name string, definition_path string, display_name string, raw_symbol string"
COLUMNS = ["definition_path", "display_name", "raw_symbol"]
ORDER = ["display_name", "definition_path", "crate_name", "raw_symbol", "ordinal"]


def instances(spark, rows):
    return spark.createDataFrame([(f"c{i % 3}", i, *r) for i, r in enumerate(rows)], SCHEMA)


def random_rows(seed, n=80):
    """Short names over few letters, with blanks, other scripts and pattern characters among them."""
    rng = random.Random(seed)
    parts = ["ox", "Ox", "oxen", "%", "_", ".", "é", "😀", "m::", "<T>", " "]
    name = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    return [(rng.choice(["aa", "bb"]), name(), name(), name()) for _ in range(n)]


def plain_find(rows, text, limit, keep=lambda i: True):
    held = [(i, r) for i, r in enumerate(rows) if keep(i)]
    exact = [x for x in held if text in x[1][1:]]
    hits = exact or [x for x in held if any(text in name for name in x[1][1:])]
    crate, path, display, symbol = range(4)
    hits.sort(key=lambda x: [x[1][k].encode() for k in (display, path, crate, symbol)] + [x[0]])
    kind = "exact" if exact else "substring"
    return [(i, kind, len(hits), len(hits) > limit) for i, _ in hits[:limit]]


@pytest.mark.parametrize("text,limit", [("ox", 500), ("ox", 3), ("Ox", 7), ("oxen", 1), ("%", 9), ("_", 4), (".", 2), ("é", 500), ("😀", 1), ("xm::", 50), ("no such", 5)])
def test_find_is_the_plain_search(spark, text, limit):
    rows = random_rows(limit)
    df = instances(spark, rows).repartition(3)
    got = [(r.ordinal, r.match_kind, r.total_matches, r.is_truncated) for r in search.find(df, COLUMNS, ORDER, text, limit).collect()]
    assert got == plain_find(rows, text, limit)
    scoped = search.find(df, COLUMNS, ORDER, text, limit, F.col("capture_id") == "c1").collect()
    assert [(r.ordinal, r.match_kind, r.total_matches, r.is_truncated) for r in scoped] == plain_find(rows, text, limit, lambda i: i % 3 == 1)


def test_bad_input_fails_before_any_read(spark):
    with pytest.raises(ValueError):
        search.find(None, COLUMNS, ORDER, "", 10)
    with pytest.raises(ValueError):
        search.find(None, COLUMNS, ORDER, "x", 0)


def test_find_many_equals_brute_force(spark):
    """Patterns of every class: tokens, long and short runs, blanks, surrogate pairs, no match."""
    rng = random.Random(7)
    words = ["ka", "kab", "bab", "ab", "é", "😀x", "a b", "  ", "zz%", "."]
    def text():
        return " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 6, 40])))

    rows = [(c, i, text(), text(), text(), text()) for c in ("one", "two") for i in range(60)]
    queries = [(c, f"{c}/{q}", q) for c in ("one", "two") for q in
               {*words, "b k", "ab ka bab", "a b kab a", "b ka kab  bab ab é zz% . ka a", *(" ".join(rng.choices(words, k=9)) for _ in range(4)), "x ", "😀", "none of it", "a", " ", "", *(text() for _ in range(10))}]
    df = spark.createDataFrame(rows, SCHEMA)
    # Every query has a limit of its own.
    queries = [(*q, 1 + i % 4) for i, q in enumerate(queries)]
    asked = spark.createDataFrame(queries, "capture_id string, id string, q string, most int")
    found = search.find_many(df.withColumn("row", F.concat_ws(":", "capture_id", "ordinal")), "row", COLUMNS, ORDER, asked, "id", "q", "most", ["capture_id"])
    got = {}
    for r in found.orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.ordinal, r.match_kind, r.total_matches, r.is_truncated))
    want = {}
    for capture, qid, q, most in queries:
        if not q:
            continue
        mine = [r for r in rows if r[0] == capture]
        exact = [r for r in mine if q in r[3:6]]
        hits = exact or [r for r in mine if any(q in t for t in r[3:6])]
        hits.sort(key=lambda r: tuple(s.encode() for s in (r[4], r[3], r[2], r[5])) + (r[1],))
        kind = "exact" if exact else "substring"
        if hits:
            want[qid] = [(r[1], kind, len(hits), len(hits) > most) for r in hits[:most]]
    assert got == want


def test_passages_of_common_words_have_rare_keys(spark):
    """Every word is in nearly every text; runs of them tell the texts apart."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(rng.choices(words, k=60))) for i in range(300)]
    cut = lambda i: texts[i][1][7:80]
    passages = [(i, cut(i)) for i in range(0, 300, 30)] + [(1000, " ".join(words[::-1]))]
    frame = spark.createDataFrame(texts, "id int, text string")
    asked = spark.createDataFrame(passages, "pid int, passage string")
    candidates = search.candidate_pairs(frame, "id", ["text"], asked, "pid", "passage").count()
    found = {(r.id, r.pid) for r in search.containing_pairs(frame, "id", ["text"], asked, "pid", "passage").collect()}
    assert found == {(i, p) for i, t in texts for p, passage in passages if passage in t}
    assert len(found) >= 10 and candidates <= len(found) + 5
