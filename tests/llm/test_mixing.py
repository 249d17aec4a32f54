"""Mixing against plain arithmetic and the SQL form."""

import os

import pytest

import oracle
from evlake.llm import mixing
from evlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    got, pool = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values())
    open_ = set(order)
    while pool > 1e-9 and open_:
        unit = pool / sum(w[s] for s in open_)
        pool = 0.0
        for s in list(open_):
            got[s] += unit * w[s]
            if got[s] > 2 * sizes[s]:
                pool += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
                open_.discard(s)
    return got


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 10, "c": 7, "d": 1000, None: 3}, {"a": 0, "b": 5}, {"ä": 9, "z": 9, "Z": 9, "": 1}, {"x": 4},
])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def documents(spark):
    rows = [(i, "w " * (i * 7 % 23), f"s{i % 3 * (i % 2)}", "x") for i in range(200)]
    rows += [(None, "a b c", None, "y"), (None, "a b c", None, "y"), (5, None, "s1", None), (6, " \t", "s1", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, k string")


def test_mix_meets_its_budget(spark):
    docs = documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    per = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        per.setdefault(r.source, []).append(r)
    for rows in per.values():
        assert sum(r.size for r in rows) == rows[0].source_size
        assert sum(r.taken for r in rows) == int(rows[0].target)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_documents_of_the_mix(spark):
    docs = documents(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words, longest = {}, 23
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    for r in mixing.mix(docs).select("source", "target").distinct().collect():
        assert abs(words.get(r.source, 0) - r.target) <= longest
    empty = docs.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_form(spark, name):
    assert oracle.compare(spark, SF, QUERIES[name], ORACLES[name]) is None
