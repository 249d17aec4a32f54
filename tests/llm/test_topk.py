"""Top-k search against all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evlake.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, score string"


def plain(rows, k):
    clean = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in clean if i % 20 == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,scale_up,slices", [(1, 1.0, 2), (2, 1.0, 3), (3, 3e4, 2), (4, 1e7, 1)])
def test_against_all_scores(spark, seed, scale_up, slices):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(16)] for _ in range(4)]
    rows = []
    for i in range(500):
        v = [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]
        rows.append((i, [x * scale_up for x in (centres[0] if rng.random() < 0.3 else v)], "s"))
    rows += [(600, None, "s"), (620, [1.0, None], "s"), (640, [math.nan] * 16, "s"), (660, [math.inf] * 16, "s"),
             (None, centres[1], "s"), (680, [], "s"), (700, centres[2][:7], "s"), (501, centres[0], "s")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = topk.search(frame, F.col("vec_id") % 20 == 0, slices=slices, block=64, query_block=9)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain(rows, 20)


def test_few_rows(spark):
    rows = [(0, [0.5], "x"), (1, [0.25], "x"), (2, [-0.5], "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in topk.search(frame, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 512), (0, 2, 2, -1024)]
    assert topk.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
