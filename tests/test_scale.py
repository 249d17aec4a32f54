"""Results must not depend on partitions, blocks or skew."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evlake.operators.assemble import dedup_snapshots
from evlake.operators.scale import dealt, ordinals, running_totals
from evlake.operators.search import containing_pairs


def skewed(n=3000, seed=3):
    """A third of all rows share one key; another share has no key."""
    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["a", "b", None] + [f"k{i}" for i in range(40)]
    return [(rng.choice(keys[:8] if rng.random() < 0.7 else keys), i, rng.randint(-5, 50)) for i in range(n)]


@pytest.mark.parametrize("block,partitions", [(1, 3), (17, 1), (1 << 18, 8)])
def test_running_totals(spark, block, partitions):
    rows = skewed(400 if block == 1 else 3000)
    df = spark.createDataFrame(rows, "k string, pos long, v long").repartition(partitions)
    got = {r.pos: (r.before, r.rows) for r in running_totals(df, ["k"], "pos", {"before": F.col("v"), "rows": F.lit(1)}, block).collect()}
    sums, want = defaultdict(lambda: [0, 0]), {}
    for k, pos, v in rows:
        want[pos] = tuple(sums[k])
        sums[k][0] += v
        sums[k][1] += 1
    assert got == want


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_ordinals(spark, partitions):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, pos long, v long").repartition(partitions)
    got = {r.pos: r.ordinal for r in ordinals(df, ["k"], [F.col("v").desc(), F.col("pos")]).collect()}
    groups = defaultdict(list)
    for k, pos, v in rows:
        groups[k].append((-v, pos))
    want = {pos: i for g in groups.values() for i, (_, pos) in enumerate(sorted(g))}
    assert got == want


def test_ordinals_over_everything(spark):
    df = spark.range(1000).withColumn("r", F.hash("id"))
    got = ordinals(df, [], ["r", "id"]).orderBy("r", "id").collect()
    assert [r.ordinal for r in got] == list(range(1000))


def test_snapshots_of_sparse_ids(spark):
    """Ids far apart are numbered by a range sort, not in blocks of ids."""
    rows = [(i * 10_000_019, f"t{i % 700}") for i in range(2000)]
    df = spark.createDataFrame(rows, "seq long, t string").repartition(6)
    got = {r.seq: (r.snapshot_id, r.is_first) for r in dedup_snapshots(df, "seq", F.col("t")).collect()}
    assert got == {seq: (i % 700, i < 700) for i, (seq, _) in enumerate(rows)}


def test_work_of_a_small_file_is_dealt(spark, tmp_path):
    """Every core gets rows, also where the work is a condition that moves down to the scan."""
    from evlake.plans.lake_queries import _record_documents

    names = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    rows = [(i, f"red nut {i}", f"b{i % 3}", "LARGE", i % 50 + 1) for i in range(400)]
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "part"))
    part = spark.read.parquet(str(tmp_path / "part"))
    cores = spark.sparkContext.defaultParallelism
    for docs in (dealt(part, "p_partkey", rows=30), *_record_documents(part, "p_partkey")):
        kept = docs.filter(F.try_parse_json(F.to_json(F.struct("*"))).isNotNull())
        shares = kept.groupBy(F.spark_partition_id()).count().collect()
        assert len(shares) >= cores and sum(r["count"] for r in shares) == 400
        assert {r.p_partkey for r in docs.collect()} == set(range(400))


def test_one_key_in_most_texts(spark):
    """A word that nearly every text holds does not anchor a pattern that also has a rare word."""
    texts = [(i, f"common words here {'rare' if i % 50 == 0 else 'usual'} end {i}") for i in range(500)]
    patterns = [(1, "words here rare end"), (2, "common words here"), (3, "d 49")]
    df = spark.createDataFrame(texts, "id long, t string")
    ps = spark.createDataFrame(patterns, "pid long, p string")
    got = {(r.id, r.pid) for r in containing_pairs(df, "id", ["t"], ps, "pid", "p").collect()}
    assert got == {(i, pid) for i, t in texts for pid, p in patterns if p in t}
