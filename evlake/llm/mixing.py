"""Mixing sources to target weights, exactly, with reruns that agree.

Every document has a random key, a hash of its id. Rows are range-partitioned by (source, key), so a
large source spreads over many tasks; each task sums its rows in order, the sums per (task, source)
are summed again, and so every row knows the words before it in its source. A source gives whole
epochs of all its rows and then rows in key order up to its exact budget.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evlake.llm.common import fresh, word_count
from evlake.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, limit: float = 2.0
) -> DataFrame:
    """Add ``target`` to the table of ``source, source_size``, one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and together get ``share`` of
    all words; none gets over ``limit`` times its size, and what it can't take goes to the others
    by weight. In the order of cap per weight, a source is at its cap if the level that the rest
    would have is not below that. The windows hold one row per source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(limit))
    everything = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "all": F.sum("source_size").over(everything) * F.lit(share),
        "total_w": F.sum("w").over(everything),
        "caps": F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)),
        "ws": F.coalesce(F.sum("w").over(earlier), F.lit(0.0)),
    }).withColumn(
        "capped",
        (F.col("all") - F.col("caps")) * F.col("w") >= F.col("cap") * (F.col("total_w") - F.col("ws")),
    )
    full = F.when(F.col("capped"), F.col("cap")).otherwise(0.0)
    full_w = F.when(F.col("capped"), F.col("w")).otherwise(0.0)
    left_w = F.col("total_w") - F.sum(full_w).over(everything)
    level = (F.col("all") - F.sum(full).over(everything)) / F.nullif(left_w, F.lit(0.0))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.least(level * F.col("w"), F.col("cap")))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def random_key(doc_id: Column, seed: str) -> Column:
    """Sixteen hexadecimal digits from the id; the same in every engine."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 16)


def placed(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str
) -> DataFrame:
    """``doc_id, source, size, k, tie, part, before`` once per row: the words before it in its
    (task, source). Written once, so that the partitioning is fixed. Rows with equal keys follow
    in the order of id and text hash; rows equal in all are alike."""
    columns = ["doc_id", "source", "size", "k", "tie"]
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        random_key(F.col(id_col), seed).alias("k"), F.xxhash64(F.col(text_col)).alias("tie"),
    )
    order = [F.col("source").isNull(), *[F.col(c) for c in ("source", "k", "doc_id", "tie")]]
    schema = "doc_id bigint, source string, size bigint, k string, tie bigint, part int, before bigint"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, total = (None, False), 0
        for batch in batches:
            source, size = batch.column(1), batch.column(2).to_numpy()
            codes = source.dictionary_encode()
            index = codes.indices.fill_null(-1).to_numpy()
            names = codes.dictionary.to_pylist()
            before = np.zeros(len(size), dtype=np.int64)
            borders = [0, *(np.flatnonzero(np.diff(index)) + 1).tolist(), len(index)]
            for a, b in zip(borders, borders[1:]):
                name = (names[index[a]] if index[a] >= 0 else None, True)
                if name != last:
                    last, total = name, 0
                ends = total + np.cumsum(size[a:b])
                before[a:b] = ends - size[a:b]
                total = int(ends[-1])
            parts = pa.array(np.full(len(size), part, np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, parts, pa.array(before)], names=[*columns, "part", "before"])

    return cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sums, schema))


def shares(rows: DataFrame, **settings) -> DataFrame:
    """Add ``source_size, target``, the whole ``epochs`` and the ``rest`` of the budget of the
    source, and make ``before`` the words before the row in its whole source."""
    per_part = rows.groupBy("part", "source").agg(F.sum("size").alias("words"))
    goals = targets(per_part.groupBy("source").agg(F.sum("words").alias("source_size")), **settings)
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = per_part.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    budget = F.floor("target")
    whole = F.coalesce(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    goals = goals.withColumn("epochs", whole).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    steps = base.join(goals, base["source"].eqNullSafe(goals["source"])).select(
        F.col("part").alias("p"), base["source"].alias("s"), "base", "source_size", "target", "epochs", "rest")
    match = (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))
    return rows.join(steps, match).withColumn("before", F.col("before") + F.col("base")).drop("p", "s", "base")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: str = "mix", **settings,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row.

    ``size`` counts words (null text: 0). ``taken`` is the words that the mix takes of the row over
    all epochs; they sum to the target of the source, rounded down, and only the row at the cut is
    taken in part. ``settings`` go to :func:`targets`. Rows with equal or null ids are rows of
    their own; a table without words takes none; an empty table gives no rows.
    """
    rows = shares(placed(docs, id_col, text_col, source_col, seed), **settings)
    part = F.greatest(F.least(F.col("rest") - F.col("before"), F.col("size")), F.lit(0))
    taken = F.col("epochs") * F.col("size") + part
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: str = "mix", **settings,
) -> DataFrame:
    """The rows of ``docs`` in the mix, each as often as it is taken, whole.

    The row at the cut comes once more if at least half of it is within the budget. The texts do
    not move: only the last row taken of each source is looked up, and every row compares itself
    with that.
    """
    rows = shares(placed(docs, id_col, text_col, source_col, seed), **settings)
    extra = (F.col("before") < F.col("rest")) & (2 * (F.col("rest") - F.col("before")) >= F.col("size"))
    # One row per source, written so that its size is known when the join is planned: Spark then
    # broadcasts it by its own limit, and the texts are not shuffled by a hot source.
    cuts = cut_lineage(rows.groupBy("source").agg(
        F.first("epochs").alias("__epochs"),
        F.max(F.when(extra, F.struct("k", "doc_id", "tie"))).alias("__last"),
    ).withColumnRenamed("source", "__source"))
    own = F.struct(random_key(F.col(id_col), seed).alias("k"), F.col(id_col).cast("bigint").alias("doc_id"),
                   F.xxhash64(F.col(text_col)).alias("tie"))
    times = (F.col("__epochs") + F.coalesce(own <= F.col("__last"), F.lit(False)).cast("int")).cast("int")
    copy = fresh(docs.columns, "__copy")
    return (
        docs.join(cuts, F.col(source_col).cast("string").eqNullSafe(F.col("__source")))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(1), times)))
        .select(*docs.columns)
    )
