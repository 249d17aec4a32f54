"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlake.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Edges that one task reduces at a time.
BATCH = 1 << 19


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges from each node to the smallest node of its component."""
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = index[: len(left)], index[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def reduced(edges: DataFrame) -> DataFrame:
    """Replace the edges that meet in one task by a forest; a task never adds an edge."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_u, held_v, size = [], [], 0

        def flush():
            u, v = forest(np.concatenate(held_u), np.concatenate(held_v))
            held_u.clear(), held_v.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held_u.append(batch.column(0).to_numpy())
            held_v.append(batch.column(1).to_numpy())
            size += batch.num_rows
            if size >= BATCH:
                yield flush()
                size = 0
        if size:
            yield flush()

    return edges.mapInArrow(task, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge but the roots, which are the smallest nodes.

    ``edges`` has two bigint columns. Large-star and small-star steps alternate: all neighbours of a
    node above it move to its smallest neighbour, then those below it. Minima are aggregated
    map-side, so a node with very many neighbours is no burden, and every step is a written table.
    """
    u, v = edges.columns
    current = cut_lineage(
        reduced(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v"))
    )
    while unfinished(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u")
            .select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
        )
        current = cut_lineage(reduced(small.distinct()))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()


def unfinished(edges: DataFrame) -> bool:
    """Whether some node has two parents, or a parent and a child."""
    ends = edges.distinct().select(
        F.explode(F.array(
            F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")),
        )).alias("e")
    ).select("e.*")
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.filter("up > 1 or (up = 1 and down = 1)").isEmpty()
