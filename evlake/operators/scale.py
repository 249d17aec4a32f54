"""Numbering and running sums that do not gather a large group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evlake.session import cut_lineage

# Rows of one window task in `running_totals`. The next level holds one row per block.
BLOCK = 1 << 18
# Rows of one file in `dealt`, each of which costs some hundred microseconds.
DEALT = 20_000


def dealt(df: DataFrame, *keys: str, rows: int = DEALT) -> DataFrame:
    """The rows dealt by ``keys`` to every core alike, in files of about ``rows`` of them at most.

    A task of a scan is measured by the bytes it reads. Where each row stands for much work, a small
    file would give all of it to a few tasks. The rows are written: filters, and the work in their
    conditions, would else move below the repartition. (As many files for each core: scans pack small
    files by their number.)
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(df.repartition(cores * (df.count() // (cores * rows) + 1), *keys))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    values: Mapping[str, Column],
    block: int = BLOCK,
) -> DataFrame:
    """Add, per output name, the sum of the value over all earlier positions of the group.

    ``position`` is a unique integer within the group. Positions are cut into blocks of a fixed
    width, so one task never sorts more than ``block`` rows however large the group is. Only the
    totals of the blocks, already summed map-side, are gathered per group.
    """
    names = list(values)
    rows = df.withColumns({f"__v_{n}": c.cast("bigint") for n, c in values.items()}).withColumn(
        "__block", F.floor(F.col(position) / F.lit(block))
    )
    # The number first: a sort compares it, and the group only where it is equal.
    keys = ["__block", *group]
    earlier_blocks = W.partitionBy(*group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        rows.groupBy(*keys)
        .agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
        .select(
            *[F.col(k).alias(f"__k_{k}") for k in keys],
            *[
                F.coalesce(F.sum(f"__t_{n}").over(earlier_blocks), F.lit(0)).alias(f"__b_{n}")
                for n in names
            ],
        )
    )
    earlier_rows = W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumns(
        {f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(earlier_rows), F.lit(0)) for n in names}
    )
    matched = local.join(bases, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "inner")
    return matched.select(
        *df.columns, *[(F.col(f"__b_{n}") + F.col(f"__l_{n}")).alias(n) for n in names]
    )


def ordinals(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "ordinal"
) -> DataFrame:
    """Add the zero-based position of each row in its group, fixed once.

    A window per group would sort a hot group in one task. Instead the rows are range-partitioned
    on (group, order), so a large group spreads over many partitions, and are written once. Each
    row then knows its position in its partition, and only the counts per (partition, group), at
    most partitions + groups rows, are needed to shift those positions.
    """
    ordering = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut_lineage(
        df.orderBy(*[F.col(g) for g in group], *ordering).withColumn(
            "__seat", F.monotonically_increasing_id()
        )
    )
    part = F.shiftright("__seat", 33)
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*group, part.alias("__part"))
        .agg(F.count("*").alias("__n"), F.min("__seat").alias("__first"))
        .select(
            *[F.col(g).alias(f"__k_{g}") for g in group],
            F.col("__part").alias("__k_part"),
            (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
        )
    )
    keys = [part == F.col("__k_part")]
    keys += [F.col(g).eqNullSafe(F.col(f"__k_{g}")) for g in group]
    return placed.join(shifts, keys, "inner").select(
        *df.columns, (F.col("__seat") + F.col("__shift")).alias(name)
    )
