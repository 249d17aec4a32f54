"""Grouping partial records, numbering, pointers, snapshots and selectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlake.functions.identity import I64_MAX
from evlake.operators.scale import ordinals

IDENTITY = ("crate_name", "definition_path", "display_name", "raw_symbol")


def assemble_groups(df: DataFrame, keys: Sequence[str], source: Column) -> DataFrame:
    """One row per key: ``placements`` (count), ``source`` and whether its rows disagree on it.

    Only counts and extremes are aggregated, so any group size is combined map-side.
    """
    boxed = F.struct(source.alias("value"))
    low, high = F.min(boxed), F.max(boxed)
    return df.groupBy(*keys).agg(
        F.count("*").alias("placements"),
        low["value"].alias("source"),
        (~low.eqNullSafe(high)).alias("conflict"),
    )


def number_placements(
    df: DataFrame, keys: Sequence[str], seq: Sequence[str | Column], name: str = "placement_no"
) -> DataFrame:
    """Rows of each group in arrival order, numbered from zero. One row per placement."""
    return ordinals(df, keys, seq, name)


def assign_ordinals(
    groups: DataFrame, capture: Sequence[str], identity: Sequence[str | Column] = IDENTITY
) -> DataFrame:
    """Zero-based position in identity order per capture."""
    return ordinals(groups, capture, identity)


def current_candidates(
    pointers: DataFrame, key: Sequence[str], seq: Column, values: Sequence[str]
) -> DataFrame:
    """Last published pointer per key. Combined map-side; no group is sorted."""
    latest = F.max_by(F.struct(*values), seq)
    return pointers.groupBy(*key).agg(latest.alias("__row")).select(*key, "__row.*")


def next_artifact_ids(
    modules: DataFrame, capture: Sequence[str], position: str, artifacts: DataFrame
) -> DataFrame:
    """Dense ids after the largest id of the capture, in module order.

    ``artifact_id`` is NULL where the id would not fit, and ``overflow`` is then true.
    """
    largest = artifacts.groupBy(*capture).agg(F.max("artifact_id").alias("__max"))
    placed = ordinals(modules, capture, [position], "__nth")
    first = F.coalesce(F.col("__max") + F.lit(1).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    wide = first + F.col("__nth").cast("decimal(20,0)")
    fits = wide <= F.lit(str(I64_MAX)).cast("decimal(20,0)")
    return placed.join(largest, list(capture), "left").select(
        *modules.columns,
        F.when(fits, wide).cast("bigint").alias("artifact_id"),
        (~fits).alias("overflow"),
    )


def dedup_snapshots(df: DataFrame, seq: str, identity: Column, name: str = "snapshot_id") -> DataFrame:
    """One id per distinct identity, dense, in first-seen order; later rows reuse the id.

    ``seq`` is a unique integer. The identity is digested once, so a copy group that holds a third
    of the rows is combined map-side, and only first rows are numbered.
    """
    keyed = df.select("*", F.sha2(identity.cast("binary"), 256).alias("__digest"))
    firsts = keyed.groupBy("__digest").agg(F.min(seq).alias("__first"))
    numbered = ordinals(firsts, [], ["__first"], name)
    return keyed.join(numbered.select("__digest", "__first", name), "__digest").select(
        *df.columns, name, (F.col(seq) == F.col("__first")).alias("is_first")
    )


# Catalog kinds each selector kind accepts. Only the first ignores the name.
SELECTOR_KINDS: Mapping[str, tuple[str, ...]] = {
    "lib": ("lib", "rlib", "dylib", "cdylib", "staticlib", "proc-macro"),
    "bin": ("bin",),
    "example": ("example",),
    "bench": ("bench",),
}


def resolve_selector(
    selectors: DataFrame,
    selector_id: str,
    catalog: DataFrame,
    package: str = "package",
    position: str = "position",
    kind: str = "kind",
    name: str = "name",
    kinds: str = "kinds",
    accepted: Mapping[str, tuple[str, ...]] = SELECTOR_KINDS,
    nameless: str = "lib",
) -> DataFrame:
    """First catalog row, by position, of the package that the selector accepts.

    ``status`` is ``found``, ``package_not_found`` or ``target_not_found``. The catalog is reduced
    to its first row per (package, kind, name) before the join, so no package is compared with all
    of its selectors.
    """
    classes = F.array(
        *[
            F.when(F.arrays_overlap(kinds, F.array(*[F.lit(v) for v in values])), F.lit(k))
            for k, values in accepted.items()
        ]
    )
    # The name is compared only for kinds that use it.
    compared = F.when(F.col(kind) != nameless, F.col(name)).otherwise(F.lit(""))
    first = (
        catalog.select(
            package, position, name, F.explode(F.array_compact(classes)).alias(kind)
        )
        .groupBy(package, kind, compared.alias("__name"))
        .agg(F.min(F.struct(position, name)).alias("__best"))
    )
    packages = catalog.select(package, F.lit(True).alias("__known")).distinct()
    best = F.col("__best")
    return (
        selectors.select(selector_id, package, kind, compared.alias("__name"))
        .join(first, [package, kind, "__name"], "left")
        .join(packages, package, "left")
        .select(
            selector_id,
            package,
            F.when(F.col("__known").isNull(), F.lit("package_not_found"))
            .when(best.isNull(), F.lit("target_not_found"))
            .otherwise(F.lit("found"))
            .alias("status"),
            best[position].alias(position),
            best[name].alias(name),
        )
    )
