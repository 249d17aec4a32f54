"""Normal forms of list-valued fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_features(entries: Column) -> Column:
    """Split every entry on commas and whitespace, drop empties, remove duplicates, sort."""
    pieces = F.flatten(F.transform(entries, lambda e: F.split(e, r"[,\p{IsWhite_Space}]+")))
    return F.array_sort(F.array_distinct(F.filter(pieces, lambda p: p != "")))


def normalize_observation(artifact: Column) -> Column:
    """Observation with sorted list fields and no freshness flag, so equality ignores order."""
    target = artifact["target"]
    sorted_target = (
        target.withField("kind", F.array_sort(target["kind"]))
        .withField("crate_types", F.array_sort(target["crate_types"]))
        .withField("required_features", F.array_sort(target["required_features"]))
    )
    return (
        artifact.withField("fresh", F.lit(False))
        .withField("features", F.array_sort(artifact["features"]))
        .withField("filenames", F.array_sort(artifact["filenames"]))
        .withField("target", sorted_target)
    )
