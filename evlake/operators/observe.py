"""Build outcomes, freshness probes, pointer lookups and the reuse decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlake.functions.display import ERROR_LEVELS

COMPLETED = "completed"
STALE = "stale"


def build_completion(
    messages: DataFrame,
    build: Sequence[str],
    selected: Column,
    finished: Column,
    success: Column,
    error: Column,
    matches: Column,
) -> DataFrame:
    """One row per build with its outcome and the counts behind it.

    Complete means: exactly one finished message, and it says success; no error; exactly one
    selected artifact, and it is as expected. ``outcome`` names the first condition that fails.
    Works on a streaming frame too, since it is a plain aggregate.
    """
    counts = messages.groupBy(*build).agg(
        F.count_if(selected).alias("selected"),
        F.count_if(finished).alias("finished"),
        F.count_if(finished & ~F.coalesce(success, F.lit(False))).alias("failed"),
        F.count_if(error).alias("errors"),
        F.count_if(selected & ~F.coalesce(matches, F.lit(False))).alias("mismatched"),
    )
    return counts.select(*build, "selected", "finished", "errors", completion_outcome().alias("outcome"))


def completion_outcome() -> Column:
    return (
        F.when((F.col("finished") != 1) | (F.col("failed") > 0), F.lit("not_finished_once"))
        .when(F.col("errors") > 0, F.lit("has_errors"))
        .when(F.col("selected") != 1, F.lit("not_one_artifact"))
        .when(F.col("mismatched") > 0, F.lit("unexpected_artifact"))
        .otherwise(F.lit(COMPLETED))
    )


def message_completion(messages: DataFrame, expected: DataFrame) -> DataFrame:
    """`build_completion` over parsed messages.

    ``expected`` has one row per build: ``build_id``, the ``package_id``, ``target_name`` and
    ``kinds`` of the artifact it is about, and whether that should be ``fresh``. A build without
    messages is not finished; messages of other builds are left out.
    """
    wanted = expected.select(
        "build_id",
        F.struct("package_id", "target_name", F.array_sort("kinds").alias("kinds"), "fresh").alias("__want"),
    )
    messages = wanted.join(messages, "build_id", "left")
    artifact = F.col("reason") == "compiler-artifact"
    selected = (
        artifact
        & F.col("package_id").eqNullSafe(F.col("__want.package_id"))
        & F.col("target.name").eqNullSafe(F.col("__want.target_name"))
        & F.array_sort("target.kind").eqNullSafe(F.col("__want.kinds"))
    )
    error = (F.col("reason") == "compiler-message") & F.col("level").isin(*ERROR_LEVELS)
    return build_completion(
        messages,
        ["build_id"],
        F.coalesce(selected, F.lit(False)),
        F.coalesce(F.col("reason") == "build-finished", F.lit(False)),
        F.col("success"),
        F.coalesce(error, F.lit(False)),
        F.col("fresh") == F.col("__want.fresh"),
    )


def probe_outcome(
    receipt: Column, process_ok: Column, selected: Column, completed: Column, same: Column, manifest: Column
) -> Column:
    """Outcome of a freshness probe; anything but a clean stale or fresh is an error.

    A stopped probe with a receipt, and no artifact, is stale. A successful one without a receipt,
    whose artifact equals the stored observation, is fresh. A probe never writes a manifest.
    """
    return (
        F.when(manifest, F.lit("error"))
        .when(~process_ok & receipt & (selected == 0), F.lit("stale"))
        .when(process_ok & ~receipt & completed & same, F.lit("fresh"))
        .otherwise(F.lit("error"))
    )


def candidate_lookup(
    requests: DataFrame,
    candidates: DataFrame,
    captures: DataFrame,
    key: str = "request_key",
    violations: DataFrame | None = None,
) -> DataFrame:
    """Pointer, then capture, of each request key.

    No pointer is a ``miss``; a pointer to an absent capture is a ``dangling_miss``. A pointer that
    is malformed or disagrees with its capture is ``invalid``, and so is one to a capture with any
    row in ``violations`` (column ``capture_id``): present but damaged evidence, be it the header,
    the manifest or an artifact file, is never a miss and never reused. History is never searched.
    """
    has_rule = "rule" in candidates.columns
    pointers = candidates.select(
        F.col("request_key").alias(key),
        F.col("token").alias("__token"),
        F.col("capture_id").alias("__capture"),
        (F.col("rule") if has_rule else F.lit(None).cast("string")).alias("__rule"),
        F.lit(True).alias("__pointer"),
    )
    held = captures.select(
        F.col("capture_id").alias("__capture"),
        F.col("analysis.request_key").alias("__key"),
        F.col("analysis.token").alias("__stored"),
        F.struct(*captures.columns).alias("candidate"),
    )
    found = requests.join(pointers, key, "left")
    if violations is None:
        found = found.withColumn("__damaged", F.lit(False))
    else:
        damaged = violations.filter(F.col("capture_id").isNotNull()).select(
            F.col("capture_id").alias("__capture"), F.lit(True).alias("__damaged")
        )
        found = found.join(damaged.distinct(), "__capture", "left")
    status = (
        F.when(F.col("__pointer").isNull(), F.lit("miss"))
        .when(F.col("__rule").isNotNull() | F.col("__damaged"), F.lit("invalid"))
        .when(F.col("candidate").isNull(), F.lit("dangling_miss"))
        .when(
            ~F.col("__key").eqNullSafe(F.col(key)) | ~F.col("__stored").eqNullSafe(F.col("__token")),
            F.lit("invalid"),
        )
        .otherwise(F.lit("hit"))
    )
    return (
        found.join(held, "__capture", "left")
        .select(
            *requests.columns,
            status.alias("lookup"),
            F.when(status == "hit", F.col("candidate")).alias("candidate"),
        )
    )


def reuse_decision(policy_fresh: Column, lookup: Column, probe: Column) -> Column:
    """``reuse``, ``collect`` or ``error``; an error is never turned into a collection."""
    return (
        F.when(policy_fresh, F.lit("collect"))
        .when(lookup.isin("miss", "dangling_miss"), F.lit("collect"))
        .when(lookup == "invalid", F.lit("error"))
        .when(probe == "fresh", F.lit("reuse"))
        .when(probe == "stale", F.lit("collect"))
        .otherwise(F.lit("error"))
    )


def freshness_match(
    observations: DataFrame, candidates: DataFrame, key: str, left: Column, right: Column
) -> DataFrame:
    """Whether stored and new observation agree field by field, NULLs equal."""
    stored = candidates.select(F.col(key), right.alias("__stored"))
    return observations.select(F.col(key), left.alias("__new")).join(stored, key).select(
        key, F.col("__new").eqNullSafe(F.col("__stored")).alias("same")
    )


def diagnostic_split(
    messages: DataFrame, outcomes: DataFrame, build: str = "build_id", seq: str = "seq"
) -> DataFrame:
    """What is shown of each build, in arrival order.

    Warnings are always relayed. Other diagnostics and plain text are held until the outcome is
    known, and stay unseen when it is ``stale``: the collection that follows shows its own.
    """
    shown = messages.filter(F.col("reason").isin("compiler-message", "text"))
    warning = (F.col("reason") == "compiler-message") & F.coalesce(
        F.col("level") == "warning", F.lit(False)
    )
    return (
        shown.withColumn("is_warning", warning)
        .join(outcomes.select(build, "outcome"), build)
        .filter(F.col("is_warning") | (F.col("outcome") != STALE))
        .select(build, seq, "is_warning", "level", "rendered")
        .orderBy(build, F.col("is_warning").desc(), seq)
    )
