"""Display forms of stored values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stored reason codes and the sentences shown for them.
SOURCE_SENTENCES = {
    "nonlocal": "source is unavailable for a nonlocal definition",
    "unloaded": "source text was not loaded by the compiler",
    "generated": "source is unavailable for an unsupported expansion or synthetic instance",
    "unsupported_span": "the compiler did not establish a supported exact source span",
    "outside_package": "source lies outside the selected package root",
}
COLLECTION_SENTENCES = {
    "incremental": "optimized LLVM is unavailable for incremental compilation",
    "cross_crate_thin_lto": "optimized LLVM is unavailable for cross-crate ThinLTO",
    "fat_lto": "optimized LLVM is unavailable for fat LTO",
    "linker_plugin_lto": "optimized LLVM is unavailable for linker-plugin LTO",
    "other_backend": "optimized LLVM is unavailable for this compiler backend",
    "unverified_compiler": (
        "optimized LLVM artifact stages are not verified for this compiler release"
    ),
}
STAGE_SENTENCES = {
    "no_lto_optimized": "optimized, no LTO",
    "local_thin_lto_post_pass_manager": "optimized, local ThinLTO after pass manager",
}
ERROR_LEVELS = ("error", "error: internal compiler error", "failure-note")


def sentence(code: Column, sentences: dict[str, str]) -> Column:
    """The sentence of a code; NULL for a code outside the table."""
    pairs = [F.lit(x) for item in sentences.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code)


def rfc3339(unix_ms: Column) -> Column:
    """UTC text of Unix milliseconds, independent of the session time zone.

    A whole second has no fraction; otherwise trailing zeros of the fraction are dropped.
    """
    ms = unix_ms.cast("bigint")
    day = F.floor(ms / F.lit(86_400_000)).cast("int")
    rest = F.pmod(ms, F.lit(86_400_000))
    seconds = F.floor(rest / 1000).cast("bigint")
    clock = F.format_string(
        "T%02d:%02d:%02d",
        F.floor(seconds / 3600).cast("bigint"),
        F.pmod(F.floor(seconds / 60), F.lit(60)).cast("bigint"),
        F.pmod(seconds, F.lit(60)),
    )
    millis = F.pmod(rest, F.lit(1000))
    fraction = F.when(millis == 0, F.lit("")).otherwise(
        F.rtrim(F.format_string(".%03d", millis), F.lit("0"))
    )
    date = F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")
    return F.concat(date, clock, fraction, F.lit("Z"))


def diagnostic_class(level: Column) -> Column:
    return (
        F.when(level == "warning", F.lit("warning"))
        .when(level.isin(*ERROR_LEVELS), F.lit("error"))
        .otherwise(F.lit("other"))
    )


def availability(payload: Column, reason: Column, sentences: dict[str, str]) -> Column:
    """Tagged union as ``struct(status, reason, message)``."""
    return F.struct(
        F.when(payload.isNotNull(), F.lit("available")).otherwise(F.lit("unavailable")).alias("status"),
        F.when(payload.isNull(), reason).alias("reason"),
        F.when(payload.isNull(), sentence(reason, sentences)).alias("message"),
    )
