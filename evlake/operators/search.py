"""Two-tier literal search: exact matches, and substring matches only where nothing is exact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evlake.functions.display import COLLECTION_SENTENCES, rfc3339, sentence
from evlake.functions.identity import instance_ref
from evlake.session import cut_lineage

EXACT = "exact"
SUBSTRING = "substring"
DEFAULT_LIMIT = 20


def exact_any(columns: Sequence[str], query: Column) -> Column:
    return reduce(or_, [F.coalesce(F.col(c) == query, F.lit(False)) for c in columns])


def substring_any(columns: Sequence[str], query: Column) -> Column:
    return reduce(or_, [F.coalesce(F.col(c).contains(query), F.lit(False)) for c in columns])


def validate_query(query: str, limit: int) -> None:
    if query == "":
        raise ValueError("query must not be empty")
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")


def find(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    query: str,
    limit: int = DEFAULT_LIMIT,
    scope: Column | None = None,
) -> DataFrame:
    """Rows matching ``query``, best tier only, in ``order``, at most ``limit`` of them.

    ``order`` ends with the stored position, so that equal names keep their stored order. Adds
    ``match_kind``, ``total_matches`` (before the limit) and ``is_truncated``.
    """
    validate_query(query, limit)
    rows = df if scope is None else df.filter(scope)
    literal = F.lit(query)
    exact, partial = exact_any(columns, literal), substring_any(columns, literal)
    # One scalar subquery over the searched columns decides the tier; the second scan then filters
    # with it and keeps only the top rows of each task.
    counts = rows.agg(
        F.struct(F.count_if(exact).alias("exact"), F.count_if(partial).alias("partial"))
    ).scalar()
    n_exact, n_partial = counts["exact"], counts["partial"]
    kept = rows.filter(partial & ((n_exact == 0) | exact))
    total = F.when(n_exact > 0, n_exact).otherwise(n_partial)
    return (
        kept.orderBy(*order)
        .limit(limit)
        .withColumns(
            {
                "match_kind": F.when(n_exact > 0, F.lit(EXACT)).otherwise(F.lit(SUBSTRING)),
                "total_matches": total,
                "is_truncated": total > limit,
            }
        )
    )


# --- substring search for many patterns -------------------------------------------------------

_WINDOW, _TOKEN = "w", "t"
_GRAM = 3
# Tokens of a run, and runs of a window whose least hash is a key.
_RUN, _LEAST_OF = 4, 4
_RUNS = r"(?<!\S)(?=(\S+(?:\s+\S+){%d})(?!\S))(?=\S)" % (_RUN - 1)


def _pieces(text: Column, n: int) -> Column:
    """All overlapping runs of ``n`` characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1))


def _with_minima(rows: DataFrame, texts: Sequence[Column]) -> DataFrame:
    """Add ``__w``: the least hash of each window of token runs, over all texts (none of a null one).

    A run of tokens, with the blanks between, is rarer than any of them. What contains a whole window
    has its least hash, too. Hashes are columns of their own, so that none is computed twice.
    """
    names = [f"__r{i}" for i in range(len(texts))]
    hashed = lambda t: F.transform(F.regexp_extract_all(t, F.lit(_RUNS), F.lit(1)), lambda run: F.xxhash64(run))
    rows = rows.withColumns(dict(zip(names, texts)))
    rows = rows.withColumns({n: hashed(F.col(n)) for n in names})

    def minima(hashes: Column) -> Column:
        windows = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - F.lit(_LEAST_OF - 1), F.lit(0)))
        return F.transform(windows, lambda h, i: F.array_min(F.slice(hashes, i + F.lit(1), F.lit(_LEAST_OF))))

    every = [minima(F.col(n)) for n in names]
    return rows.withColumn("__w", every[0] if len(every) == 1 else F.concat(*every)).drop(*names)


def _inner_tokens(pattern: Column) -> Column:
    """The tokens that are whole in any text: the first and the last may be cut inside a word."""
    tokens = F.split(pattern, r"\s+")
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - F.lit(2), F.lit(0)))


def _pattern_class(pattern: Column) -> Column:
    """How a pattern is anchored: by a window of inner token runs, by an inner token, or by runs of 3,
    2 or 1 characters."""
    tokens = F.size(F.split(pattern, r"\s+"))
    return (
        F.when(tokens - 2 >= _RUN + _LEAST_OF - 1, F.lit(_WINDOW))
        .when(tokens >= 3, F.lit(_TOKEN))
        .otherwise(F.least(F.length(pattern), F.lit(_GRAM)).cast("string"))
    )


def _pattern_keys(pattern: Column) -> Column:
    """Keys every text that contains the pattern must have, of the pattern's own class; ``__w`` has
    its windows."""
    kind = _pattern_class(pattern)
    keys = F.when(kind == _WINDOW, F.transform("__w", lambda h: h.cast("string")))
    keys = keys.when(kind == _TOKEN, _inner_tokens(pattern))
    for n in range(1, _GRAM + 1):
        keys = keys.when(kind == str(n), _pieces(pattern, n))
    return F.array_distinct(keys)


def _text_keys(columns: Sequence[str], classes: Column) -> Column:
    """``array<struct<class, keys>>`` of a text, only of the classes some pattern uses."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in columns]

    def of(kind: str, keys: list[Column]) -> Column:
        every = keys[0] if len(keys) == 1 else F.concat(*keys)
        used = F.array_contains(classes, kind)
        return F.when(used, F.struct(F.lit(kind).alias("__class"), F.array_distinct(every).alias("__keys")))

    kinds = [of(_WINDOW, [F.transform("__w", lambda h: h.cast("string"))])]
    kinds += [of(_TOKEN, [F.split(t, r"\s+") for t in texts])]
    kinds += [of(str(n), [_pieces(t, n) for t in texts]) for n in range(1, _GRAM + 1)]
    return F.array_compact(F.array(*kinds))


def containing_pairs(
    texts: DataFrame,
    text_id: str,
    columns: Sequence[str],
    patterns: DataFrame,
    pattern_id: str,
    pattern: str,
    scope: Sequence[str] = (),
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Every (scope, text id, pattern id) where one of the columns contains the pattern.

    Exact, without comparing all pairs. Each pattern is anchored on the rarest of the keys that a
    containing text must have, so the equi-join yields at most as many candidates per pattern as
    its rarest key has texts; `contains` then decides. Sides are joined by key with AQE choosing a
    broadcast where the anchors turn out small and splitting a key that is hot. ``carry`` adds
    expressions over the text row and the pattern row.
    """
    candidates = candidate_pairs(texts, text_id, columns, patterns, pattern_id, pattern, scope)
    extra = {name: c for name, c in (carry or {}).items()}
    return (
        candidates.join(texts, [*scope, text_id])
        .filter(substring_any(columns, F.col("__pattern")))
        .select(*scope, text_id, pattern_id, *[c.alias(name) for name, c in extra.items()])
    )


def candidate_pairs(
    texts: DataFrame,
    text_id: str,
    columns: Sequence[str],
    patterns: DataFrame,
    pattern_id: str,
    pattern: str,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Pairs of `containing_pairs` before the last check: ids and ``__pattern`` of all texts that have
    the rarest key of a pattern."""
    asked = patterns.filter(F.col(pattern) != "")
    # The first and the last token may be cut inside a word of a text; what is between is whole.
    inner = F.regexp_extract(pattern, r"(?s)^\S*\s+(.*)\s+\S*$", 1)
    keyed = _with_minima(asked, [inner]).select(
        *scope,
        pattern_id,
        F.col(pattern).alias("__pattern"),
        _pattern_class(F.col(pattern)).alias("__class"),
        F.explode(_pattern_keys(F.col(pattern))).alias("__key"),
    )
    # At most five distinct classes, so this set is bounded.
    classes = patterns.agg(F.collect_set(_pattern_class(F.col(pattern)))).scalar()
    on = [*scope, "__class", "__key"]
    # Only keys that some pattern has. Texts are taken apart once; the counts and the candidates
    # below both read this narrow table.
    windows = F.array_contains(classes, _WINDOW)
    searched = [F.when(windows, F.coalesce(F.col(c), F.lit(""))) for c in columns]
    text_keys = cut_lineage(
        _with_minima(texts.select(*scope, text_id, *columns), searched)
        .select(*scope, text_id, F.explode(_text_keys(columns, classes)).alias("__k"))
        .select(*scope, text_id, "__k.__class", F.explode("__k.__keys").alias("__key"))
        .join(keyed.select(*on).distinct(), on, "left_semi")
    )
    frequency = text_keys.groupBy(*on).agg(F.count("*").alias("__n"))
    # A key of the pattern that no text has proves that nothing contains the pattern.
    rarity = F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__key").alias("key"))
    anchors = (
        keyed.join(frequency, on, "left")
        .groupBy(*scope, pattern_id, "__pattern", "__class")
        .agg(F.min(rarity).alias("__rarest"))
        .filter(F.col("__rarest.n") > 0)
        .select(*scope, pattern_id, "__pattern", "__class", F.col("__rarest.key").alias("__key"))
    )
    return text_keys.join(anchors, on).drop("__class", "__key")


def find_many(
    df: DataFrame,
    row_id: str,
    columns: Sequence[str],
    order: Sequence[str],
    queries: DataFrame,
    query_id: str,
    query: str,
    limit: int | str = DEFAULT_LIMIT,
    scope: Sequence[str] = (),
) -> DataFrame:
    """`find` for a table of queries. Empty queries give no rows; see `bad_queries`.

    ``limit`` is one number, or the column of ``queries`` that holds each query's own.

    One row per (query, kept row): the query id, the scope, ``match_kind``, ``total_matches``,
    ``is_truncated``, ``position`` and the row's own columns.
    """
    largest = limit
    if isinstance(limit, str):
        largest = queries.agg(F.coalesce(F.max(limit), F.lit(1))).first()[0]
        limits = queries.select(F.col(query_id), F.col(limit).alias("__limit"))
    else:
        limits = queries.select(F.col(query_id), F.lit(limit).alias("__limit"))
    validate_query("-", largest)
    tier = F.when(exact_any(columns, F.col("__pattern")), 0).otherwise(1)
    sort_keys = {f"__o{i}": F.col(c) for i, c in enumerate(order)}
    # Read twice below, so the matches (ids and sort keys only) are written once.
    hits = cut_lineage(
        containing_pairs(
            df, row_id, columns, queries, query_id, query, scope, {"__tier": tier, **sort_keys}
        )
    )
    totals = hits.groupBy(query_id).agg(
        F.min("__tier").alias("__best"),
        F.count_if(F.col("__tier") == 0).alias("__exact"),
        F.count("*").alias("__all"),
    )
    # The largest limit is applied before the shuffle too, so a query that matches a third of the
    # table ships at most that many rows per task.
    best_first = W.partitionBy(query_id).orderBy("__tier", *sort_keys)
    top = hits.withColumn("position", F.row_number().over(best_first)).filter(
        F.col("position") <= largest
    )
    total = F.when(F.col("__best") == 0, F.col("__exact")).otherwise(F.col("__all"))
    return (
        top.join(totals.join(limits.dropDuplicates([query_id]), query_id), query_id)
        .filter((F.col("__tier") == F.col("__best")) & (F.col("position") <= F.col("__limit")))
        .withColumns(
            {
                "match_kind": F.when(F.col("__best") == 0, F.lit(EXACT)).otherwise(
                    F.lit(SUBSTRING)
                ),
                "total_matches": total,
                "is_truncated": total > F.col("__limit"),
            }
        )
        .drop("__tier", "__best", "__exact", "__all", "__limit", *sort_keys)
        .join(df, [*scope, row_id])
    )


def bad_queries(queries: DataFrame, query_id: str, query: str, limit: str | None = None) -> DataFrame:
    """Queries that must be refused before any read."""
    rule = F.when(F.coalesce(F.col(query), F.lit("")) == "", F.lit("empty_query"))
    if limit is not None:
        rule = rule.when(F.coalesce(F.col(limit), F.lit(0)) < 1, F.lit("invalid_limit"))
    return queries.select(F.col(query_id), rule.alias("rule")).filter(F.col("rule").isNotNull())


# --- listings -----------------------------------------------------------------------------------


def list_captures(df: DataFrame, completed: str, capture_id: str) -> DataFrame:
    """Newest first, ties by id."""
    return df.orderBy(F.col(completed).desc(), F.col(capture_id).asc())


def capture_view(captures: DataFrame) -> DataFrame:
    """Flat listing of capture headers."""
    return captures.select(
        "capture_id",
        rfc3339(F.col("completed_at_unix_ms")).alias("completed"),
        F.col("build.package").alias("package"),
        F.col("build.package_version").alias("package_version"),
        F.col("build.target.kind").alias("target_kind"),
        F.col("build.target.name").alias("target_name"),
        F.col("build.profile").alias("profile"),
    )


def instance_view(instances: DataFrame, placements: DataFrame) -> DataFrame:
    """One row per placement of an instance, with the instance's reference."""
    return (
        instances.select(
            "capture_id", "ordinal", "display_name", "crate_name", "definition_path", "raw_symbol"
        )
        .join(placements, ["capture_id", "ordinal"], "left")
        .withColumn("reference", instance_ref(F.col("capture_id"), F.col("ordinal")))
    )


def unavailable_captures(captures: DataFrame) -> DataFrame:
    """Captures without module text, with the reason shown to a user."""
    reason = F.col("not_captured_reason")
    return captures.filter(reason.isNotNull()).select(
        "capture_id", "not_captured_reason", sentence(reason, COLLECTION_SENTENCES).alias("message")
    )
