"""References to rows, symbols to bodies, and alias chains of any depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlake.functions.display import SOURCE_SENTENCES, availability
from evlake.functions.identity import parse_instance_ref
from evlake.session import cut_lineage

FUNCTION = "function"
DIRECT_ALIAS = "direct_alias"
UNSUPPORTED_KINDS = ("expression_alias", "ifunc")

BODY = "body"
NO_DEFINITION = "no_exact_definition"
UNSUPPORTED = "unsupported_alias"
CYCLE = "alias_cycle"


def resolve_references(
    references: DataFrame,
    reference: str,
    instances: DataFrame,
    capture_id: str = "capture_id",
    ordinal: str = "ordinal",
    id_pattern: str = "[k-z]{32}",
) -> DataFrame:
    """The row a ``capture:ordinal`` text names.

    ``status`` is ``found``, ``malformed``, ``unknown_capture`` or ``invalid_ordinal``, the last
    with ``instance_count``.
    """
    parsed = references.withColumn("__ref", parse_instance_ref(F.col(reference), id_pattern))
    asked = parsed.select(
        *references.columns,
        F.col("__ref").isNotNull().alias("__ok"),
        F.col("__ref.capture_id").alias("__capture"),
        F.col("__ref.ordinal").alias("__ordinal"),
    )
    counts = instances.groupBy(F.col(capture_id).cast("string").alias("__capture")).agg(
        F.count("*").alias("instance_count")
    )
    rows = instances.select(
        F.col(capture_id).cast("string").alias("__capture"),
        F.col(ordinal).cast("decimal(20,0)").alias("__ordinal"),
        F.struct(*instances.columns).alias("instance"),
    )
    status = (
        F.when(~F.col("__ok"), F.lit("malformed"))
        .when(F.col("instance_count").isNull(), F.lit("unknown_capture"))
        .when(F.col("instance").isNull(), F.lit("invalid_ordinal"))
        .otherwise(F.lit("found"))
    )
    return (
        asked.join(rows, ["__capture", "__ordinal"], "left")
        .join(counts, "__capture", "left")
        .select(*references.columns, status.alias("status"), "instance_count", "instance")
    )


def source_evidence(resolved: DataFrame) -> DataFrame:
    """Stored source range of each found instance, or its stored reason; nothing is substituted."""
    source, reason = F.col("instance.source"), F.col("instance.source_reason")
    union = availability(source, reason, SOURCE_SENTENCES)
    found = resolved.filter(F.col("status") == "found")
    keep = [c for c in resolved.columns if c not in ("status", "instance", "instance_count")]
    return found.select(
        *keep,
        F.col("instance.capture_id").alias("capture_id"),
        union["status"].alias("status"),
        source["artifact_id"].alias("artifact_id"),
        source["start"].alias("start"),
        source["length"].alias("length"),
        source["display_path"].alias("display_path"),
        source["starting_line"].alias("starting_line"),
        union["reason"].alias("reason"),
        union["message"].alias("message"),
    )


def _jump_tables(
    definitions: DataFrame, keys: Sequence[str], symbol: str, kind: str, target: str
) -> tuple[DataFrame, list[DataFrame]]:
    """Final state of every symbol, and per round the 2^k-hop jumps of the still unresolved ones.

    Pointer doubling: after round k a symbol knows where 2^k hops lead, or where its path ended.
    A round joins only the unresolved symbols; each round is written once, so the plan of a round
    does not contain the earlier ones and lost executors do not force them again.
    """
    # Most symbols are plain functions and never enter a round.
    aliases = F.col(kind) == DIRECT_ALIAS
    ended = (
        F.when(F.col(kind) == FUNCTION, F.lit(BODY))
        .when(F.col(kind).isin(*UNSUPPORTED_KINDS), F.lit(UNSUPPORTED))
        .cast("string")
    )
    terminals = definitions.filter(~aliases).select(
        *keys,
        F.col(symbol).alias("symbol"),
        F.col(symbol).alias("end"),
        ended.alias("status"),
        F.lit(0).cast("bigint").alias("hops"),
    )
    edges = definitions.filter(aliases).select(
        *keys, F.col(symbol).alias("symbol"), F.col(target).alias("jump")
    )
    finals = definitions.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(symbol).alias("__symbol"),
        ended.alias("__status"),
    )
    known = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    # Round zero: one hop, resolved when the target is not an alias or does not exist.
    state = cut_lineage(
        edges.join(finals, [*known, F.col("jump") == F.col("__symbol")], "left").select(
            *keys,
            "symbol",
            "jump",
            F.when(F.col("__symbol").isNull(), F.lit(NO_DEFINITION))
            .otherwise(F.col("__status"))
            .alias("status"),
            F.lit(1).cast("bigint").alias("hops"),
        )
    )
    jumps = [state.select(*keys, "symbol", "jump", "hops", "status")]
    resolved = [state.filter(F.col("status").isNotNull())]
    active = state.filter(F.col("status").isNull())
    left = active.count()
    while left:
        ahead = state.select(
            *[F.col(k).alias(f"__k_{k}") for k in keys],
            F.col("symbol").alias("__symbol"),
            F.col("jump").alias("__jump"),
            F.col("status").alias("__status"),
            F.col("hops").alias("__hops"),
        )
        stepped = cut_lineage(
            active.join(ahead, [*known, F.col("jump") == F.col("__symbol")]).select(
                *keys,
                "symbol",
                F.col("__jump").alias("jump"),
                F.col("__status").alias("status"),
                (F.col("hops") + F.col("__hops")).alias("hops"),
            )
        )
        resolved.append(stepped.filter(F.col("status").isNotNull()))
        jumps.append(stepped)
        active = stepped.filter(F.col("status").isNull())
        before, left = left, active.count()
        # A chain longer than 2^k hops passes a symbol with exactly 2^k + 1 hops to go, which this
        # round resolves. So a round that resolves nothing leaves only symbols that lead to cycles.
        if left == before:
            break
        state = _union([*resolved, active])
    cycles = active.withColumn("status", F.lit(CYCLE))
    closed = _union([*resolved, cycles]).select(
        *keys,
        "symbol",
        F.when(F.col("status") != CYCLE, F.col("jump")).alias("end"),
        "status",
        F.when(F.col("status") != CYCLE, F.col("hops")).alias("hops"),
    )
    return terminals.unionByName(closed), jumps


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def resolve_aliases(
    definitions: DataFrame,
    keys: Sequence[str] = ("capture_id", "compiler_module"),
    symbol: str = "raw_symbol",
    kind: str = "kind",
    target: str = "target",
) -> DataFrame:
    """Where the alias chain of every symbol ends: ``end``, ``status``, ``hops``.

    Chains stay inside one module and may have any depth. A chain that returns to a symbol has
    status ``alias_cycle`` and no end.
    """
    return _jump_tables(definitions, keys, symbol, kind, target)[0]


def alias_paths(
    roots: DataFrame,
    definitions: DataFrame,
    keys: Sequence[str] = ("capture_id", "compiler_module"),
    root: str = "raw_symbol",
    symbol: str = "raw_symbol",
    kind: str = "kind",
    target: str = "target",
) -> DataFrame:
    """The alias symbols from each requested root on, in order: ``(keys, root, step, alias)``.

    One row per step, so a long chain is never collected in a cell. Roots on a cycle give no rows.
    """
    states, jumps = _jump_tables(definitions, keys, symbol, kind, target)
    asked = roots.select(*keys, F.col(root).alias("root")).distinct()
    sound = states.filter((F.col("status") != CYCLE) & (F.col("hops") > 0)).select(
        *keys, F.col("symbol").alias("root"), "hops"
    )
    paths = asked.join(sound, [*keys, "root"]).select(
        *keys, "root", "hops", F.lit(0).cast("bigint").alias("step"), F.col("root").alias("alias")
    )
    # From the longest jump down: every known step at a multiple of 2^(k+1) yields the one 2^k on.
    for k in reversed(range(len(jumps))):
        hop = jumps[k].select(
            *keys, F.col("symbol").alias("alias"), F.col("jump").alias("__to"), F.col("hops").alias("__by")
        )
        reached = paths.join(hop.filter(F.col("__by") == 2**k), [*keys, "alias"]).select(
            *keys, "root", "hops", (F.col("step") + 2**k).alias("step"), F.col("__to").alias("alias")
        )
        paths = cut_lineage(paths.unionByName(reached))
    return paths.filter(F.col("step") < F.col("hops")).drop("hops")


# Fixed order: the first outcome that holds for an instance wins.
OUTCOMES = (CYCLE, "available", UNSUPPORTED, NO_DEFINITION)


def symbol_bodies(
    instances: DataFrame,
    definitions: DataFrame,
    modules: DataFrame,
    instance_id: Sequence[str] = ("capture_id", "ordinal"),
    symbol: str = "raw_symbol",
    scope: Sequence[str] = ("capture_id",),
    module: str = "compiler_module",
) -> DataFrame:
    """Per instance and module that knows its symbol: the chain's end and the body's range."""
    keys = [*scope, module]
    # Written once: terminals, edges, ends and bodies all read it.
    definitions = cut_lineage(definitions.select(*keys, symbol, "kind", "target", "start", "length"))
    states = resolve_aliases(definitions, keys, symbol)
    asked = instances.select(*dict.fromkeys([*instance_id, *scope, symbol]))
    hits = asked.join(states.withColumnRenamed("symbol", symbol), [*scope, symbol])
    bodies = definitions.filter(F.col("kind") == FUNCTION).select(
        *keys, F.col(symbol).alias("end"), "start", "length"
    )
    return (
        hits.join(bodies, [*keys, "end"], "left")
        .join(modules.select(*keys, "artifact_id", "stage"), keys, "left")
        .select(
            *dict.fromkeys([*instance_id, *scope]),
            symbol,
            module,
            "artifact_id",
            "stage",
            "status",
            F.col("end").alias("body_symbol"),
            "hops",
            "start",
            "length",
        )
    )


def order_bodies(bodies: DataFrame, instance_id: Sequence[str], module: str = "compiler_module") -> DataFrame:
    """Bodies of each instance by module name, range start, range length."""
    return bodies.filter(F.col("status") == BODY).orderBy(*instance_id, module, "start", "length")


def outcome_of(statuses: Column) -> Column:
    """Aggregate: rank of the winning outcome over the modules of an instance."""
    rank = (
        F.when(statuses == CYCLE, 0)
        .when(statuses == BODY, 1)
        .when(statuses == UNSUPPORTED, 2)
        .otherwise(3)
    )
    return F.min(rank)


def evidence_outcome(
    instances: DataFrame,
    bodies: DataFrame,
    instance_id: Sequence[str] = ("capture_id", "ordinal"),
    not_captured: DataFrame | None = None,
    scope: Sequence[str] = ("capture_id",),
) -> DataFrame:
    """One outcome per instance: a cycle wins, then bodies, then unsupported, then none.

    ``not_captured`` holds captures whose modules were not collected, with the reason.
    """
    ids = list(instance_id)
    grouped = bodies.groupBy(*ids).agg(
        outcome_of(F.col("status")).alias("__rank"),
        F.count_if(F.col("status") == BODY).alias("__bodies"),
    )
    rows = instances.select(*dict.fromkeys([*ids, *scope])).join(grouped, ids, "left")
    rank = F.coalesce("__rank", F.lit(3))
    outcome = F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), rank + 1)
    reason = F.lit(None).cast("string")
    if not_captured is not None:
        rows = rows.join(
            not_captured.select(*scope, F.col("not_captured_reason").alias("__reason")),
            list(scope),
            "left",
        )
        reason = F.col("__reason")
        outcome = F.when(reason.isNotNull(), F.lit("not_captured")).otherwise(outcome)
    return rows.select(
        *dict.fromkeys([*ids, *scope]),
        outcome.alias("outcome"),
        F.when(outcome == "available", F.col("__bodies"))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("bodies"),
        reason.alias("not_captured_reason"),
    )
