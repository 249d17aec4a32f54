"""Every broken rule as a row ``(capture_id, rule, entity, detail)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlake import schema as S
from evlake.functions.display import COLLECTION_SENTENCES, SOURCE_SENTENCES
from evlake.functions.identity import CAPTURE_ID, I64_MAX, REQUEST_KEY, TOKEN, U64_MAX

Rule = tuple[str, Column, Column]


def row_rules(df: DataFrame, capture: Column, entity: Column, rules: Sequence[Rule]) -> DataFrame:
    """Evaluate row-local rules ``(name, broken, detail)`` in one pass over the rows."""
    found = [
        F.when(
            F.coalesce(broken, F.lit(False)),
            F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")),
        )
        for name, broken, detail in rules
    ]
    return df.select(
        capture.cast("string").alias("capture_id"),
        entity.cast("string").alias("entity"),
        F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())).alias("__v"),
    ).select("capture_id", "__v.rule", "entity", "__v.detail")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the count."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def missing_references(
    rows: DataFrame, keys: Sequence[str], known: DataFrame, known_keys: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose key does not exist on the other side."""
    right = known.select(
        *[F.col(k).alias(n) for k, n in zip(known_keys or keys, keys, strict=True)]
    )
    return rows.join(right, list(keys), "left_anti")


def bad_artifact_references(
    references: DataFrame, artifacts: DataFrame, scope: Sequence[str], kind: str
) -> DataFrame:
    """References (``artifact_id``, ``start``, ``length``) that are unknown, of the wrong kind, or
    end past the artifact. Adds ``rule``."""
    known = artifacts.select(
        *scope, "artifact_id", F.col("kind").alias("__kind"), F.col("byte_len").alias("__len")
    )
    end = F.col("start").cast("decimal(21,0)") + F.col("length").cast("decimal(21,0)")
    rule = (
        F.when(F.col("__kind").isNull(), F.lit("unknown_artifact"))
        .when(F.col("__kind") != kind, F.lit("wrong_artifact_kind"))
        .when(end > F.col("__len"), F.lit("range_past_end"))
    )
    return (
        references.join(known, [*scope, "artifact_id"], "left")
        .withColumn("rule", rule)
        .filter(F.col("rule").isNotNull())
        .drop("__kind", "__len")
    )


# --- column-level checks -------------------------------------------------------------------------


def is_empty(c: Column) -> Column:
    """Missing or empty."""
    return F.coalesce(c == "", F.lit(True))


def not_normalized(path: Column) -> Column:
    """Not an absolute path in lexical normal form."""
    bad = (
        ~path.startswith("/")
        | path.contains("//")
        | path.rlike(r"(^|/)\.{1,2}(/|\z)")
        | ((F.length(path) > 1) & path.endswith("/"))
    )
    return F.coalesce(bad, F.lit(True))


def not_u64(n: Column) -> Column:
    top = F.lit(str(U64_MAX)).cast("decimal(20,0)")
    return F.coalesce((n < 0) | (n > top), F.lit(True))


def not_storable(n: Column) -> Column:
    """A valid unsigned number the tables cannot hold as BIGINT."""
    return n.between(F.lit(str(I64_MAX)).cast("decimal(20,0)") + 1, F.lit(str(U64_MAX)).cast("decimal(20,0)"))


def unknown_fields(raw: Column, expected: Sequence[str]) -> Column:
    """Fields of a JSON object outside the expected ones, in order; empty when there are none."""
    return F.array_sort(_other_fields(raw, expected))


def _other_fields(raw: Column, expected: Sequence[str]) -> Column:
    known = F.array(*[F.lit(e) for e in expected])
    return F.array_except(F.json_object_keys(raw), known)


def field_rule(level: str, raw: Column, expected: Sequence[str]) -> Rule:
    # Sorted for the detail only: most records have no such field.
    extra = F.size(_other_fields(raw, expected)) > 0
    return (f"unknown_field:{level}", extra, F.array_join(unknown_fields(raw, expected), ","))


def text_rules(level: str, columns: dict[str, Column]) -> list[Rule]:
    return [(f"empty:{level}.{n}", is_empty(c), F.lit(n)) for n, c in columns.items()]


def number_rules(level: str, columns: dict[str, Column]) -> list[Rule]:
    rules: list[Rule] = []
    for n, c in columns.items():
        rules.append((f"not_u64:{level}.{n}", not_u64(c), c))
        rules.append((f"not_storable:{level}.{n}", not_storable(c), c))
    return rules


# --- rules of each record ------------------------------------------------------------------------


def header_rules(headers: DataFrame) -> DataFrame:
    """Header rules. A record of another version reports only that."""
    c = F.col
    ok = F.coalesce(c("format_version") == S.FORMAT_VERSION, F.lit(False))
    b, k, a, o = c("build"), c("compiler"), c("analysis"), c("artifact")
    t = o["target"]
    rules: list[Rule] = [
        ("record_too_large", c("too_large"), c("size")),
        ("malformed_json", ~c("too_large") & c("malformed"), F.lit("header")),
    ]
    readable = ~c("too_large") & ~c("malformed")
    rules.append(("unsupported_version", readable & ~ok, c("format_version")))
    rest: list[Rule] = [
        ("capture_id_format", ~F.coalesce(c("id").rlike(CAPTURE_ID), F.lit(False)), c("id")),
        ("id_differs_from_directory", ~c("id").eqNullSafe(c("capture_id")), c("id")),
        field_rule("header", c("raw"), S.HEADER_FIELDS),
        field_rule("build", c("raw_build"), S.BUILD_FIELDS),
        field_rule("build.target", c("raw_target"), S.TARGET_FIELDS),
        *number_rules("header", {"completed_at_unix_ms": c("completed")}),
        *text_rules(
            "build",
            {
                n: b[n]
                for n in (
                    "package",
                    "package_version",
                    "profile",
                    "cargo_program",
                    "invocation_directory",
                )
            },
        ),
        *text_rules("build.target", {"name": b["target"]["name"]}),
        (
            "domain:target.kind",
            ~F.coalesce(b["target"]["kind"].isin(*S.TARGET_KINDS), F.lit(False)),
            b["target"]["kind"],
        ),
        (
            "relative_directory",
            ~is_empty(b["invocation_directory"]) & ~b["invocation_directory"].startswith("/"),
            b["invocation_directory"],
        ),
        ("empty:build.cargo_arguments", F.coalesce(F.size(b["cargo_arguments"]) < 1, F.lit(True)), F.lit("")),
        ("missing:compiler", c("raw_compiler").isNull(), F.lit("compiler")),
        ("missing:analysis", c("raw_analysis").isNull(), F.lit("analysis")),
    ]
    has_compiler, has_analysis = c("raw_compiler").isNotNull(), c("raw_analysis").isNotNull()
    for name, broken, detail in [
        field_rule("compiler", c("raw_compiler"), S.COMPILER_FIELDS),
        *text_rules("compiler", {n: k[n] for n in ("release", "commit_hash", "host")}),
        ("path:compiler.rustc", not_normalized(k["rustc"]), k["rustc"]),
        ("path:compiler.sysroot", not_normalized(k["sysroot"]), k["sysroot"]),
    ]:
        rest.append((name, has_compiler & broken, detail))
    for name, broken, detail in [
        field_rule("analysis", c("raw_analysis"), S.ANALYSIS_FIELDS),
        (
            "request_key_format",
            ~F.coalesce(a["request_key"].rlike(REQUEST_KEY), F.lit(False)),
            a["request_key"],
        ),
        ("token_format", ~F.coalesce(a["token"].rlike(TOKEN), F.lit(False)), a["token"]),
        *text_rules(
            "artifact",
            {
                "package_id": o["package_id"],
                "target.name": t["name"],
                "profile.opt_level": o["profile"]["opt_level"],
            },
        ),
        (
            "empty:artifact.target.kinds",
            F.coalesce((F.size(t["kind"]) < 1) | (F.size(t["crate_types"]) < 1), F.lit(True)),
            F.lit(""),
        ),
        (
            "empty:artifact.list_entry",
            F.exists(
                F.concat(
                    *[
                        F.coalesce(x, F.array().cast("array<string>"))
                        for x in (
                            t["kind"],
                            t["crate_types"],
                            t["required_features"],
                            o["features"],
                        )
                    ]
                ),
                is_empty,
            ),
            F.lit(""),
        ),
        ("path:artifact.manifest_path", not_normalized(o["manifest_path"]), o["manifest_path"]),
        ("path:artifact.src_path", not_normalized(t["src_path"]), t["src_path"]),
        (
            "path:artifact.output",
            F.exists(
                F.array_compact(
                    F.concat(
                        F.coalesce(o["filenames"], F.array().cast("array<string>")),
                        F.array(o["executable"]),
                    )
                ),
                not_normalized,
            ),
            F.lit(""),
        ),
    ]:
        rest.append((name, has_analysis & broken, detail))
    rules += [(n, readable & ok & b, d) for n, b, d in rest]
    return row_rules(headers, c("capture_id"), F.lit("header"), rules)


def manifest_rules(manifests: DataFrame) -> DataFrame:
    c = F.col
    readable = ~c("too_large") & ~c("malformed")
    ok = readable & F.coalesce(c("format_version") == S.FORMAT_VERSION, F.lit(False))
    rules: list[Rule] = [
        ("record_too_large", c("too_large"), c("size")),
        ("malformed_json", ~c("too_large") & c("malformed"), F.lit("manifest")),
        ("unsupported_version", readable & ~ok, c("format_version")),
        ("id_differs_from_directory", ok & ~c("id").eqNullSafe(c("capture_id")), c("id")),
    ]
    rules += [
        (n, ok & b, d)
        for n, b, d in [
            field_rule("manifest", c("raw"), S.MANIFEST_FIELDS),
            *[(f"missing:{f}", c(f"raw_{f}").isNull(), F.lit(f)) for f in S.MANIFEST_FIELDS[2:]],
            (
                "domain:llvm",
                c("raw_llvm").isNotNull()
                & ((c("collected").isNotNull()).cast("int") + (c("reason").isNotNull()).cast("int") != 1),
                c("raw_llvm"),
            ),
            (
                "domain:not_captured_reason",
                c("reason").isNotNull() & ~c("reason").isin(*_reasons("collection")),
                c("reason"),
            ),
        ]
    ]
    return row_rules(manifests, c("capture_id"), F.lit("manifest"), rules)


def _reasons(which: str) -> tuple[str, ...]:
    return tuple(COLLECTION_SENTENCES if which == "collection" else SOURCE_SENTENCES)


def _range_rules(level: str, start: Column, length: Column) -> list[Rule]:
    end = start.cast("decimal(21,0)") + length.cast("decimal(21,0)")
    return [
        *number_rules(level, {"start": start, "length": length}),
        (f"range_overflow:{level}", end > F.lit(str(U64_MAX)).cast("decimal(21,0)"), end),
    ]


def instance_rules(instances: DataFrame) -> DataFrame:
    c = F.col
    src = c("source")
    has = src.isNotNull()
    rules: list[Rule] = [
        field_rule("instance", c("raw"), S.INSTANCE_FIELDS),
        field_rule("definition", c("raw_definition"), S.DEFINITION_NAME_FIELDS),
        *text_rules(
            "instance",
            {n: c(n) for n in ("crate_name", "definition_path", "display_name", "raw_symbol")},
        ),
        ("no_placements", F.coalesce(F.size("placements") < 1, F.lit(True)), F.lit("")),
        (
            "duplicate_codegen_unit",
            F.size(F.array_distinct(c("placements.codegen_unit"))) < F.size("placements"),
            F.lit(""),
        ),
        (
            "domain:source",
            (has.cast("int") + c("source_reason").isNotNull().cast("int")) != 1,
            c("raw_source"),
        ),
        (
            "domain:source_reason",
            c("source_reason").isNotNull() & ~c("source_reason").isin(*_reasons("source")),
            c("source_reason"),
        ),
    ]
    rules += [
        (n, has & b, d)
        for n, b, d in [
            field_rule("source", c("raw_available"), S.SOURCE_FIELDS),
            field_rule("source.range", c("raw_range"), S.RANGE_FIELDS),
            *_range_rules("source.range", src["start"], src["length"]),
            *number_rules("source", {"artifact": src["artifact_id"], "starting_line": src["starting_line"]}),
            ("zero_line", src["starting_line"] == 0, src["starting_line"]),
            ("empty:source.display_path", is_empty(src["display_path"]), F.lit("")),
        ]
    ]
    return row_rules(instances, c("capture_id"), F.concat(F.lit("instance "), c("ordinal")), rules)


def placement_rules(placements: DataFrame) -> DataFrame:
    c = F.col
    rules: list[Rule] = [
        field_rule("placement", c("raw"), S.PLACEMENT_FIELDS),
        *text_rules("placement", {n: c(n) for n in ("codegen_unit", "linkage", "visibility")}),
        ("missing:placement.local_copy", c("local_copy").isNull(), F.lit("")),
        *number_rules("placement", {"size_estimate": c("size_estimate")}),
    ]
    entity = F.concat(F.lit("instance "), c("ordinal"), F.lit(" placement "), c("placement_no"))
    return row_rules(placements, c("capture_id"), entity, rules)


def artifact_rules(artifacts: DataFrame) -> DataFrame:
    c = F.col
    rules: list[Rule] = [
        field_rule("artifact", c("raw"), S.ARTIFACT_FIELDS),
        *number_rules("artifact", {"id": c("artifact_id"), "byte_len": c("byte_len")}),
        ("domain:artifact.kind", ~F.coalesce(c("kind").isin(*S.ARTIFACT_KINDS), F.lit(False)), c("kind")),
    ]
    return row_rules(artifacts, c("capture_id"), F.concat(F.lit("artifact "), c("artifact_id")), rules)


def provenance_rules(provenance: DataFrame) -> DataFrame:
    c = F.col
    rules: list[Rule] = [
        field_rule("provenance", c("raw"), S.PROVENANCE_FIELDS),
        *text_rules("provenance", {"backend": c("backend"), "target": c("target")}),
        ("empty:provenance.llvm_version", c("llvm_version") == "", F.lit("")),
        (
            "domain:provenance.optimization",
            ~F.coalesce(c("optimization").isin(*S.OPTIMIZATIONS), F.lit(False)),
            c("optimization"),
        ),
        ("domain:provenance.lto", ~F.coalesce(c("lto").isin(*S.LTO_MODES), F.lit(False)), c("lto")),
        (
            "missing:provenance.flag",
            c("incremental").isNull() | c("linker_plugin_lto").isNull(),
            F.lit(""),
        ),
        ("zero:provenance.codegen_units", F.coalesce(c("codegen_units") < 1, F.lit(True)), c("codegen_units")),
        ("zero:provenance.recipe_revision", F.coalesce(c("recipe_revision") < 1, F.lit(True)), c("recipe_revision")),
        (
            "unsupported_collection",
            c("collected")
            & (
                (c("backend") != "llvm")
                | c("llvm_version").isNull()
                | c("incremental")
                | c("linker_plugin_lto")
                | ~c("lto").isin("off", "local_thin")
            ),
            c("backend"),
        ),
    ]
    return row_rules(provenance, c("capture_id"), F.lit("provenance"), rules)


def module_rules(modules: DataFrame, provenance: DataFrame) -> DataFrame:
    c = F.col
    agrees = reduce(
        lambda a, b: a | b, [(c("stage") == s) & (c("lto") == m) for s, m in S.STAGE_OF_LTO]
    )
    rules: list[Rule] = [
        field_rule("module", c("raw"), S.MODULE_FIELDS),
        *text_rules("module", {"compiler_module": c("compiler_module")}),
        *number_rules("module", {"artifact": c("artifact_id")}),
        ("domain:module.stage", ~F.coalesce(c("stage").isin(*S.STAGES), F.lit(False)), c("stage")),
        ("stage_disagrees_with_lto", ~F.coalesce(agrees, F.lit(False)), c("stage")),
    ]
    joined = modules.join(provenance.select("capture_id", "lto"), "capture_id", "left")
    return row_rules(joined, c("capture_id"), F.concat(F.lit("module "), c("compiler_module")), rules)


def definition_rules(definitions: DataFrame) -> DataFrame:
    c = F.col
    rules: list[Rule] = [
        field_rule("definition", c("raw"), S.MODULE_DEFINITION_FIELDS),
        field_rule("definition.range", c("raw_range"), S.RANGE_FIELDS),
        *text_rules("definition", {"raw_symbol": c("raw_symbol")}),
        *_range_rules("definition.range", c("start"), c("length")),
        (
            "domain:definition.kind",
            ~F.coalesce(c("kind").isin(*S.DEFINITION_KINDS), F.lit(False)),
            c("kind"),
        ),
        ("empty:definition.target", (c("kind") == "direct_alias") & is_empty(c("target")), F.lit("")),
    ]
    entity = F.concat(F.lit("definition "), c("compiler_module"), F.lit(" "), c("raw_symbol"))
    return row_rules(definitions, c("capture_id"), entity, rules)


def _as_violation(df: DataFrame, rule: Column, entity: Column, detail: Column) -> DataFrame:
    return df.select(
        F.col("capture_id").cast("string").alias("capture_id"),
        rule.alias("rule"),
        entity.cast("string").alias("entity"),
        detail.cast("string").alias("detail"),
    )


def relation_rules(ev) -> DataFrame:
    """Rules across the tables of one capture: duplicates, references, coverage."""
    c = F.col
    duplicates = [
        ("duplicate_artifact", ev.artifacts, ["capture_id", "artifact_id"]),
        (
            "duplicate_instance",
            ev.instances,
            ["capture_id", "crate_name", "definition_path", "display_name", "raw_symbol"],
        ),
        ("duplicate_module", ev.modules, ["capture_id", "compiler_module"]),
        ("duplicate_module_artifact", ev.modules, ["capture_id", "artifact_id"]),
        ("duplicate_symbol", ev.definitions, ["capture_id", "compiler_module", "raw_symbol"]),
    ]
    found = [
        _as_violation(
            duplicate_keys(df, keys),
            F.lit(rule),
            F.concat_ws(" ", *[c(k).cast("string") for k in keys[1:]]),
            c("rows"),
        )
        for rule, df, keys in duplicates
    ]
    sources = ev.instances.filter(c("source").isNotNull()).select(
        "capture_id",
        F.concat(F.lit("instance "), c("ordinal")).alias("entity"),
        c("source.artifact_id").alias("artifact_id"),
        c("source.start").alias("start"),
        c("source.length").alias("length"),
    )
    zero = F.lit(0).cast("decimal(20,0)")
    module_ranges = ev.modules.select(
        "capture_id",
        F.concat(F.lit("module "), c("compiler_module")).alias("entity"),
        "artifact_id",
        zero.alias("start"),
        zero.alias("length"),
    ).unionByName(
        ev.definitions.select(
            "capture_id",
            F.concat(F.lit("definition "), c("compiler_module"), F.lit(" "), c("raw_symbol")).alias(
                "entity"
            ),
            "artifact_id",
            "start",
            "length",
        )
    )
    for rows, kind in ((sources, "source"), (module_ranges, "llvm")):
        bad = bad_artifact_references(rows, ev.artifacts, ["capture_id"], kind)
        found.append(_as_violation(bad, c("rule"), c("entity"), c("artifact_id")))
    collected = ev.manifests.filter(c("collected").isNotNull()).select("capture_id")
    placed = (
        ev.placements.select("capture_id", "codegen_unit")
        .distinct()
        .join(collected, "capture_id", "left_semi")
    )
    uncollected = missing_references(
        placed, ["capture_id", "codegen_unit"], ev.modules, ["capture_id", "compiler_module"]
    )
    found.append(
        _as_violation(uncollected, F.lit("missing_module"), c("codegen_unit"), c("codegen_unit"))
    )
    orphans = missing_references(
        ev.artifacts.filter(c("kind") == "llvm"), ["capture_id", "artifact_id"], ev.modules
    )
    found.append(
        _as_violation(orphans, F.lit("orphan_artifact"), c("artifact_id"), c("artifact_id"))
    )
    return union_all(found)


def file_rules(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Declared artifacts whose stored file is missing or has another length."""
    joined = artifacts.join(files, ["capture_id", "artifact_id"], "left")
    rules: list[Rule] = [
        ("missing_file", F.col("file_len").isNull(), F.col("artifact_id")),
        ("file_length", F.col("file_len") != F.col("byte_len"), F.col("file_len")),
    ]
    return row_rules(joined, F.col("capture_id"), F.concat(F.lit("artifact "), F.col("artifact_id")), rules)


def presence_rules(headers: DataFrame, manifests: DataFrame) -> DataFrame:
    """A capture needs both records."""
    return _as_violation(
        missing_references(headers, ["capture_id"], manifests),
        F.lit("missing_manifest"),
        F.lit("header"),
        F.lit(""),
    ).unionByName(
        _as_violation(
            missing_references(manifests, ["capture_id"], headers),
            F.lit("missing_header"),
            F.lit("manifest"),
            F.lit(""),
        )
    )


def conflict_rules(groups: DataFrame) -> DataFrame:
    """Assembled instances whose rows disagree on their source."""
    return _as_violation(
        groups.filter("conflict"), F.lit("source_conflict"), F.col("raw_symbol"), F.col("placements")
    )


def expected_module_rules(expected: DataFrame, configuration: DataFrame) -> DataFrame:
    """Modules a collection announces: unique names and paths, none when it is unsupported."""
    c = F.col
    frames = [
        _as_violation(
            duplicate_keys(expected, ["capture_id", key]), F.lit(f"duplicate_expected_{key}"), c(key), c("rows")
        )
        for key in ("name", "path")
    ]
    unsupported = configuration.filter(c("unsupported").isNotNull()).select("capture_id")
    frames.append(
        _as_violation(
            expected.join(unsupported, "capture_id", "left_semi"),
            F.lit("module_of_unsupported_collection"),
            c("name"),
            c("path"),
        )
    )
    return union_all(frames)


def published_rules(batch: DataFrame, captures: DataFrame) -> DataFrame:
    """Ids of the batch that the lake already holds."""
    known = captures.select("capture_id")
    return _as_violation(
        batch.join(known, "capture_id", "left_semi"),
        F.lit("already_published"),
        F.col("capture_id"),
        F.lit(""),
    )


def evidence_violations(ev) -> DataFrame:
    """All rules over a scanned store (`evlake.sources.records.Evidence`)."""
    frames = [
        header_rules(ev.headers),
        manifest_rules(ev.manifests),
        presence_rules(ev.headers, ev.manifests),
        instance_rules(ev.instances),
        placement_rules(ev.placements),
        artifact_rules(ev.artifacts),
        provenance_rules(ev.provenance),
        module_rules(ev.modules, ev.provenance),
        definition_rules(ev.definitions),
        relation_rules(ev),
    ]
    if ev.files is not None:
        frames.append(file_rules(ev.artifacts, ev.files))
    return union_all(frames)


def accepted_captures(captures: DataFrame, violations: DataFrame) -> DataFrame:
    return captures.join(violations.select("capture_id"), "capture_id", "left_anti")
