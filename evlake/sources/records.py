"""Scans of a record store: JSON documents per capture, pointer files, artifact files, messages.

Layout below the root: ``captures/<id>/capture.json``, ``captures/<id>/instances.json``,
``captures/<id>/artifact-<16 hex digits>`` and ``candidates/<request key>.json``. Anything beside
these, such as staging directories, is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlake import schema as S
from evlake.functions.identity import CAPTURE_ID, REQUEST_KEY, TOKEN
from evlake.operators.ranges import CHUNK_BYTES
from evlake.session import cut_lineage
from evlake.sources.files import read_file_chunks

_DOCUMENT = "path string, size bigint, raw string"


def _documents(spark: SparkSession, glob: str, limit: int) -> DataFrame:
    """Whole JSON documents with path and size.

    A document over the limit is only listed: its file is pruned by size and never opened.
    """
    try:
        files = spark.read.text(glob, wholetext=True)
    except AnalysisException as error:
        # An absent store is an empty one.
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _DOCUMENT).withColumn("too_large", F.lit(False))
    size = F.col("_metadata.file_size")
    small = files.filter(size <= limit).select(
        F.col("_metadata.file_path").alias("path"),
        size.alias("size"),
        F.col("value").alias("raw"),
        F.lit(False).alias("too_large"),
    )
    large = (
        spark.read.format("binaryFile")
        .load(glob)
        .filter(F.col("length") > limit)
        .select(
            "path",
            F.col("length").alias("size"),
            F.lit(None).cast("string").alias("raw"),
            F.lit(True).alias("too_large"),
        )
    )
    return small.unionByName(large)


def _malformed(raw: Column) -> Column:
    # NULL for text that is not JSON; an array or a scalar has no keys.
    return F.coalesce(
        F.try_parse_json(raw).isNull() | F.json_object_keys(raw).isNull(), F.lit(True)
    )


def _text(fields: tuple[str, ...]) -> str:
    """Schema that keeps every field as its own JSON text."""
    return ", ".join(f"`{f}` string" for f in fields)


def _elements(raw: Column) -> Column:
    return F.from_json(raw, "array<string>")


def scan_headers(spark: SparkSession, root: str) -> DataFrame:
    """One row per header document; broken ones stay, marked, for the rules."""
    return parse_headers(
        _documents(spark, f"{root}/captures/*/capture.json", S.MAX_HEADER_BYTES)
    )


def parse_headers(docs: DataFrame) -> DataFrame:
    """Header rows of documents ``(path, size, raw, too_large)``."""
    fields = F.from_json("raw", _text(S.HEADER_FIELDS)).alias("__f")
    top = docs.select(
        F.regexp_extract("path", r"/captures/([^/]+)/capture\.json$", 1).alias("capture_id"),
        "size",
        "raw",
        "too_large",
        _malformed(F.col("raw")).alias("malformed"),
        fields,
    )
    analysis = F.from_json("__f.analysis", _text(S.ANALYSIS_FIELDS))
    return top.withColumn("__a", analysis).select(
        "capture_id",
        "size",
        "raw",
        "too_large",
        "malformed",
        F.col("__f.format_version").try_cast(S.U64).alias("format_version"),
        F.col("__f.id").alias("id"),
        F.col("__f.completed_at_unix_ms").try_cast(S.U64).alias("completed"),
        F.col("__f.build").alias("raw_build"),
        F.get_json_object("__f.build", "$.target").alias("raw_target"),
        F.from_json("__f.build", S.BUILD_TYPE).alias("build"),
        F.col("__f.compiler").alias("raw_compiler"),
        F.from_json("__f.compiler", S.COMPILER_TYPE).alias("compiler"),
        F.col("__f.analysis").alias("raw_analysis"),
        F.col("__a").alias("analysis"),
        F.from_json("__a.artifact", S.OBSERVATION_JSON)
        .cast(S.OBSERVATION_TYPE)
        .alias("artifact"),
    )


def captures_of(headers: DataFrame, manifests: DataFrame) -> DataFrame:
    """Header rows of readable captures in table form; an id must equal its directory."""
    reason = manifests.select("capture_id", F.col("reason").alias("not_captured_reason"))
    readable = ~F.col("too_large") & ~F.col("malformed")
    good = headers.filter(
        readable
        & (F.col("format_version") == S.FORMAT_VERSION)
        & (F.col("id") == F.col("capture_id"))
    )
    return good.join(reason, "capture_id", "left").select(
        "capture_id",
        F.col("format_version").cast("int").alias("format_version"),
        F.col("completed").try_cast("bigint").alias("completed_at_unix_ms"),
        "build",
        "compiler",
        F.struct(
            F.col("analysis.request_key").alias("request_key"),
            F.col("analysis.token").alias("token"),
            "artifact",
        ).alias("analysis"),
        "not_captured_reason",
    )


def scan_captures(spark: SparkSession, root: str) -> DataFrame:
    """Headers of the store in table form. An absent store gives no rows."""
    return captures_of(scan_headers(spark, root), scan_manifests(spark, root))


def read_captures(requested: DataFrame, captures: DataFrame, violations: DataFrame) -> DataFrame:
    """Point lookups: ``status`` is ``found``, ``missing`` or ``corrupt``."""
    broken = violations.select("capture_id", F.lit(True).alias("__broken")).distinct()
    rows = captures.select("capture_id", F.struct(*captures.columns).alias("capture"))
    status = (
        F.when(F.col("__broken"), F.lit("corrupt"))
        .when(F.col("capture").isNull(), F.lit("missing"))
        .otherwise(F.lit("found"))
    )
    return (
        requested.join(rows, "capture_id", "left")
        .join(broken, "capture_id", "left")
        .select(
            *requested.columns,
            status.alias("status"),
            F.when(status == "found", F.col("capture")).alias("capture"),
        )
    )


def scan_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per manifest document, its parts still JSON text."""
    return parse_manifests(
        _documents(spark, f"{root}/captures/*/instances.json", S.MAX_MANIFEST_BYTES)
    )


def parse_manifests(docs: DataFrame) -> DataFrame:
    """Manifest rows of documents ``(path, size, raw, too_large)``."""
    top = docs.select(
        F.regexp_extract("path", r"/captures/([^/]+)/instances\.json$", 1).alias("capture_id"),
        "size",
        "raw",
        "too_large",
        _malformed(F.col("raw")).alias("malformed"),
        F.from_json("raw", _text(S.MANIFEST_FIELDS)).alias("__f"),
    )
    return top.select(
        "capture_id",
        "size",
        "raw",
        "too_large",
        "malformed",
        F.col("__f.format_version").try_cast(S.U64).alias("format_version"),
        F.col("__f.capture_id").alias("id"),
        *[F.col(f"__f.{f}").alias(f"raw_{f}") for f in S.MANIFEST_FIELDS[2:]],
        _elements(F.get_json_object("__f.llvm", "$.collected")).alias("collected"),
        F.get_json_object("__f.llvm", "$.not_captured").alias("reason"),
    )


@dataclass(frozen=True)
class Evidence:
    """A store as tables, with the raw text each rule needs beside the typed columns."""

    headers: DataFrame
    manifests: DataFrame
    instances: DataFrame
    placements: DataFrame
    artifacts: DataFrame
    provenance: DataFrame
    modules: DataFrame
    definitions: DataFrame
    files: DataFrame | None = None


def _u64(column: str) -> Column:
    return F.col(column).try_cast(S.U64)


def scan_evidence(spark: SparkSession, root: str, with_files: bool = True) -> Evidence:
    """All tables of a store."""
    return evidence_of(
        scan_headers(spark, root),
        scan_manifests(spark, root),
        scan_artifact_files(spark, root) if with_files else None,
    )


def evidence_of(headers: DataFrame, manifests: DataFrame, files: DataFrame | None) -> Evidence:
    """All tables of parsed records. A document's arrays are bounded by the document size limit.

    Every JSON document is read and taken apart once: the tables are written to the shared folder,
    and the many rules then read only the columns they need.
    """
    manifests = cut_lineage(manifests)
    good = manifests.filter(
        ~F.col("too_large") & ~F.col("malformed") & (F.col("format_version") == S.FORMAT_VERSION)
    )
    instances = cut_lineage(_instances(good))
    modules = cut_lineage(_modules(good))
    return Evidence(
        headers=cut_lineage(headers),
        manifests=manifests,
        instances=instances,
        placements=cut_lineage(_placements(instances)),
        artifacts=cut_lineage(_artifacts(good)),
        provenance=cut_lineage(_provenance(good)),
        modules=modules,
        definitions=cut_lineage(_definitions(modules)),
        files=None if files is None else cut_lineage(files),
    )


def _instances(good: DataFrame) -> DataFrame:
    one = good.select("capture_id", F.posexplode(_elements(F.col("raw_instances"))).alias("ordinal", "raw"))
    f = one.withColumn("__f", F.from_json("raw", _text(S.INSTANCE_FIELDS))).select(
        "*", F.from_json("__f.definition", _text(S.DEFINITION_NAME_FIELDS)).alias("__d")
    )
    f = f.withColumn("raw_available", F.get_json_object("__f.source", "$.available"))
    f = f.withColumn("__s", F.from_json("raw_available", _text(S.SOURCE_FIELDS)))
    f = f.withColumn("__r", F.from_json("__s.range", _text(S.RANGE_FIELDS)))
    source = F.struct(
        _u64("__s.artifact").alias("artifact_id"),
        _u64("__r.start").alias("start"),
        _u64("__r.length").alias("length"),
        F.col("__s.display_path").alias("display_path"),
        _u64("__s.starting_line").alias("starting_line"),
    )
    return f.select(
        "capture_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "raw",
        F.col("__f.definition").alias("raw_definition"),
        F.col("__d.crate_name").alias("crate_name"),
        F.col("__d.definition_path").alias("definition_path"),
        F.col("__f.display_name").alias("display_name"),
        F.col("__f.raw_symbol").alias("raw_symbol"),
        _elements(F.col("__f.placements")).alias("raw_placements"),
        F.from_json(
            "__f.placements", "array<struct<codegen_unit:string>>"
        ).alias("placements"),
        F.col("__f.source").alias("raw_source"),
        "raw_available",
        F.col("__s.range").alias("raw_range"),
        F.when(F.col("raw_available").isNotNull(), source).alias("source"),
        F.get_json_object("__f.source", "$.unavailable").alias("source_reason"),
    )


def _placements(instances: DataFrame) -> DataFrame:
    one = instances.select(
        "capture_id", "ordinal", F.posexplode("raw_placements").alias("placement_no", "raw")
    )
    f = one.withColumn("__f", F.from_json("raw", _text(S.PLACEMENT_FIELDS)))
    return f.select(
        "capture_id",
        "ordinal",
        F.col("placement_no").cast("bigint").alias("placement_no"),
        "raw",
        *[F.col(f"__f.{n}").alias(n) for n in ("codegen_unit", "linkage", "visibility")],
        F.col("__f.local_copy").try_cast("boolean").alias("local_copy"),
        _u64("__f.size_estimate").alias("size_estimate"),
    )


def _artifacts(good: DataFrame) -> DataFrame:
    one = good.select("capture_id", F.explode(_elements(F.col("raw_artifacts"))).alias("raw"))
    f = one.withColumn("__f", F.from_json("raw", _text(S.ARTIFACT_FIELDS)))
    return f.select(
        "capture_id",
        "raw",
        _u64("__f.id").alias("artifact_id"),
        F.col("__f.kind").alias("kind"),
        _u64("__f.byte_len").alias("byte_len"),
    )


def _provenance(good: DataFrame) -> DataFrame:
    f = good.filter(F.col("raw_llvm_provenance").isNotNull()).select(
        "capture_id",
        F.col("raw_llvm_provenance").alias("raw"),
        F.col("collected").isNotNull().alias("collected"),
        F.from_json("raw_llvm_provenance", _text(S.PROVENANCE_FIELDS)).alias("__f"),
    )
    return f.select(
        "capture_id",
        "raw",
        "collected",
        *[
            F.col(f"__f.{n}").alias(n)
            for n in ("backend", "llvm_version", "target", "optimization", "lto")
        ],
        *[
            F.col(f"__f.{n}").try_cast("boolean").alias(n)
            for n in ("incremental", "linker_plugin_lto")
        ],
        *[_u64(f"__f.{n}").alias(n) for n in ("codegen_units", "recipe_revision")],
    )


def _modules(good: DataFrame) -> DataFrame:
    one = good.select("capture_id", F.posexplode("collected").alias("module_no", "raw"))
    f = one.withColumn("__f", F.from_json("raw", _text(S.MODULE_FIELDS)))
    return f.select(
        "capture_id",
        "module_no",
        "raw",
        _u64("__f.artifact").alias("artifact_id"),
        F.col("__f.compiler_module").alias("compiler_module"),
        F.col("__f.stage").alias("stage"),
        _elements(F.col("__f.definitions")).alias("raw_definitions"),
    )


def _definitions(modules: DataFrame) -> DataFrame:
    one = modules.select(
        "capture_id", "compiler_module", "artifact_id", F.explode("raw_definitions").alias("raw")
    )
    f = one.withColumn("__f", F.from_json("raw", _text(S.MODULE_DEFINITION_FIELDS)))
    f = f.withColumn("__r", F.from_json("__f.range", _text(S.RANGE_FIELDS)))
    target = F.get_json_object("__f.kind", "$.direct_alias.target")
    is_alias = F.get_json_object("__f.kind", "$.direct_alias").isNotNull()
    return f.select(
        "capture_id",
        "compiler_module",
        "artifact_id",
        "raw",
        F.col("__f.raw_symbol").alias("raw_symbol"),
        F.col("__f.range").alias("raw_range"),
        _u64("__r.start").alias("start"),
        _u64("__r.length").alias("length"),
        # The kind is a plain word, or an object when it has a payload.
        F.when(is_alias, F.lit("direct_alias")).otherwise(F.col("__f.kind")).alias("kind"),
        target.alias("target"),
    )


def scan_artifact_files(spark: SparkSession, root: str) -> DataFrame:
    """Stored artifact files: id from the name and length. The content is not read."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/captures/*/artifact-*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "capture_id string, artifact_id decimal(20,0), file_len bigint")
    name = r"/captures/([^/]+)/artifact-([0-9a-f]{16})$"
    return files.filter(F.col("path").rlike(name)).select(
        F.regexp_extract("path", name, 1).alias("capture_id"),
        F.conv(F.regexp_extract("path", name, 2), 16, 10).cast(S.U64).alias("artifact_id"),
        F.col("length").alias("file_len"),
    )


def read_artifact_chunks(
    spark: SparkSession, root: str, declared: DataFrame, chunk: int = CHUNK_BYTES
) -> DataFrame:
    """``capture_id, artifact_id, chunk_no, bytes`` of declared artifact files, of any length.

    Other files beside a manifest are not opened. A file is read by as many tasks as it has ranges,
    and no cell holds more than a chunk.
    """
    files = spark.read.format("binaryFile").load(f"{root}/captures/*/artifact-*").select("path", "length")
    ids = ["capture_id", "artifact_id"]
    return read_file_chunks(declared_only(named_files(files), declared).select(*ids, "path", "length"), ids, chunk)


def named_files(files: DataFrame) -> DataFrame:
    """Capture and artifact id from the ``path`` of files named like stored artifacts; others go."""
    name = r"/captures/([^/]+)/artifact-([0-9a-f]{16})$"
    ids = {
        "capture_id": F.regexp_extract("path", name, 1),
        "artifact_id": F.conv(F.regexp_extract("path", name, 2), 16, 10).cast(S.U64),
    }
    return files.filter(F.col("path").rlike(name)).withColumns(ids)


def declared_only(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Files that the artifact table declares."""
    ids = declared.select("capture_id", F.col("artifact_id").cast(S.U64).alias("artifact_id"))
    return files.join(ids, ["capture_id", "artifact_id"], "left_semi")


def scan_candidates(
    spark: SparkSession, root: str, limit: int = S.MAX_HEADER_BYTES
) -> DataFrame:
    """Pointer documents of a store; see `parse_candidates`."""
    return parse_candidates(_documents(spark, f"{root}/candidates/*.json", limit))


def parse_candidates(docs: DataFrame) -> DataFrame:
    """Pointers of documents with ``path``, ``raw`` and ``too_large``.

    ``rule`` names what is wrong with a pointer, NULL for a sound one. A field that is absent, null
    or not text is missing; then key, token and id must have their formats, and the key its file.
    """
    key = F.regexp_extract("path", r"/candidates/([^/]+)\.json$", 1)
    f = docs.select(
        key.alias("file_key"),
        "raw",
        "too_large",
        _malformed(F.col("raw")).alias("malformed"),
        F.from_json("raw", _text(S.POINTER_FIELDS)).alias("__f"),
    )
    known = F.array(*[F.lit(x) for x in S.POINTER_FIELDS])
    rule = (
        F.when(F.col("too_large"), F.lit("record_too_large"))
        .when(F.col("malformed"), F.lit("malformed_json"))
        .when(
            F.size(F.array_except(F.json_object_keys("raw"), known)) > 0,
            F.lit("unknown_field:pointer"),
        )
        .when(
            ~F.coalesce(
                F.col("__f.format_version").try_cast("int") == S.POINTER_VERSION, F.lit(False)
            ),
            F.lit("unsupported_version"),
        )
    )
    for name in ("request_key", "token", "capture_id"):
        text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw"), f"$.{name}", "variant"))
        rule = rule.when(~F.coalesce(text == "STRING", F.lit(False)), F.lit(f"missing_field:{name}"))
    for name, pattern in (("request_key", REQUEST_KEY), ("token", TOKEN), ("capture_id", CAPTURE_ID)):
        sound = F.col(f"__f.{name}").rlike(pattern)
        rule = rule.when(~sound, F.lit(f"format:{name}"))
    rule = rule.when(~F.col("__f.request_key").eqNullSafe(F.col("file_key")), F.lit("wrong_key"))
    return f.select(
        F.col("file_key").alias("request_key"),
        F.col("__f.token").alias("token"),
        F.col("__f.capture_id").alias("capture_id"),
        rule.alias("rule"),
    )


# --- build messages ------------------------------------------------------------------------------

MESSAGE_TYPE = (
    "reason string, package_id string, target struct<kind:array<string>,"
    "crate_types:array<string>,name:string,src_path:string>, fresh boolean, success boolean, "
    "message struct<level:string,message:string,rendered:string>"
)


def parse_messages(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON message lines; a line that is not a message stays as text, empty lines go."""
    parsed = F.from_json(line, MESSAGE_TYPE)
    keep = [c for c in lines.columns if c != line]
    text = F.col("__m.reason").isNull()
    return (
        lines.filter(F.col(line) != "")
        .withColumn("__m", parsed)
        .select(
            *keep,
            F.when(text, F.lit("text")).otherwise(F.col("__m.reason")).alias("reason"),
            "__m.package_id",
            "__m.target",
            "__m.fresh",
            "__m.success",
            F.col("__m.message.level").alias("level"),
            F.when(text, F.col(line))
            .otherwise(F.coalesce("__m.message.rendered", "__m.message.message"))
            .alias("rendered"),
            F.col(line).alias("raw"),
        )
    )


def scan_build_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message files, one build per file: ``build_id`` is the file name without its extension."""
    lines = spark.read.text(path).select(
        "value",
        F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1).alias("build_id"),
    )
    return parse_messages(lines)
