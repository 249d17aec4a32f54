"""Integrity, observation, ingestion and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlake.functions import display, identity
from evlake.operators import integrity, observe
from evlake.operators.scale import dealt
from evlake.plans.registry import query, table
from evlake.plans.search_queries import _order_captures
from evlake.schema import STAGES
from evlake.schema import U64 as _U64
from evlake.session import shared_path
from evlake.sources.lake import CommittedBatch, Lake
from evlake.sources.records import (
    evidence_of,
    parse_candidates,
    parse_headers,
    parse_manifests,
    parse_messages,
    read_captures,
)
from evlake.streaming.completion import completion_stream as run_completion
from evlake.streaming.publish import publish_stream as run_publish
from evlake.streaming.timed import spans_of, timed_completion

# --- integrity -----------------------------------------------------------------------------------


@query(
    "duplicate_keys",
    """
    select l_orderkey, l_linenumber, count(*) as rows
    from lineitem group by 1, 2 having count(*) > 1""",
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_keys(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


@query(
    "missing_refs",
    """
    select 'customer without order' as rule, c_custkey as entity from customer
      where c_custkey not in (select o_custkey from orders)
    union all select 'order without customer', o_orderkey from orders
      where o_custkey not in (select c_custkey from customer)
    union all select 'order without line', o_orderkey from orders
      where o_orderkey not in (select l_orderkey from lineitem)
    union all select 'document without label', doc_id from documents
      where doc_id not in (select doc_id from labels)
    union all select 'label without document', doc_id from labels
      where doc_id not in (select doc_id from documents)""",
)
def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "documents", "labels")}
    checks = [
        ("customer without order", "customer", "c_custkey", "orders", "o_custkey", "c_custkey"),
        ("order without customer", "orders", "o_custkey", "customer", "c_custkey", "o_orderkey"),
        ("order without line", "orders", "o_orderkey", "lineitem", "l_orderkey", "o_orderkey"),
        ("document without label", "documents", "doc_id", "labels", "doc_id", "doc_id"),
        ("label without document", "labels", "doc_id", "documents", "doc_id", "doc_id"),
    ]
    return integrity.union_all(
        [
            integrity.missing_references(t[rows], [key], t[known], [known_key]).select(
                F.lit(rule).alias("rule"), F.col(entity).alias("entity")
            )
            for rule, rows, key, known, known_key, entity in checks
        ]
    )


@query(
    "bad_artifact_references",
    """
    with a as (select p_partkey, case when p_size % 3 = 0 then 'llvm' else 'source' end as kind,
                      cast(p_size as bigint) * 2 as byte_len
               from part where p_type <> 'ECONOMY')
    select l_orderkey, l_linenumber, l_partkey as artifact_id,
           case when kind is null then 'unknown_artifact'
                when kind <> 'source' then 'wrong_artifact_kind' else 'range_past_end' end as rule
    from lineitem left join a on p_partkey = l_partkey
    where kind is null or kind <> 'source' or l_quantity + l_linenumber > byte_len""",
)
def bad_artifact_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to artifacts that are missing (one type is left out for that) or of another kind."""
    artifacts = (
        table(spark, sf_dir, "part")
        .filter(F.col("p_type") != "ECONOMY")
        .select(
            F.col("p_partkey").alias("artifact_id"),
            F.when(F.col("p_size") % 3 == 0, "llvm").otherwise("source").alias("kind"),
            (F.col("p_size").cast("bigint") * 2).alias("byte_len"),
        )
    )
    references = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("artifact_id"),
        F.col("l_quantity").cast("bigint").alias("start"),
        F.col("l_linenumber").cast("bigint").alias("length"),
    )
    bad = integrity.bad_artifact_references(references, artifacts, [], "source")
    return bad.select("l_orderkey", "l_linenumber", "artifact_id", "rule")


_TOO_LARGE = 40_000


@query(
    "violations",
    f"""
    select source as capture_id, 'record_too_large' as rule, 'document ' || doc_id as entity,
           cast(strlen(text) as varchar) as detail from documents where strlen(text) > {_TOO_LARGE}
    union all select source, 'range_past_end', 'document ' || doc_id, cast(strlen(text) as varchar)
      from documents where strlen(text) > n_chars
    union all select source, 'empty:lang', 'document ' || doc_id, 'lang' from documents where lang = ''
    union all select source, 'domain:lang', 'document ' || doc_id, lang
      from documents where lang not in ('en', 'fr', 'de')
    union all select min(source), 'duplicate_text', sha256(text), cast(count(*) as varchar)
      from documents group by text having count(*) > 1
    union all select source, 'orphan_document', 'document ' || doc_id, ''
      from documents where doc_id not in (select doc_id from labels)
    union all select null, 'unknown_document', 'label ' || doc_id, ''
      from labels where doc_id not in (select doc_id from documents)""",
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules in one pass, then duplicates and references, as one list."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    size = F.octet_length("text")
    entity = F.concat(F.lit("document "), F.col("doc_id"))
    local = integrity.row_rules(
        docs,
        F.col("source"),
        entity,
        [
            ("record_too_large", size > _TOO_LARGE, size),
            ("range_past_end", size > F.col("n_chars"), size),
            ("empty:lang", integrity.is_empty(F.col("lang")), F.lit("lang")),
            ("domain:lang", ~F.col("lang").isin("en", "fr", "de"), F.col("lang")),
        ],
    )
    # Copies are counted by digest: the texts are not shuffled.
    copies = (
        docs.groupBy(F.sha2("text", 256).alias("entity"))
        .agg(F.min("source").alias("capture_id"), F.count("*").alias("rows"))
        .filter("rows > 1")
        .select(
            "capture_id",
            F.lit("duplicate_text").alias("rule"),
            "entity",
            F.col("rows").cast("string").alias("detail"),
        )
    )
    orphans = integrity.missing_references(docs, ["doc_id"], labels).select(
        F.col("source").alias("capture_id"),
        F.lit("orphan_document").alias("rule"),
        entity.alias("entity"),
        F.lit("").alias("detail"),
    )
    unknown = integrity.missing_references(labels, ["doc_id"], docs).select(
        F.lit(None).cast("string").alias("capture_id"),
        F.lit("unknown_document").alias("rule"),
        F.concat(F.lit("label "), F.col("doc_id")).alias("entity"),
        F.lit("").alias("detail"),
    )
    return integrity.union_all([local, copies, orphans, unknown])


@query(
    "accepted_captures",
    """
    with bad as (select o_orderkey from orders where o_totalprice > 400000 or o_custkey % 10 = 0
                 union select l_orderkey from lineitem group by l_orderkey, l_linenumber having count(*) > 2)
    select o_orderkey from orders where o_orderkey not in (select o_orderkey from bad)""",
)
def accepted_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = integrity.row_rules(
        orders,
        F.col("o_orderkey"),
        F.lit("order"),
        [
            ("price", F.col("o_totalprice") > 400000, F.col("o_totalprice")),
            ("customer", F.col("o_custkey") % 10 == 0, F.col("o_custkey")),
        ],
    )
    repeated = integrity.duplicate_keys(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    ).filter("rows > 2")
    found = rows.select("capture_id").unionByName(
        repeated.select(F.col("l_orderkey").cast("string").alias("capture_id"))
    )
    captures = orders.select(F.col("o_orderkey").cast("string").alias("capture_id"), "o_orderkey")
    return integrity.accepted_captures(captures, found).select("o_orderkey")


@query(
    "file_lengths",
    """
    select source as capture_id, 'missing_file' as rule, 'artifact ' || d.doc_id as entity,
           cast(d.doc_id as varchar) as detail
    from documents d anti join labels l using (doc_id)
    union all
    select source, 'file_length', 'artifact ' || d.doc_id, cast(strlen(text) as varchar)
    from documents d semi join labels l using (doc_id) where strlen(text) <> n_chars""",
)
def file_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared lengths against stored ones; only labelled documents have a file here."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    declared = docs.select(
        F.col("source").alias("capture_id"),
        F.col("doc_id").alias("artifact_id"),
        F.col("n_chars").alias("byte_len"),
    )
    files = docs.join(labels, "doc_id", "left_semi").select(
        F.col("source").alias("capture_id"),
        F.col("doc_id").alias("artifact_id"),
        F.octet_length("text").cast("bigint").alias("file_len"),
    )
    return integrity.file_rules(declared, files)


@query(
    "expected_modules",
    """
    with m as (select p_brand as capture_id, p_name as name, p_type || '/' || p_size as path from part),
         u as (select distinct p_brand as capture_id from part where p_size = 50)
    select capture_id, 'duplicate_expected_name' as rule, name as entity, cast(count(*) as varchar) as detail
      from m group by capture_id, name having count(*) > 1
    union all select capture_id, 'duplicate_expected_path', path, cast(count(*) as varchar)
      from m group by capture_id, path having count(*) > 1
    union all select capture_id, 'module_of_unsupported_collection', name, path
      from m where capture_id in (select capture_id from u)""",
)
def expected_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    expected = part.select(
        F.col("p_brand").alias("capture_id"),
        F.col("p_name").alias("name"),
        F.concat_ws("/", "p_type", "p_size").alias("path"),
    )
    configuration = part.groupBy(F.col("p_brand").alias("capture_id")).agg(
        F.max(F.when(F.col("p_size") == 50, "incremental")).alias("unsupported")
    )
    return integrity.expected_module_rules(expected, configuration)


# p_size -> rules a record with that size breaks, with how many rows each.
_DEFECTS = {
    1: {"unsupported_version": 1},
    2: {"empty:build.package": 1},
    3: {"domain:target.kind": 1},
    4: {"relative_directory": 1},
    5: {"empty:build.cargo_arguments": 1},
    6: {"path:compiler.rustc": 1},
    7: {"request_key_format": 1},
    8: {"token_format": 1},
    9: {"malformed_json": 1},
    10: {"unknown_field:header": 1},
    11: {"missing:analysis": 1},
    12: {"range_past_end": 1},
    13: {"zero_line": 1},
    14: {"duplicate_symbol": 1},
    15: {"stage_disagrees_with_lto": 1},
    16: {"unsupported_collection": 1, "stage_disagrees_with_lto": 1},
    17: {"domain:provenance.optimization": 1},
    18: {"zero:provenance.codegen_units": 1},
    19: {"missing_module": 1},
    20: {"no_placements": 1},
    21: {"not_u64:placement.size_estimate": 1},
    22: {"domain:artifact.kind": 1, "wrong_artifact_kind": 1},
    23: {"orphan_artifact": 1},
    24: {"unknown_artifact": 1},
    25: {"duplicate_module": 1, "duplicate_module_artifact": 1},
    26: {"path:artifact.src_path": 1},
    27: {"unknown_field:placement": 1},
    28: {"range_overflow:definition.range": 1, "range_past_end": 1, "not_storable:definition.range.start": 1},
}
_DEFECT_ROWS = ", ".join(
    f"({size}, '{rule}', {n})" for size, rules in _DEFECTS.items() for rule, n in rules.items()
)


def _record_documents(part: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """A header and a manifest document per part, some of them broken by their `p_size`.

    ``keep`` names columns of the part that stay beside its documents.
    """
    part = dealt(part, "p_partkey")
    d, key = F.col("p_size"), F.col("p_partkey")

    def at(size: int, broken: Column, sound: Column) -> Column:
        return F.when(d == size, broken).otherwise(sound)

    text, no_texts = F.lit, F.array().cast("array<string>")
    one = F.lit(1).cast("bigint")
    cid = identity.reverse_hex(F.unhex(F.md5(key.cast("string"))))
    source_path = at(26, text("/a/./b.rs"), text("/work/src/lib.rs"))
    observed = F.struct(
        F.col("p_brand").alias("package_id"),
        text("/work/Cargo.toml").alias("manifest_path"),
        F.struct(
            F.col("p_name").alias("name"),
            F.array(text("lib")).alias("kind"),
            F.array(text("lib")).alias("crate_types"),
            source_path.alias("src_path"),
        ).alias("target"),
        F.struct(text("2").alias("opt_level")).alias("profile"),
        F.split("p_name", " ").alias("features"),
        F.array(text("/work/out.rlib")).alias("filenames"),
    )
    digits = F.md5(key.cast("string"))
    token = F.concat(F.substring(digits, 1, 12), text("4"), F.substring(digits, 14, 3), text("8"), F.substring(digits, 18, 15))
    analysis = F.struct(
        at(7, text("ABC"), F.sha2(key.cast("string"), 256)).alias("request_key"),
        at(8, F.repeat(text("0"), F.lit(32)), token).alias("token"),
        observed.alias("artifact"),
    )
    target = F.struct(
        F.col("p_name").alias("name"), at(3, text("tests"), text("lib")).alias("kind")
    )
    build = F.struct(
        at(2, text(""), F.col("p_name")).alias("package"),
        text("0.1.0").alias("package_version"),
        target.alias("target"),
        text("release").alias("profile"),
        text("cargo").alias("cargo_program"),
        at(4, text("work"), text("/work")).alias("invocation_directory"),
        at(5, no_texts, F.array(text("rustc"))).alias("cargo_arguments"),
    )
    compiler = F.struct(
        at(6, text("tools/rustc"), text("/tools/rustc")).alias("rustc"),
        *[text(n).alias(n) for n in ("release", "commit_hash", "host")],
        text("/tools").alias("sysroot"),
    )
    header = F.to_json(
        F.struct(
            at(1, F.lit(3), F.lit(4)).alias("format_version"),
            cid.alias("id"),
            key.alias("completed_at_unix_ms"),
            build.alias("build"),
            compiler.alias("compiler"),
            F.when(d != 11, analysis).alias("analysis"),
            F.when(d == 10, F.lit(1)).alias("extra"),
        )
    )
    placement = F.struct(
        at(19, text("elsewhere"), text("unit.0")).alias("codegen_unit"),
        text("external").alias("linkage"),
        text("default").alias("visibility"),
        F.lit(False).alias("local_copy"),
        at(21, -one, key).alias("size_estimate"),
        F.when(d == 27, one).alias("extra"),
    )
    available = F.struct(
        at(24, one * 9, one).alias("artifact"),
        F.struct((one * 2).alias("start"), at(12, one * 9, one * 8).alias("length")).alias("range"),
        text("src/lib.rs").alias("display_path"),
        at(13, F.lit(0), F.lit(1)).alias("starting_line"),
    )
    instance = F.struct(
        F.struct(
            F.col("p_brand").alias("crate_name"), F.col("p_name").alias("definition_path")
        ).alias("definition"),
        F.col("p_name").alias("display_name"),
        text("alias").alias("raw_symbol"),
        F.when(d == 20, F.array_remove(F.array(placement), placement))
        .otherwise(F.array(placement))
        .alias("placements"),
        F.struct(available.alias("available")).alias("source"),
    )

    def definition(symbol: Column, start: Column, kind: Column) -> Column:
        span = F.struct(start.alias("start"), (one * 10).cast(_U64).alias("length"))
        return F.struct(symbol.alias("raw_symbol"), span.alias("range"), kind.alias("kind"))

    high = F.lit(str(2**64 - 5)).cast(_U64)
    definitions = F.array(
        definition(text("body"), at(28, high, F.lit(0).cast(_U64)), text("function")),
        definition(
            at(14, text("body"), text("alias")), F.lit(10).cast(_U64), text("expression_alias")
        ),
    )
    module = F.struct(
        (one * 2).alias("artifact"),
        text("unit.0").alias("compiler_module"),
        at(15, text(STAGES[1]), text(STAGES[0])).alias("stage"),
        definitions.alias("definitions"),
    )
    again = module.withField("definitions", F.slice(definitions, 1, 0))
    llvm = F.struct(
        F.when(d == 25, F.array(module, again))
        .when(d != 23, F.array(module))
        .alias("collected"),
        F.when(d == 23, text("incremental")).alias("not_captured"),
    )
    artifacts = F.array(
        F.struct(one.alias("id"), at(22, text("other"), text("source")).alias("kind"), (one * 10).alias("byte_len")),
        F.struct((one * 2).alias("id"), text("llvm").alias("kind"), (one * 20).alias("byte_len")),
    )
    provenance = F.struct(
        text("llvm").alias("backend"),
        text("22.1").alias("llvm_version"),
        text("x86_64").alias("target"),
        at(17, text("fast"), text("2")).alias("optimization"),
        at(16, text("fat"), text("off")).alias("lto"),
        F.lit(False).alias("incremental"),
        F.lit(False).alias("linker_plugin_lto"),
        at(18, F.lit(0), F.lit(1)).alias("codegen_units"),
        F.lit(1).alias("recipe_revision"),
    )
    manifest = F.to_json(
        F.struct(
            F.lit(4).alias("format_version"),
            cid.alias("capture_id"),
            F.array(instance).alias("instances"),
            artifacts.alias("artifacts"),
            provenance.alias("llvm_provenance"),
            llvm.alias("llvm"),
        )
    )

    def documents(raw: Column, name: str) -> DataFrame:
        return part.select(
            *keep,
            F.concat(text("/captures/"), cid, text(f"/{name}")).alias("path"),
            F.octet_length(raw).cast("bigint").alias("size"),
            raw.alias("raw"),
            F.lit(False).alias("too_large"),
        )

    return (
        documents(at(9, F.left(header, F.lit(40)), header), "capture.json"),
        documents(manifest, "instances.json"),
    )


@query(
    "record_violations",
    f"""
    with d(p_size, rule, n) as (values {_DEFECT_ROWS})
    select translate(upper(md5(cast(p_partkey as varchar))), '0123456789ABCDEF', 'zyxwvutsrqponmlk')
             as capture_id, rule, cast(n as bigint) as violations
    from part join d using (p_size)""",
)
def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record rule over documents that Spark derives from `part`."""
    headers, manifests = _record_documents(table(spark, sf_dir, "part"))
    ev = evidence_of(parse_headers(headers), parse_manifests(manifests), None)
    return (
        integrity.evidence_violations(ev)
        .groupBy("capture_id", "rule")
        .agg(F.count("*").alias("violations"))
    )


# --- observation ---------------------------------------------------------------------------------

_BUILD_SQL = """
    with b as (select user_id, cast(ts as date) as day,
                      count(*) filter (event_type = 'purchase') as selected,
                      count(*) filter (event_type = 'signup') as finished,
                      count(*) filter (event_type = 'signup' and value < 5) as failed,
                      count(*) filter (event_type = 'error') as errors,
                      count(*) filter (event_type = 'purchase' and value < 10) as mismatched
               from events group by all),
         o as (select *, case when finished <> 1 or failed > 0 then 'not_finished_once'
                              when errors > 0 then 'has_errors'
                              when selected <> 1 then 'not_one_artifact'
                              when mismatched > 0 then 'unexpected_artifact' else 'completed' end as outcome
               from b)
"""


def _event_builds(events: DataFrame) -> DataFrame:
    """A user's day is a build: purchases are its artifacts, signups its finished messages."""
    kind = F.col("event_type")
    return observe.build_completion(
        events.withColumn("day", F.col("ts").cast("date").cast("string")),
        ["user_id", "day"],
        selected=kind == "purchase",
        finished=kind == "signup",
        success=F.col("value") >= 5,
        error=kind == "error",
        matches=F.col("value") >= 10,
    )


_BUILD_COLUMNS = "user_id, cast(day as varchar) as day, selected, finished, errors, outcome"


@query("build_completion", _BUILD_SQL + f"select {_BUILD_COLUMNS} from o")
def build_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_builds(table(spark, sf_dir, "events"))


@query("completion_stream", _BUILD_SQL + f"select {_BUILD_COLUMNS} from o")
def completion_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result from a stream: state per build, changes logged, newest row read back."""
    schema = table(spark, sf_dir, "events").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf_dir)
    )
    return run_completion(stream, ["user_id", "day"], _event_builds)


@query(
    "completion_timed",
    """
    with recursive e as (
        select user_id, epoch_us(ts) // 1000 as t, event_type, value, event_type = 'signup' as fin,
               row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as i
        from events),
    walk as (
        select user_id, i, t as opened, t + case when fin then 43200000 else 172800000 end as until_, fin as done
        from e where i = 1
        union all
        select e.user_id, e.i, case when e.t > w.until_ then e.t else w.opened end,
               case when w.done and e.t <= w.until_ then w.until_
                    when e.fin then e.t + 43200000 else e.t + 172800000 end,
               e.fin or (w.done and e.t <= w.until_)
        from walk w join e on e.user_id = w.user_id and e.i = w.i + 1),
    b as (
        select user_id, opened, max(t) as last_ms, count(*) as messages,
               count(*) filter (event_type = 'purchase') as selected, count(*) filter (fin) as finished,
               count(*) filter (fin and value < 5) as failed, count(*) filter (event_type = 'error') as errors,
               count(*) filter (event_type = 'purchase' and value < 10) as mismatched
        from walk join e using (user_id, i) group by user_id, opened)
    select user_id, opened as opened_ms, last_ms, messages, selected, finished, errors,
           case when finished <> 1 or failed > 0 then 'not_finished_once' when errors > 0 then 'has_errors'
                when selected <> 1 then 'not_one_artifact' when mismatched > 0 then 'unexpected_artifact'
                else 'completed' end as outcome
    from b""",
)
def completion_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a user's events: over half a day after a signup, or after two days of silence."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.col("event_type")
    spans = timed_completion(
        stream, F.col("user_id"), F.col("ts").cast("timestamp"),
        selected=kind == "purchase", finished=kind == "signup", success=F.col("value") >= 5,
        error=kind == "error", matches=F.col("value") >= 10, grace="12 hours", idle="2 days",
    )
    return spans_of(stream, spans).select(
        F.col("build").cast("bigint").alias("user_id"), F.unix_millis("opened").alias("opened_ms"),
        F.unix_millis("last").alias("last_ms"), "messages", "selected", "finished", "errors", "outcome",
    )


@query(
    "diagnostic_split",
    _BUILD_SQL
    + """select e.event_id, e.user_id, e.event_type = 'click' as is_warning
    from events e join o on o.user_id = e.user_id and o.day = cast(e.ts as date)
    where e.event_type = 'click'
       or (e.event_type in ('error', 'view') and o.outcome <> 'has_errors')""",
)
def diagnostic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    day = F.col("ts").cast("date").cast("string")
    build = F.concat_ws("/", "user_id", day)
    kind = F.col("event_type")
    messages = events.select(
        build.alias("build_id"),
        F.col("event_id").alias("seq"),
        "user_id",
        F.when(kind.isin("click", "error"), "compiler-message")
        .when(kind == "view", "text")
        .otherwise("other")
        .alias("reason"),
        F.when(kind == "click", "warning").when(kind == "error", "error").alias("level"),
        F.concat_ws(" ", "user_id", "props").alias("rendered"),
    )
    outcomes = _event_builds(events).select(
        F.concat_ws("/", "user_id", "day").alias("build_id"),
        F.when(F.col("outcome") == "has_errors", observe.STALE)
        .otherwise(F.col("outcome"))
        .alias("outcome"),
    )
    shown = observe.diagnostic_split(messages, outcomes)
    return shown.select(
        F.col("seq").alias("event_id"),
        F.split_part("build_id", F.lit("/"), F.lit(1)).cast("bigint").alias("user_id"),
        "is_warning",
    )


@query(
    "build_messages",
    """
    select event_id, case event_type when 'purchase' then 'compiler-artifact'
             when 'signup' then 'build-finished' when 'view' then 'text' else 'compiler-message' end as reason,
           case when event_type = 'signup' then value >= 5 end as success,
           case event_type when 'error' then 'error' when 'click' then 'warning' end as level,
           case event_type when 'view' then 'plain ' || event_id
             when 'error' then 'said ' || event_id when 'click' then 'said ' || event_id end as rendered
    from events""",
)
def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message lines read back: structured ones by field, everything else kept as text."""
    kind = F.col("event_type")
    message = F.struct(
        F.when(kind == "error", "error").otherwise("warning").alias("level"),
        F.concat(F.lit("said "), F.col("event_id")).alias("message"),
    )
    finished = F.struct(
        F.lit("build-finished").alias("reason"), (F.col("value") >= 5).alias("success")
    )
    line = (
        F.when(kind == "purchase", F.to_json(F.struct(F.lit("compiler-artifact").alias("reason"))))
        .when(kind == "signup", F.to_json(finished))
        .when(kind == "view", F.concat(F.lit("plain "), F.col("event_id")))
        .otherwise(F.to_json(F.struct(F.lit("compiler-message").alias("reason"), message.alias("message"))))
    )
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    return parse_messages(lines).select("event_id", "reason", "success", "level", "rendered")


@query(
    "probe_outcome",
    """
    with p as (select o_orderkey, o_orderstatus = 'P' as receipt, o_custkey % 3 <> 0 as ok,
                      o_orderkey % 2 as selected, o_orderkey % 2 = 1 and o_custkey % 5 <> 0 as completed,
                      o_orderpriority <> '1-URGENT' as same, o_orderkey % 17 = 0 as manifest
               from orders)
    select o_orderkey, case when manifest then 'error'
             when not ok and receipt and selected = 0 then 'stale'
             when ok and not receipt and completed and same then 'fresh' else 'error' end as probe
    from p""",
)
def probe_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", _order_probe().alias("probe"))


def _order_probe() -> Column:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return observe.probe_outcome(
        receipt=F.col("o_orderstatus") == "P",
        process_ok=cust % 3 != 0,
        selected=key % 2,
        completed=(key % 2 == 1) & (cust % 5 != 0),
        same=F.col("o_orderpriority") != "1-URGENT",
        manifest=key % 17 == 0,
    )


_LOOKUP_SQL = """
    with p as (select o_custkey, o_orderkey as capture,
                      case when o_custkey % 7 = 0 then 'other' else o_orderpriority end as token
               from orders where o_custkey % 11 <> 0
               qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1),
         l as (select c_custkey, case when p.capture is null then 'miss'
                        when b.o_totalprice > 400000 then 'invalid' when o.o_orderkey is null then 'dangling_miss'
                        when o.o_orderpriority <> p.token then 'invalid' else 'hit' end as lookup,
                      case when o.o_orderpriority = p.token and b.o_totalprice <= 400000
                           then o.o_orderkey end as capture
               from customer left join p on p.o_custkey = c_custkey
               left join orders o on o.o_orderkey = p.capture and o.o_orderstatus <> 'F'
               left join orders b on b.o_orderkey = p.capture)
"""


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests, with a case of every outcome: some have no pointer, some pointers name
    another token, open orders only are captures, and the dearest are damaged, stored or not."""
    orders = table(spark, sf_dir, "orders")
    latest = F.max_by(
        F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")
    )
    pointers = (
        orders.filter(F.col("o_custkey") % 11 != 0)
        .groupBy("o_custkey")
        .agg(latest.alias("__p"))
        .select(
            F.col("o_custkey").alias("request_key"),
            F.when(F.col("o_custkey") % 7 == 0, "other")
            .otherwise(F.col("__p.o_orderpriority"))
            .alias("token"),
            F.col("__p.o_orderkey").alias("capture_id"),
        )
    )
    captures = orders.filter(F.col("o_orderstatus") != "F").select(
        F.col("o_orderkey").alias("capture_id"),
        F.struct(
            F.col("o_custkey").alias("request_key"), F.col("o_orderpriority").alias("token")
        ).alias("analysis"),
    )
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_key"), "c_nationkey")
    damaged = orders.filter(F.col("o_totalprice") > 400000).select(F.col("o_orderkey").alias("capture_id"))
    return observe.candidate_lookup(requests, pointers, captures, violations=damaged)


@query(
    "pointer_rules",
    """
    select p_partkey, case p_size % 9 when 1 then 'record_too_large' when 2 then 'malformed_json'
             when 3 then 'unknown_field:pointer' when 4 then 'unsupported_version'
             when 5 then 'missing_field:token' when 6 then 'format:token'
             when 7 then 'format:capture_id' when 8 then 'wrong_key' end as rule
    from part""",
)
def pointer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer documents that Spark derives from `part`, eight of nine kinds with a fault each."""
    key, kind = F.sha2(F.col("p_partkey").cast("string"), 256), F.col("p_size") % 9
    letters = F.translate(F.substring(key, 1, 32), "0123456789abcdef", "klmnopqrstuvwxyz")
    token = F.concat(F.substring(key, 1, 12), F.lit("4"), F.substring(key, 14, 3), F.lit("8"), F.substring(key, 18, 15))
    fields = F.struct(
        F.when(kind == 4, 7).otherwise(1).alias("format_version"),
        F.when(kind == 8, F.reverse(key)).otherwise(key).alias("request_key"),
        F.when(kind == 6, F.col("p_name")).when(kind != 5, token).alias("token"),
        F.when(kind == 7, F.col("p_name")).otherwise(letters).alias("capture_id"),
        F.when(kind == 3, F.col("p_brand")).alias("brand"),
    )
    documents = table(spark, sf_dir, "part").select(
        F.concat(F.lit("s/candidates/"), key, F.lit(".json")).alias("path"),
        F.when(kind == 2, F.concat(F.lit("{"), F.col("p_name"))).when(kind != 1, F.to_json(fields)).alias("raw"),
        (kind == 1).alias("too_large"),
        "p_partkey",
    )
    keys = documents.select(F.regexp_extract("path", "([0-9a-f]{64})", 1).alias("request_key"), "p_partkey")
    return parse_candidates(documents).join(keys, "request_key").select("p_partkey", "rule")


@query("candidate_lookup", _LOOKUP_SQL + "select * from l")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir).select(
        F.col("request_key").alias("c_custkey"),
        "lookup",
        F.col("candidate.capture_id").alias("capture"),
    )


@query(
    "reuse_or_collect",
    _LOOKUP_SQL
    + """, f as (select o_custkey, max(o_orderkey) as k from orders group by o_custkey),
         q as (select f.o_custkey, case when k % 17 = 0 then 'error'
                      when not (o.o_custkey % 3 <> 0) and o_orderstatus = 'P' and k % 2 = 0 then 'stale'
                      when o.o_custkey % 3 <> 0 and o_orderstatus <> 'P' and k % 2 = 1
                           and o.o_custkey % 5 <> 0 and o_orderpriority <> '1-URGENT' then 'fresh'
                      else 'error' end as probe
               from f join orders o on o.o_orderkey = k)
    select l.c_custkey, case when c_nationkey = 3 then 'collect'
             when lookup in ('miss', 'dangling_miss') then 'collect' when lookup = 'invalid' then 'error'
             when probe = 'fresh' then 'reuse' when probe = 'stale' then 'collect' else 'error' end as decision,
           case when c_nationkey <> 3 and lookup = 'hit' and probe = 'fresh' then capture end as reused
    from l join customer using (c_custkey) left join q on q.o_custkey = l.c_custkey""",
)
def reuse_or_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are customers; the probe of a request is its newest order."""
    newest = F.max_by(_order_probe(), F.col("o_orderkey"))
    probes = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("request_key"))
        .agg(newest.alias("probe"))
    )
    decision = observe.reuse_decision(
        F.col("c_nationkey") == 3, F.col("lookup"), F.coalesce("probe", F.lit("error"))
    )
    return (
        _lookup(spark, sf_dir)
        .join(probes, "request_key", "left")
        .withColumn("decision", decision)
        .select(
            F.col("request_key").alias("c_custkey"),
            "decision",
            F.when(F.col("decision") == "reuse", F.col("candidate.capture_id")).alias("reused"),
        )
    )


@query(
    "read_captures",
    """
    select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 480000)
                                then 'corrupt'
                           when c_custkey not in (select o_custkey from orders) then 'missing'
                           else 'found' end as status
    from customer""",
)
def read_captures_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    captures = orders.groupBy(F.col("o_custkey").alias("capture_id")).agg(
        F.max("o_orderkey").alias("last_order")
    )
    broken = orders.filter(F.col("o_totalprice") > 480000).select(
        F.col("o_custkey").alias("capture_id")
    )
    requested = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("capture_id"))
    return read_captures(requested, captures, broken).select(
        F.col("capture_id").alias("c_custkey"), "status"
    )


# --- ingestion -----------------------------------------------------------------------------------


@query(
    "publish_lake",
    """
    select cast(o_orderkey as varchar) as capture_id, o_custkey as request_key, o_orderpriority as token
    from orders qualify row_number() over (partition by o_custkey
      order by case when o_orderkey % 2 = 0 then 1 else 2 end desc, o_orderdate desc,
               cast(o_orderkey as varchar) desc) = 1""",
)
def publish_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches into a new lake, then another under a used number, which is refused; then the
    current pointers."""
    captures = _order_captures(spark, sf_dir)
    lake = Lake(spark, shared_path(spark, "lake"))
    parity = F.col("capture_id").cast("bigint") % 2
    for seq, rows in ((1, captures.filter(parity == 0)), (2, captures.filter(parity == 1)), (2, captures.filter(parity == 0))):
        pointers = rows.select(
            F.col("analysis.request_key").alias("request_key"),
            F.col("analysis.token").alias("token"),
            "capture_id",
            "completed_at_unix_ms",
        )
        try:
            lake.write({"candidates": pointers, "captures": rows}, seq)
        except CommittedBatch:
            continue
    return lake.candidates().select(
        "capture_id", F.col("request_key").cast("bigint").alias("request_key"), "token"
    )


@query(
    "publish_stream",
    """
    select cast(o_orderkey as varchar) as capture_id, o_orderpriority as token,
           case when o_orderstatus = 'P' then 1 else 0 end as not_captured
    from orders""",
)
def publish_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of headers, fed twice: the second run meets only published ids."""
    source = shared_path(spark, "headers")
    _order_captures(spark, sf_dir).write.parquet(source)
    schema = spark.read.parquet(source).schema
    lake = Lake(spark, shared_path(spark, "lake"))
    checkpoint = shared_path(spark, "publish")
    for _ in range(2):
        run_publish(spark.readStream.schema(schema).parquet(source), lake, checkpoint)
    return lake.table("captures").select(
        "capture_id",
        F.col("analysis.token").alias("token"),
        F.col("not_captured_reason").isNotNull().cast("int").alias("not_captured"),
    )


@query(
    "reason_sentences",
    "select o_orderstatus, count(*) as captures from orders where o_orderstatus = 'P' group by 1",
)
def reason_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason code has a sentence."""
    reason = display.sentence(F.col("not_captured_reason"), display.COLLECTION_SENTENCES)
    return (
        _order_captures(spark, sf_dir)
        .filter(reason.isNotNull())
        .groupBy(F.col("build.profile").alias("o_orderstatus"))
        .agg(F.count("*").alias("captures"))
    )
