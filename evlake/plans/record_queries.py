"""Scans, integrity and evidence over record documents and files that Spark derives from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlake.functions import identity
from evlake.operators import assemble, integrity, resolve, search
from evlake.plans.evidence_queries import _BODIES_SQL, _bodies
from evlake.plans.lake_queries import _record_documents
from evlake.plans.registry import query, table
from evlake.session import cut_lineage
from evlake.sources.records import captures_of, declared_only, named_files, parse_headers, parse_manifests

# A part's capture id, as `_record_documents` makes it.
_ID_SQL = "translate(upper(md5(cast(p_partkey as varchar))), '0123456789ABCDEF', 'zyxwvutsrqponmlk')"


def _capture_id(key: Column) -> Column:
    return identity.reverse_hex(F.unhex(F.md5(key.cast("string"))))


@query(
    "scan_captures",
    f"select {_ID_SQL} as capture_id, p_name as package, 4 as format_version from part where p_size not in (1, 9)",
)
def scan_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in table form; broken ones and those of another version are left to the rules."""
    headers, manifests = _record_documents(table(spark, sf_dir, "part"))
    captures = captures_of(parse_headers(headers), parse_manifests(manifests))
    package = F.coalesce(F.nullif(F.col("build.package"), F.lit("")), F.col("build.target.name"))
    # The sort reads its input twice, for its borders too; documents are parsed once.
    parsed = cut_lineage(
        captures.select("capture_id", package.alias("package"), "format_version", "completed_at_unix_ms")
    )
    return search.list_captures(parsed, "completed_at_unix_ms", "capture_id").drop("completed_at_unix_ms")


@query(
    "size_limits",
    f"""select {_ID_SQL} as capture_id, 'record_too_large' as rule,
               cast(2000000 + p_partkey as varchar) as detail
        from part where p_partkey % 5 = 0""",
)
def size_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth header is over the limit: listed by its size, never read, and the only fault."""
    part = table(spark, sf_dir, "part").withColumn("p_size", F.lit(0))
    headers, _ = _record_documents(part, "p_partkey")
    big = F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") + 2_000_000)
    documents = headers.withColumn("big", big).select(
        "path",
        F.coalesce("big", "size").alias("size"),
        F.when(F.col("big").isNull(), F.col("raw")).alias("raw"),
        F.col("big").isNotNull().alias("too_large"),
    )
    return integrity.header_rules(parse_headers(documents)).select("capture_id", "rule", "detail")


@query(
    "ids_agree",
    f"""select {_ID_SQL.replace("p_partkey", "p_partkey + 1")} as capture_id,
               'id_differs_from_directory' as rule, {_ID_SQL} as detail
        from part where p_partkey % 4 = 0""",
)
def ids_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth header stands in the folder of its neighbour."""
    part = table(spark, sf_dir, "part").withColumn("p_size", F.lit(0))
    headers, _ = _record_documents(part, "p_partkey")
    folder = _capture_id(F.col("p_partkey") + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0))
    documents = headers.withColumn("path", F.concat(F.lit("/captures/"), folder, F.lit("/capture.json")))
    return integrity.header_rules(parse_headers(documents)).select("capture_id", "rule", "detail")


@query(
    "already_published",
    """select cast(o_orderkey as varchar) as capture_id, 'already_published' as rule
       from orders where o_orderkey % 3 = 0 and o_orderstatus = 'F'""",
)
def already_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders come in as a batch; closed orders stand in the lake already."""
    orders = table(spark, sf_dir, "orders").withColumn("capture_id", F.col("o_orderkey").cast("string"))
    batch, held = orders.filter(F.col("o_orderkey") % 3 == 0), orders.filter(F.col("o_orderstatus") == "F")
    return integrity.published_rules(batch, held).select("capture_id", "rule")


@query(
    "source_conflicts",
    """select cast(l_orderkey as varchar) as capture_id, cast(l_linenumber as varchar) as entity,
              cast(count(*) as varchar) as detail
       from lineitem group by l_orderkey, l_linenumber having min(l_suppkey) <> max(l_suppkey)""",
)
def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("capture_id"),
        F.col("l_linenumber").cast("string").alias("raw_symbol"),
        "l_suppkey",
    )
    groups = assemble.assemble_groups(lines, ["capture_id", "raw_symbol"], F.col("l_suppkey"))
    return integrity.conflict_rules(groups).select("capture_id", "entity", "detail")


@query(
    "range_ends",
    """select distinct l_orderkey, l_linenumber, cast(l_orderkey + l_linenumber as bigint) as range_end
       from lineitem""",
)
def range_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = identity.range_end(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("bigint"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", end.alias("range_end")).distinct()


@query(
    "declared_files",
    f"""select {_ID_SQL} as capture_id, p_size as artifact_id, p_name as content
        from part where p_partkey % 3 = 0 and p_partkey % 7 <> 0""",
)
def declared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per part, some under other names; every third part is declared."""
    part = table(spark, sf_dir, "part")
    cid, number = _capture_id(F.col("p_partkey")), F.col("p_size").cast("bigint")
    name = F.when(F.col("p_partkey") % 7 == 0, F.lit("notes.txt")).otherwise(identity.artifact_file_name(number))
    files = part.select(
        F.concat(F.lit("s/captures/"), cid, F.lit("/"), name).alias("path"), F.col("p_name").alias("content")
    )
    declared = part.filter(F.col("p_partkey") % 3 == 0).select(cid.alias("capture_id"), number.alias("artifact_id"))
    found = declared_only(named_files(files), declared)
    return found.select("capture_id", F.col("artifact_id").cast("int").alias("artifact_id"), "content")


@query(
    "ordered_bodies",
    _BODIES_SQL
    + "select p_partkey, module, start, length from b where status = 'body'",
)
def ordered_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of every part by module and range; their order itself is checked by the tests."""
    _, bodies = _bodies(spark, sf_dir)
    return resolve.order_bodies(bodies, ["ordinal"]).select(
        F.col("ordinal").alias("p_partkey"), F.col("compiler_module").alias("module"), "start", "length"
    )


@query(
    "stored_sources",
    """
    select c_custkey, case when c_nationkey % 4 = 0 then 'unavailable' else 'available' end as status,
           case when c_nationkey % 4 <> 0 then c_custkey end as start,
           case when c_nationkey % 4 <> 0 then c_nationkey end as length,
           case when c_nationkey % 4 = 0 then 'nonlocal' end as reason
    from customer where c_custkey % 6 <> 0""",
)
def stored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored source of referenced instances: one instance per customer; every sixth reference
    names an ordinal that does not exist and has no evidence."""
    customers = table(spark, sf_dir, "customer")
    cid, key, n = _capture_id(F.col("c_custkey")), F.col("c_custkey").cast("bigint"), F.col("c_nationkey").cast("bigint")
    source = F.struct(
        F.lit(1).cast("bigint").alias("artifact_id"), key.alias("start"), n.alias("length"),
        F.col("c_name").alias("display_path"), (n + 1).alias("starting_line"),
    )
    instances = customers.select(
        cid.alias("capture_id"), F.lit(0).cast("bigint").alias("ordinal"),
        F.when(n % 4 != 0, source).alias("source"), F.when(n % 4 == 0, "nonlocal").alias("source_reason"),
    )
    ordinal = F.when(key % 6 == 0, F.lit(1)).otherwise(F.lit(0))
    asked = customers.select("c_custkey", identity.instance_ref(cid, ordinal).alias("reference"))
    found = resolve.source_evidence(resolve.resolve_references(asked, "reference", instances))
    return found.select("c_custkey", "status", "start", F.col("length").cast("int").alias("length"), "reason")
