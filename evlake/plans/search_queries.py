"""Search, listings, identifiers and display forms over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlake.functions import display, identity
from evlake.functions.lists import normalize_features, normalize_observation
from evlake.operators import observe, search
from evlake.operators.integrity import not_normalized, unknown_fields
from evlake.operators.scale import ordinals
from evlake.plans.registry import query, table

_PART_NAMES = ("p_name", "p_brand", "p_type")
_PART_ORDER = ("p_type", "p_name", "p_brand", "p_partkey")


def _find_sql(literal: str, limit: int = 20) -> str:
    exact = " or ".join(f"{c} = '{literal}'" for c in _PART_NAMES)
    part = " or ".join(f"contains({c}, '{literal}')" for c in _PART_NAMES)
    return f"""
    with m as (select *, ({exact}) as ex from part where {part}),
         c as (select count(*) filter (ex) as e, count(*) as s from m)
    select p_partkey, p_name, p_brand, p_type,
           case when e > 0 then 'exact' else 'substring' end as match_kind,
           case when e > 0 then e else s end as total_matches,
           (case when e > 0 then e else s end) > {limit} as is_truncated
    from m, c where e = 0 or ex
    order by {", ".join(_PART_ORDER)} limit {limit}"""


def _find_part(spark: SparkSession, sf_dir: str, literal: str) -> DataFrame:
    found = search.find(table(spark, sf_dir, "part"), _PART_NAMES, _PART_ORDER, literal, 20)
    return found.select(
        "p_partkey", *_PART_NAMES, "match_kind", "total_matches", "is_truncated"
    )


@query("find_two_tier", _find_sql("ring"))
def find_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find_part(spark, sf_dir, "ring")


@query("find_exact_tier", _find_sql("Brand#1"))
def find_exact_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find_part(spark, sf_dir, "Brand#1")


@query(
    "find_in_scope",
    """
    with m as (select *, (p_name = 'a' or p_type = 'a') as ex from part
               where p_brand = 'Brand#7' and (contains(p_name, 'a') or contains(p_type, 'a'))),
         c as (select count(*) filter (ex) as e, count(*) as s from m)
    select p_partkey, p_name, p_type,
           case when e > 0 then 'exact' else 'substring' end as match_kind,
           case when e > 0 then e else s end as total_matches,
           (case when e > 0 then e else s end) > 10 as is_truncated
    from m, c where e = 0 or ex order by p_name, p_type, p_partkey limit 10""",
)
def find_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search names one scope and never sees another."""
    part = table(spark, sf_dir, "part")
    found = search.find(
        part,
        ["p_name", "p_type"],
        ["p_name", "p_type", "p_partkey"],
        "a",
        10,
        F.col("p_brand") == "Brand#7",
    )
    return found.select(
        "p_partkey", "p_name", "p_type", "match_kind", "total_matches", "is_truncated"
    )


@query(
    "find_many",
    """
    with q as (select distinct unnest(string_split(p_name, ' ')) as q from part
               union select distinct substr(p_brand, 1, 7) from part
               union select distinct lower(p_type) from part
               union select c_mktsegment from customer),
         h as (select q.q, p.*, case when p_name = q.q or p_brand = q.q or p_type = q.q
                                     then 0 else 1 end as tier
               from part p, q
               where contains(p_name, q.q) or contains(p_brand, q.q) or contains(p_type, q.q)),
         t as (select q, min(tier) as best, count(*) filter (tier = 0) as e, count(*) as a
               from h group by q),
         r as (select h.*, row_number() over (partition by q
                 order by p_type, p_name, p_brand, p_partkey) as position,
                 case when best = 0 then e else a end as total_matches
               from h join t using (q) where tier = best)
    select q, position, p_partkey, p_name, p_brand, p_type,
           case when tier = 0 then 'exact' else 'substring' end as match_kind,
           total_matches, total_matches > 2 + length(q) % 4 as is_truncated
    from r where position <= 2 + length(q) % 4""",
)
def find_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("q"))
    prefixes = part.select(F.substring("p_brand", 1, 7).alias("q"))
    types = part.select(F.lower("p_type").alias("q"))
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("q"))
    queries = words.union(prefixes).union(types).union(segments).distinct()
    own_limit = F.lit(2) + F.length("q") % 4
    queries = queries.select("q", F.col("q").alias("text"), own_limit.alias("most"))
    found = search.find_many(
        part, "p_partkey", _PART_NAMES, _PART_ORDER, queries, "q", "text", limit="most"
    )
    return found.select(
        "q",
        F.col("position").cast("bigint").alias("position"),
        "p_partkey",
        *_PART_NAMES,
        "match_kind",
        "total_matches",
        "is_truncated",
    )


@query(
    "bad_queries",
    """
    select c_custkey, case when c_acctbal < 0 then 'empty_query' else 'invalid_limit' end as rule
    from customer where c_acctbal < 0 or c_nationkey - 3 < 1""",
)
def bad_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_name")).alias("text"),
        (F.col("c_nationkey") - 3).alias("top"),
    )
    return search.bad_queries(queries, "c_custkey", "text", "top")


@query(
    "list_desc",
    """
    select o_orderkey, cast(cast(o_orderdate as date) as varchar) as completed,
           row_number() over (order by o_orderdate desc, o_orderkey) - 1 as list_position
    from orders""",
)
def list_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole listing; the position makes its order part of the result."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    listed = ordinals(orders, [], [F.col("o_orderdate").desc(), F.col("o_orderkey")], "list_position")
    return listed.select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").cast("string").alias("completed"),
        "list_position",
    )


def _unix_ms(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp, whatever the session time zone is."""
    clock = F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000
    seconds = F.floor(F.extract(F.lit("SECOND"), ts) * 1000)
    return F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000 + clock + seconds


def _order_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    reasons = list(display.COLLECTION_SENTENCES)
    reason = F.when(
        F.col("o_orderstatus") == "P",
        F.element_at(
            F.array(*[F.lit(r) for r in reasons]),
            (F.col("o_orderkey") % len(reasons) + 1).cast("int"),
        ),
    )
    target = F.struct(
        F.col("o_orderpriority").alias("name"),
        F.element_at(
            F.array(*[F.lit(k) for k in ("lib", "bin", "example", "bench")]),
            (F.col("o_custkey") % 4 + 1).cast("int"),
        ).alias("kind"),
    )
    build = F.struct(
        F.concat(F.lit("package-"), F.col("o_custkey")).alias("package"),
        F.concat(F.lit("0."), F.col("o_orderkey")).alias("package_version"),
        target.alias("target"),
        F.col("o_orderstatus").alias("profile"),
    )
    analysis = F.struct(
        F.col("o_custkey").cast("string").alias("request_key"),
        F.col("o_orderpriority").alias("token"),
    )
    return orders.select(
        F.col("o_orderkey").cast("string").alias("capture_id"),
        _unix_ms(F.col("o_orderdate")).alias("completed_at_unix_ms"),
        build.alias("build"),
        analysis.alias("analysis"),
        reason.alias("not_captured_reason"),
    )


@query(
    "capture_view",
    """
    select cast(o_orderkey as varchar) as capture_id,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as completed,
           'package-' || o_custkey as package, '0.' || o_orderkey as package_version,
           (['lib', 'bin', 'example', 'bench'])[o_custkey % 4 + 1] as target_kind,
           o_orderpriority as target_name, o_orderstatus as profile
    from orders""",
)
def capture_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.capture_view(_order_captures(spark, sf_dir))


# The SQL forms have the sentences in full, so that a wrong one in the library shows.
_REASONS = list(display.COLLECTION_SENTENCES)


@query(
    "unavailable_captures",
    f"""
    with r as (select cast(o_orderkey as varchar) as capture_id,
                      ({_REASONS})[o_orderkey % {len(_REASONS)} + 1] as not_captured_reason
               from orders where o_orderstatus = 'P')
    select *, case not_captured_reason
        when 'incremental' then 'optimized LLVM is unavailable for incremental compilation'
        when 'cross_crate_thin_lto' then 'optimized LLVM is unavailable for cross-crate ThinLTO'
        when 'fat_lto' then 'optimized LLVM is unavailable for fat LTO'
        when 'linker_plugin_lto' then 'optimized LLVM is unavailable for linker-plugin LTO'
        when 'other_backend' then 'optimized LLVM is unavailable for this compiler backend'
        when 'unverified_compiler' then 'optimized LLVM artifact stages are not verified for this compiler release'
        end as message from r""",
)
def unavailable_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.unavailable_captures(_order_captures(spark, sf_dir))


@query(
    "instance_view",
    """
    select p_brand || ':' || p_partkey as reference, p_brand as capture_id, p_partkey as ordinal,
           p_name as display_name, l_returnflag as linkage, l_linestatus as visibility,
           l_orderkey as codegen_unit
    from part left join lineitem on l_partkey = p_partkey""",
)
def instance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lineitem = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    instances = part.select(
        F.col("p_brand").alias("capture_id"),
        F.col("p_partkey").alias("ordinal"),
        F.col("p_name").alias("display_name"),
        F.col("p_type").alias("crate_name"),
        F.col("p_type").alias("definition_path"),
        F.col("p_name").alias("raw_symbol"),
    )
    placements = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_brand").alias("capture_id"),
            F.col("l_partkey").alias("ordinal"),
            F.col("l_orderkey").alias("codegen_unit"),
            F.col("l_returnflag").alias("linkage"),
            F.col("l_linestatus").alias("visibility"),
        )
    )
    return search.instance_view(instances, placements).select(
        "reference",
        "capture_id",
        "ordinal",
        "display_name",
        "linkage",
        "visibility",
        "codegen_unit",
    )


# --- identifiers and display forms ---------------------------------------------------------------

_LE64 = (
    "unhex(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || "
    "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))"
)


def _le64_sql(field: str) -> str:
    return f"(select {_LE64} from (select lpad(to_hex(strlen({field})), 16, '0') as h))"


@query(
    "request_key",
    f"""
    select p_partkey, sha256({_le64_sql("p_name")} || encode(p_name)
                             || {_le64_sql("p_brand")} || encode(p_brand)) as request_key
    from part""",
)
def request_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", identity.request_key(F.col("p_name"), F.col("p_brand")).alias("request_key")
    )


@query(
    "document_key",
    f"""
    select doc_id, sha256({_le64_sql("lang")} || encode(lang)
                          || {_le64_sql("text")} || encode(text)) as request_key
    from documents""",
)
def document_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", identity.request_key(F.col("lang"), F.col("text")).alias("request_key")
    )


@query(
    "reverse_hex",
    """
    select c_custkey, translate(upper(md5(c_name)), '0123456789ABCDEF', 'zyxwvutsrqponmlk') as id
    from customer""",
)
def reverse_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", identity.reverse_hex(F.unhex(F.md5("c_name"))).alias("id")
    )


@query(
    "identifier_rules",
    """
    select c_custkey,
           not regexp_matches(translate(upper(md5(c_name)), '0123456789ABCDEF', 'zyxwvutsrqponmlk'),
                              '^[k-z]{32}$') as bad_capture_id,
           not regexp_matches(sha256(c_name), '^[0-9a-f]{64}$') as bad_key,
           not regexp_matches(md5(c_name), '^[0-9a-f]{12}4[0-9a-f]{3}[89ab][0-9a-f]{15}$') as bad_token
    from customer""",
)
def identifier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        (~identity.reverse_hex(F.unhex(F.md5(name))).rlike(identity.CAPTURE_ID)).alias(
            "bad_capture_id"
        ),
        (~F.sha2(name, 256).rlike(identity.REQUEST_KEY)).alias("bad_key"),
        (~F.md5(name).rlike(identity.TOKEN)).alias("bad_token"),
    )


@query(
    "path_rules",
    r"""
    with p as (select page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') as path from pages)
    select page_id, path,
           not starts_with(path, '/') or contains(path, '//')
           or regexp_matches(path, '(^|/)\.{1,2}(/|$)')
           or (length(path) > 1 and ends_with(path, '/')) as bad_path
    from p""",
)
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", path.alias("path"))
        .withColumn("bad_path", not_normalized(F.col("path")))
    )


@query(
    "artifact_file_name",
    "select p_partkey, 'artifact-' || lpad(lower(to_hex(p_partkey)), 16, '0') as file_name from part",
)
def artifact_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", identity.artifact_file_name(F.col("p_partkey")).alias("file_name")
    )


@query(
    "rfc3339",
    """
    with m as (select event_id, epoch_us(ts) // 1000 as ms from events)
    select event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S')
           || case when ms % 1000 = 0 then '' else '.' || rtrim(lpad(cast(ms % 1000 as varchar), 3, '0'), '0') end
           || 'Z' as completed
    from m""",
)
def rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", display.rfc3339(_unix_ms(F.col("ts"))).alias("completed")
    )


@query(
    "diagnostic_class",
    """
    select event_type, case when event_type = 'click' then 'warning'
                            when event_type = 'error' then 'error' else 'other' end as class,
           count(*) as events
    from events group by all""",
)
def diagnostic_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "click", "warning").otherwise(F.col("event_type"))
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type", display.diagnostic_class(level).alias("class"))
        .agg(F.count("*").alias("events"))
    )


@query(
    "features",
    r"""
    select p_partkey, array_to_string(list_sort(list_distinct(list_filter(
             regexp_split_to_array(p_name || ' ' || p_brand || ',' || p_type || ',' || p_name, '[,\s]+'),
             lambda x: x <> ''))), '|') as features
    from part""",
)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array(
        F.col("p_name"), F.concat_ws(",", "p_brand", "p_type", "p_name"), F.lit(" , ")
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(normalize_features(entries), "|").alias("features")
    )


@query(
    "freshness_match",
    """
    select p_partkey, (case when p_size % 2 = 1 then 'x' end) is not distinct from
                      (case when p_size % 4 in (1, 2) then 'x' end) as same
    from part""",
)
def freshness_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in another order are equal, NULL equals NULL, any other difference counts."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    empty = F.array().cast("array<string>")

    def observation(lists: Column, kinds: Column, executable: Column, fresh: bool) -> Column:
        target = F.struct(
            kinds.alias("kind"), kinds.alias("crate_types"), empty.alias("required_features")
        )
        return F.struct(
            F.col("p_brand").alias("package_id"),
            target.alias("target"),
            lists.alias("features"),
            lists.alias("filenames"),
            executable.alias("executable"),
            F.lit(fresh).alias("fresh"),
        )

    x = F.lit("x")
    new = observation(words, F.array("p_brand", "p_type"), F.when(F.col("p_size") % 2 == 1, x), True)
    old = observation(
        F.reverse(words),
        F.array("p_type", "p_brand"),
        F.when((F.col("p_size") % 4).isin(1, 2), x),
        False,
    )
    return observe.freshness_match(
        part, part, "p_partkey", normalize_observation(new), normalize_observation(old)
    )


@query(
    "json_strict",
    """
    select event_id, array_to_string(list_sort(list_filter(json_keys(props),
             lambda k: k <> 'value')), ',') as unknown
    from events where len(list_filter(json_keys(props), lambda k: k <> 'value')) > 0""",
)
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = unknown_fields(F.col("props"), ["value"])
    return (
        table(spark, sf_dir, "events")
        .filter(F.size(extra) > 0)
        .select("event_id", F.array_join(extra, ",").alias("unknown"))
    )


@query(
    "availability",
    """
    with d as (select d.doc_id, l.quality, (['nonlocal', 'unloaded', 'generated',
                 'unsupported_span', 'outside_package'])[d.doc_id % 5 + 1] as code
               from documents d left join labels l using (doc_id))
    select doc_id, case when quality is not null then 'available' else 'unavailable' end as status,
           case when quality is null then code end as reason,
           case when quality is null then case code
               when 'nonlocal' then 'source is unavailable for a nonlocal definition'
               when 'unloaded' then 'source text was not loaded by the compiler'
               when 'generated' then 'source is unavailable for an unsupported expansion or synthetic instance'
               when 'unsupported_span' then 'the compiler did not establish a supported exact source span'
               when 'outside_package' then 'source lies outside the selected package root' end end as message
    from d""",
)
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in ("nonlocal", "unloaded", "generated", "unsupported_span", "outside_package")])
    code = F.element_at(codes, (F.col("doc_id") % 5 + 1).cast("int"))
    union = display.availability(F.col("quality"), code, display.SOURCE_SENTENCES)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id")
        .join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
        .select("doc_id", union.alias("__u"))
        .select("doc_id", "__u.*")
    )
