"""Byte ranges, text indexes, resolution and assembly over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlake.operators import assemble, ranges, resolve, textindex
from evlake.operators.scale import ordinals, running_totals
from evlake.plans.registry import query, table
from evlake.session import cut_lineage

_CHUNK = 8192


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.chunk_bytes(
        _documents(spark, sf_dir), ["doc_id"], F.encode("text", "UTF-8"), _CHUNK
    )


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("byte_len")
    )


def _half(c: Column, n: int) -> Column:
    return F.call_function("div", c, F.lit(n).cast("bigint"))


@query(
    "chunk_bytes",
    f"""
    with d as (select doc_id, encode(text) as b, strlen(text) as n from documents)
    select doc_id, i as chunk_no, least(n - i * {_CHUNK}, {_CHUNK}) as byte_len,
           sha256(b[i * {_CHUNK} + 1 : (i + 1) * {_CHUNK}]) as digest
    from d, unnest(range(0, (n + {_CHUNK} - 1) // {_CHUNK})) as u(i)""",
)
def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(
        "doc_id",
        "chunk_no",
        F.octet_length("bytes").cast("bigint").alias("byte_len"),
        F.sha2("bytes", 256).alias("digest"),
    )


@query(
    "range_read",
    """
    with d as (select doc_id, encode(text) as b, strlen(text) as n from documents),
         r as (select doc_id * 4 as range_id, doc_id, n // 4 as start, n // 2 as length from d
               union all select doc_id * 4 + 1, doc_id, n, 0 from d
               union all select doc_id * 4 + 2, doc_id, n - 1, 2 from d
               union all select doc_id * 4 + 3, -1 - doc_id, 0, 1 from d)
    select range_id, start, length,
           case when d.doc_id is null then 'unknown_artifact'
                when start + length > n then 'past_end' else 'ok' end as status,
           case when start + length <= n
                then sha256(case when length = 0 then ''::blob else b[start + 1 : start + length] end)
                end as digest
    from r left join d using (doc_id)""",
)
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half of every text (cut anywhere), an empty range at its end, one past it, one unknown."""
    sizes = _sizes(spark, sf_dir)
    n, doc = F.col("byte_len"), F.col("doc_id")
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    asked = F.array(
        F.struct((doc * 4).alias("range_id"), doc.alias("doc_id"), _half(n, 4).alias("start"), _half(n, 2).alias("length")),
        F.struct((doc * 4 + 1).alias("range_id"), doc.alias("doc_id"), n.alias("start"), zero.alias("length")),
        F.struct((doc * 4 + 2).alias("range_id"), doc.alias("doc_id"), (n - 1).alias("start"), (one * 2).alias("length")),
        F.struct((doc * 4 + 3).alias("range_id"), (-1 - doc).alias("doc_id"), zero.alias("start"), one.alias("length")),
    )
    requests = sizes.select(F.explode(asked).alias("__r")).select("__r.*")
    read = ranges.read_ranges(
        requests, "range_id", sizes, _chunks(spark, sf_dir), ["doc_id"], _CHUNK
    )
    return read.select(
        "range_id", "start", "length", "status", F.sha2("content", 256).alias("digest")
    )


_LINES_SQL = """
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line,
                      generate_subscripts(string_split(text, chr(10)), 1) as line_no
               from documents),
         o as (select doc_id, line_no, cast(strlen(line) as bigint) as byte_len,
                      cast(coalesce(sum(strlen(line) + 1) over (partition by doc_id order by line_no
                        rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_start
               from l)
"""


@query("line_offsets", _LINES_SQL + "select * from o")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.text_lines(_documents(spark, sf_dir), ["doc_id"], F.col("text"))


@query(
    "artifact_lines",
    _LINES_SQL
    + """, n as (select doc_id, max(line_no) as last from o group by doc_id)
    select doc_id, line_no - 1 as line_no, byte_start,
           byte_len + case when line_no < last then 1 else 0 end as byte_len
    from o join n using (doc_id) where line_no < last or byte_len > 0""",
)
def artifact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of chunked texts; the pieces of a line that crosses chunks add up."""
    return _whole_lines(ranges.artifact_lines(_chunks(spark, sf_dir), ["doc_id"]))


def _whole_lines(pieces: DataFrame, *more: Column) -> DataFrame:
    return pieces.groupBy("doc_id", F.col("line_no").cast("bigint").alias("line_no")).agg(
        F.min("byte_start").alias("byte_start"), F.sum(F.octet_length("line")).cast("bigint").alias("byte_len"),
        *more,
    )


@query(
    "long_lines",
    """
    with d as (select doc_id, strlen(replace(text, chr(10), ' ')) as n from documents where strlen(text) > 0)
    select doc_id, 0::bigint as line_no, 0::bigint as byte_start, cast(n as bigint) as byte_len,
           cast((n + 255) // 256 as bigint) as n_pieces
    from d""",
)
def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as single lines over chunks of 256 bytes: a row per piece, never put together."""
    docs = _documents(spark, sf_dir)
    chunks = ranges.chunk_bytes(docs, ["doc_id"], F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).cast("binary"), 256)
    pieces = ranges.artifact_lines(chunks, ["doc_id"])
    # All pieces of a text lie in its one line: counted as the line is measured, in one pass.
    return _whole_lines(pieces, F.count("*").alias("n_pieces"))


@query(
    "starting_lines",
    _LINES_SQL
    + """, d as (select doc_id, strlen(text) * 2 // 3 as start from documents)
    select doc_id, start, cast(max(line_no) as bigint) as starting_line
    from d join o using (doc_id) where byte_start <= start group by doc_id, start""",
)
def starting_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = _sizes(spark, sf_dir).select(
        "doc_id", _half(F.col("byte_len") * 2, 3).alias("start")
    )
    return ranges.starting_lines(offsets, _chunks(spark, sf_dir), ["doc_id"], _CHUNK)


@query(
    "passage_spans",
    """
    with c as (select doc_id, item_id, d.text, b.text as p
               from documents d, benchmark b where contains(d.text, b.text)),
         o as (select *, unnest(list_filter(range(1, length(text) - length(p) + 2),
                 lambda i: substr(text, i, length(p)) = p)) as pos from c),
         m as (select *, left(text, pos - 1) as head from o)
    select doc_id, item_id, cast(strlen(head) as bigint) as byte_start,
           cast(strlen(p) as bigint) as byte_length,
           cast(length(head) - length(replace(head, chr(10), '')) + 1 as bigint) as starting_line,
           substr(text, greatest(pos - 20, 1), length(p) + 20 + least(pos - 1, 20)) as excerpt
    from m""",
)
def passage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return ranges.passage_spans(
        _documents(spark, sf_dir), "doc_id", "text", passages, "item_id", "passage"
    )


@query(
    "source_spans",
    """
    with d as (select doc_id, lang, source, encode(text) as b, strlen(text) as n from documents),
         r as (select doc_id, doc_id as request_id, n // 4 as s, n // 2 as e, lang, source from d
               union all select doc_id, doc_id + 1000000000, n // 2, n // 4 - 1, lang, source from d
               union all select -1 - doc_id, -1 - doc_id, 0, 1, 'en', 'src1' from labels),
         x as (select r.*, d.b, d.n, d.doc_id is not null as loaded
               from r left join d using (doc_id)),
         y as (select *, case
                 when lang = 'de' then 'nonlocal' when source = 'src3' then 'generated'
                 when s > e or s < 0 or e < 0 then 'unsupported_span' when not loaded then 'unloaded'
                 when source = 'src5' then 'outside_package'
                 when e > n or hex(b[s + 1 : s + 1]) similar to '[89AB].'
                      or hex(b[e + 1 : e + 1]) similar to '[89AB].' then 'unsupported_span' end as reason,
               case when s > 0 then decode(b[1 : s - case
                 when hex(b[s + 1 : s + 1]) similar to '[89AB].' then s else 0 end]) else '' end as head
               from x)
    select request_id, reason, case when reason is null then s end as byte_start,
           case when reason is null then e - s end as byte_length,
           case when reason is null then cast(length(head) - length(replace(head, chr(10), '')) + 1
                as bigint) end as starting_line
    from y""",
)
def source_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    n = F.octet_length("text").cast("bigint")
    doc = F.col("doc_id")
    spans = docs.select(
        "doc_id",
        "lang",
        "source",
        F.explode(
            F.array(
                F.struct(doc.alias("request_id"), _half(n, 4).alias("start"), _half(n, 2).alias("end")),
                F.struct((doc + 1_000_000_000).alias("request_id"), _half(n, 2).alias("start"), (_half(n, 4) - 1).alias("end")),
            )
        ).alias("__r"),
    ).select("doc_id", "lang", "source", "__r.*")
    absent = table(spark, sf_dir, "labels").select(
        (-1 - doc).alias("doc_id"),
        F.lit("en").alias("lang"),
        F.lit("src1").alias("source"),
        (-1 - doc).alias("request_id"),
        F.lit(0).cast("bigint").alias("start"),
        F.lit(1).cast("bigint").alias("end"),
    )
    found = ranges.source_spans(
        spans.unionByName(absent),
        docs,
        "doc_id",
        "text",
        is_local=F.col("lang") != "de",
        is_generated=F.col("source") == "src3",
        inside_root=F.col("source") != "src5",
    )
    return found.select("request_id", "reason", "byte_start", "byte_length", "starting_line")


@query(
    "tag_index",
    r"""
    with t as (select page_id, unnest(regexp_extract_all(html, '(?s)<a(?:\s[^>]*)?>|<|[^<]+')) as tok,
                 generate_subscripts(regexp_extract_all(html, '(?s)<a(?:\s[^>]*)?>|<|[^<]+'), 1) as i
               from pages),
         o as (select *, coalesce(sum(strlen(tok)) over (partition by page_id order by i
                 rows between unbounded preceding and 1 preceding), 0) as b from t)
    select page_id, cast(b as bigint) as byte_start, cast(strlen(tok) as bigint) as byte_length
    from o where regexp_full_match(tok, '(?s)<a(?:\s[^>]*)?>')""",
)
def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return textindex.tag_index(pages, "page_id", "html", "a")


# --- module text derived from `part` -------------------------------------------------------------

_PIECES = {
    # p_size % 5 -> text of one part; {k} is its key, {n} its name, {t} its type.
    0: "@a{k} = unnamed_addr alias void (), ptr @f{k}\n",
    1: "define void @f{k}() {{\n  ; {n} {{\n  call void asm \"}} {t}\", \"\"()\n  ret void\n}}\n\n",
    2: "define void\n @\"f{k}\\20{n}\"(\n) {{ ret void }}\n!{k} = !{{ptr @f{k} }}\n",
    3: "@e{k} = alias i8, getelementptr (i8, ptr @f{k}, i64 1)\n",
    4: "define {{ i8, ptr }} @f{k}(ptr %{t}) prefix {{ i32 }} {{ i32 {k} }} {{\nentry:\n  ret {{ i8, ptr }} undef\n}}\n",
}


def _sql_text(template: str) -> str:
    text = template.replace("{{", "\1").replace("}}", "\2").replace("'", "''")
    for mark, column in (("{k}", "p_partkey"), ("{n}", "p_name"), ("{t}", "p_type")):
        text = text.replace(mark, f"' || {column} || '")
    text = text.replace("\1", "{").replace("\2", "}").replace("\n", "' || chr(10) || '")
    return f"'{text}'"


def _spark_text(template: str) -> Column:
    columns = {"{k}": F.col("p_partkey").cast("string"), "{n}": F.col("p_name"), "{t}": F.col("p_type")}
    parts = re.split(r"(\{[knt]\})", template.replace("{{", "\1").replace("}}", "\2"))
    return F.concat(
        *[
            columns[p] if p in columns else F.lit(p.replace("\1", "{").replace("\2", "}"))
            for p in parts
        ]
    )


_PIECE_SQL = "case p_size % 5 " + " ".join(
    f"when {k} then {_sql_text(v)}" for k, v in _PIECES.items()
) + " end"


@query(
    "ir_index",
    f"""
    with p as (select *, p_size % 5 as k, {_PIECE_SQL} as piece from part),
         o as (select *, coalesce(sum(strlen(piece)) over (partition by p_brand order by p_partkey
                 rows between unbounded preceding and 1 preceding), 0) as b from p)
    select p_brand as module,
           case k when 0 then 'a' || p_partkey when 3 then 'e' || p_partkey
                  when 2 then 'f' || p_partkey || ' ' || p_name else 'f' || p_partkey end as raw_symbol,
           case k when 0 then 'direct_alias' when 3 then 'expression_alias' else 'function' end as kind,
           case k when 0 then 'f' || p_partkey end as target,
           cast(b as bigint) as start,
           cast(case k when 1 then strlen(piece) - 2 when 4 then strlen(piece) - 1
                when 2 then strlen(piece) - strlen('!' || p_partkey || ' = !{{ptr @f' || p_partkey || ' }}') - 2
                else strlen(piece) end as bigint) as length
    from o""",
)
def ir_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of module text that Spark derives from `part`: one module per brand.

    The text is never put together: its pieces become lines by running sums, and lines are what
    the index reads. Two of the five forms need the header helper.
    """
    part = table(spark, sf_dir, "part")
    piece = F.coalesce(
        *[F.when(F.col("p_size") % 5 == k, _spark_text(v)) for k, v in _PIECES.items()]
    )
    pieces = part.select(F.col("p_brand").alias("module"), "p_partkey", piece.alias("piece"))
    parts = F.regexp_extract_all("piece", F.lit(r"[^\n]*+\n|[^\n]++"), F.lit(0))
    lines_in = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    placed = running_totals(
        pieces,
        ["module"],
        "p_partkey",
        {"__line": lines_in, "__byte": F.octet_length("piece")},
    )
    lines = placed.select(
        "module",
        "__line",
        "__byte",
        parts.alias("parts"),
    ).select("*", F.posexplode("parts").alias("__i", "line"))
    head = F.aggregate(
        F.slice("parts", F.lit(1), F.col("__i")),
        F.lit(0).cast("bigint"),
        lambda a, s: a + F.octet_length(s),
    )
    lines = lines.select(
        "module",
        (F.col("__line") + F.col("__i")).alias("line_no"),
        (F.col("__byte") + head).alias("byte_start"),
        F.encode("line", "UTF-8").alias("line"),
    )
    definitions, _ = textindex.index_blocks(cut_lineage(lines), ["module"])
    return definitions


# --- resolution ----------------------------------------------------------------------------------

_ALIAS_SQL = """
    with recursive d as (
           select p_partkey % 8 as module, p_partkey as symbol,
                  case when p_size % 10 = 9 then 'function' when p_size % 10 = 7 then 'ifunc'
                       else 'direct_alias' end as kind,
                  case when p_size % 10 < 7 then p_partkey + 8
                       when p_size % 10 = 8 then p_partkey - 40 end as target
           from part),
         w as (select module, symbol as root, symbol as cur, 0 as hops, [symbol] as path,
                      false as again, true as known, kind, target
               from d
               union all
               select w.module, root, w.target, hops + 1, list_append(path, w.target),
                      list_contains(path, w.target), n.symbol is not null, n.kind, n.target
               from w left join d n on n.module = w.module and n.symbol = w.target
               where w.kind = 'direct_alias' and not w.again),
         e as (select *, case when again then 'alias_cycle' when not known then 'no_exact_definition'
                              when kind = 'function' then 'body' else 'unsupported_alias' end as status
               from w where again or not known or kind <> 'direct_alias')
"""


def _alias_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tens = F.col("p_size") % 10
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key % 8).alias("module"),
        key.alias("symbol"),
        F.when(tens == 9, "function").when(tens == 7, "ifunc").otherwise("direct_alias").alias("kind"),
        F.when(tens < 7, key + 8).when(tens == 8, key - 40).alias("target"),
    )


@query(
    "alias_closure",
    _ALIAS_SQL
    + """select module, root as symbol, status, case when status <> 'alias_cycle' then cur end as "end",
         case when status <> 'alias_cycle' then cast(hops as bigint) end as hops from e""",
)
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_aliases(_alias_definitions(spark, sf_dir), ["module"], "symbol")


@query(
    "alias_paths",
    _ALIAS_SQL
    + """, s as (select module, root, hops, path from e where status <> 'alias_cycle' and hops > 0)
    select module, root, cast(i - 1 as bigint) as step, path[i] as alias
    from s, unnest(range(1, hops + 1)) as u(i)""",
)
def alias_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = _alias_definitions(spark, sf_dir)
    return resolve.alias_paths(
        definitions, definitions, ["module"], root="symbol", symbol="symbol"
    )


_BODIES_SQL = """
    with recursive d as (
           select l_returnflag || '.' || l_linestatus as module, l_partkey as symbol,
                  case count(*) % 5 when 0 then 'ifunc' when 1 then 'direct_alias'
                       else 'function' end as kind,
                  case when count(*) % 5 = 1 then l_partkey + 1 end as target,
                  min(l_orderkey) as start, count(*) as length
           from lineitem group by 1, 2),
         w as (select module, symbol as root, symbol as cur, 0 as hops, [symbol] as path,
                      false as again, true as known, kind, target, start, length
               from d
               union all
               select w.module, root, w.target, hops + 1, list_append(path, w.target),
                      list_contains(path, w.target), n.symbol is not null, n.kind, n.target,
                      n.start, n.length
               from w left join d n on n.module = w.module and n.symbol = w.target
               where w.kind = 'direct_alias' and not w.again),
         e as (select *, case when again then 'alias_cycle' when not known then 'no_exact_definition'
                              when kind = 'function' then 'body' else 'unsupported_alias' end as status
               from w where again or not known or kind <> 'direct_alias'),
         b as (select p_partkey, module, status, cur as body_symbol, cast(hops as bigint) as hops,
                      case when status = 'body' then start end as start,
                      case when status = 'body' then length end as length
               from part join e on e.root = p_partkey)
"""


def _bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, lineitem = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    module = F.concat_ws(".", "l_returnflag", "l_linestatus")
    rows = F.col("rows") % 5
    definitions = (
        lineitem.groupBy(module.alias("compiler_module"), F.col("l_partkey").alias("raw_symbol"))
        .agg(F.count("*").alias("rows"), F.min("l_orderkey").alias("start"))
        .select(
            F.lit("all").alias("capture_id"),
            "compiler_module",
            "raw_symbol",
            F.when(rows == 0, "ifunc").when(rows == 1, "direct_alias").otherwise("function").alias("kind"),
            F.when(rows == 1, F.col("raw_symbol") + 1).alias("target"),
            "start",
            F.col("rows").alias("length"),
        )
    )
    instances = part.select(
        F.lit("all").alias("capture_id"),
        F.col("p_partkey").alias("ordinal"),
        F.col("p_partkey").alias("raw_symbol"),
    )
    modules = (
        lineitem.select(F.lit("all").alias("capture_id"), module.alias("compiler_module"))
        .distinct()
        .withColumns({"artifact_id": F.lit(1), "stage": F.lit("no_lto_optimized")})
    )
    return instances, resolve.symbol_bodies(instances, definitions, modules)


@query("symbol_bodies", _BODIES_SQL + "select * from b")
def symbol_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body of a symbol in every module that knows it, through alias chains."""
    _, bodies = _bodies(spark, sf_dir)
    return bodies.select(
        F.col("ordinal").alias("p_partkey"),
        F.col("compiler_module").alias("module"),
        "status",
        "body_symbol",
        "hops",
        "start",
        "length",
    )


@query(
    "evidence_outcome",
    _BODIES_SQL
    + """select p_partkey, case
           when coalesce(bool_or(status = 'alias_cycle'), false) then 'alias_cycle'
           when coalesce(bool_or(status = 'body'), false) then 'available'
           when coalesce(bool_or(status = 'unsupported_alias'), false) then 'unsupported_alias'
           else 'no_exact_definition' end as outcome,
         case when coalesce(bool_or(status = 'alias_cycle'), false) then 0
              else count(*) filter (status = 'body') end as bodies
    from part left join b using (p_partkey) group by p_partkey""",
)
def evidence_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances, bodies = _bodies(spark, sf_dir)
    return resolve.evidence_outcome(instances, bodies).select(
        F.col("ordinal").alias("p_partkey"), "outcome", "bodies"
    )


@query(
    "resolve_refs",
    """
    with i as (select cast(o_custkey as varchar) as c, o_orderkey,
                      row_number() over (partition by o_custkey order by o_orderkey) - 1 as n
               from orders),
         k as (select c, count(*) as instance_count from i group by c),
         r as (select o_orderkey as id, o_custkey || ':' || (o_orderkey % 20) as t from orders
               union all select -1 - c_custkey, c_custkey || ':0' from customer
               union all select -1000000000 - c_custkey, c_custkey || ':01' from customer),
         p as (select id, t, split_part(t, ':', 1) as c, split_part(t, ':', 2) as n from r)
    select p.id as reference_id, p.t as reference,
           case when p.n <> '0' and p.n like '0%' then 'malformed'
                when k.c is null then 'unknown_capture'
                when i.c is null then 'invalid_ordinal' else 'found' end as status,
           case when not (p.n <> '0' and p.n like '0%') then k.instance_count end as instance_count,
           case when not (p.n <> '0' and p.n like '0%') then i.o_orderkey end as o_orderkey
    from p left join k on k.c = p.c left join i on i.c = p.c and i.n = cast(p.n as bigint)""",
)
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    instances = ordinals(orders, ["o_custkey"], ["o_orderkey"])
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    asked = (
        orders.select(
            F.col("o_orderkey").alias("reference_id"),
            F.concat_ws(":", "o_custkey", F.col("o_orderkey") % 20).alias("reference"),
        )
        .unionByName(
            customers.select(
                (-1 - F.col("c_custkey")).alias("reference_id"),
                F.concat("c_custkey", F.lit(":0")).alias("reference"),
            )
        )
        .unionByName(
            customers.select(
                (-1_000_000_000 - F.col("c_custkey")).alias("reference_id"),
                F.concat("c_custkey", F.lit(":01")).alias("reference"),
            )
        )
    )
    resolved = resolve.resolve_references(
        asked, "reference", instances, "o_custkey", "ordinal", "[0-9]+"
    )
    return resolved.select(
        "reference_id",
        "reference",
        "status",
        "instance_count",
        F.col("instance.o_orderkey").alias("o_orderkey"),
    )


# --- assembly ------------------------------------------------------------------------------------


@query(
    "assemble_groups",
    """
    select l_orderkey, l_linenumber, count(*) as placements, min(l_suppkey) as source,
           min(l_suppkey) <> max(l_suppkey) as conflict
    from lineitem group by 1, 2""",
)
def assemble_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assemble_groups(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_suppkey")
    )


_ARRIVAL = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "number_placements",
    f"""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
           row_number() over (partition by l_orderkey, l_linenumber
                              order by {", ".join(_ARRIVAL)}) - 1 as placement_no
    from lineitem""",
)
def number_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem").select(*keys, *_ARRIVAL)
    numbered = assemble.number_placements(rows, keys, _ARRIVAL)
    return numbered.select(*keys, "l_partkey", "l_suppkey", "placement_no")


@query(
    "ordinals",
    """
    select p_brand, p_partkey, row_number() over (partition by p_brand
             order by p_type, p_name, p_size, p_partkey) - 1 as ordinal
    from part""",
)
def assign_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name", "p_size", "p_partkey")
    numbered = assemble.assign_ordinals(
        part, ["p_brand"], ["p_type", "p_name", "p_size", "p_partkey"]
    )
    return numbered.select("p_brand", "p_partkey", "ordinal")


@query(
    "current_pointer",
    """
    select o_custkey, o_orderkey, o_orderpriority from orders
    qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""",
)
def current_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.current_candidates(
        table(spark, sf_dir, "orders"),
        ["o_custkey"],
        F.struct("o_orderdate", "o_orderkey"),
        ["o_orderkey", "o_orderpriority"],
    )


@query(
    "next_artifact_ids",
    """
    with m as (select p_brand, max(p_size) as top from part where p_brand <> 'Brand#3' group by 1)
    select p_brand, p_partkey, cast(coalesce(top + 1, 0) + row_number() over
             (partition by p_brand order by p_partkey) - 1 as bigint) as artifact_id,
           false as overflow
    from part left join m using (p_brand)""",
)
def next_artifact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids behind the stored ones; one brand has none stored, which is the case of an empty store."""
    part = table(spark, sf_dir, "part")
    stored = part.filter(F.col("p_brand") != "Brand#3").select(
        "p_brand", F.col("p_size").cast("bigint").alias("artifact_id")
    )
    return assemble.next_artifact_ids(
        part.select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", stored
    )


@query(
    "dedup_snapshots",
    """
    with f as (select text, min(doc_id) as first from documents group by text),
         n as (select *, row_number() over (order by first) - 1 as snapshot_id from f)
    select doc_id, snapshot_id, doc_id = first as is_first from documents join n using (text)""",
)
def dedup_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assemble.dedup_snapshots(docs, "doc_id", F.col("text")).drop("text")


@query(
    "selector",
    """
    with c as (select p_brand, p_partkey, p_name,
                      case p_size % 5 when 0 then ['rlib', 'cdylib'] when 1 then ['bin']
                           when 2 then ['example'] when 3 then ['bench'] else ['custom'] end as kinds
               from part),
         s as (select c_custkey, 'Brand#' || (c_custkey % 30) as p_brand,
                      (['lib', 'bin', 'example', 'bench'])[c_custkey % 4 + 1] as kind,
                      p_name as name
               from customer left join part on p_partkey = c_custkey),
         h as (select c_custkey, min(p_partkey) as p from s join c using (p_brand)
               where case s.kind when 'lib' then len(list_intersect(kinds,
                           ['lib', 'rlib', 'dylib', 'cdylib', 'staticlib', 'proc-macro'])) > 0
                         else list_contains(kinds, s.kind) and c.p_name = s.name end
               group by 1)
    select c_custkey, s.p_brand as package,
           case when s.p_brand not in (select p_brand from part) then 'package_not_found'
                when h.p is null then 'target_not_found' else 'found' end as status,
           h.p as position, part.p_name as name
    from s left join h using (c_custkey) left join part on part.p_partkey = h.p""",
)
def selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    fifth = F.col("p_size") % 5
    kinds = (
        F.when(fifth == 0, F.array(F.lit("rlib"), F.lit("cdylib")))
        .when(fifth == 1, F.array(F.lit("bin")))
        .when(fifth == 2, F.array(F.lit("example")))
        .when(fifth == 3, F.array(F.lit("bench")))
        .otherwise(F.array(F.lit("custom")))
    )
    catalog = part.select(
        F.col("p_brand").alias("package"),
        F.col("p_partkey").alias("position"),
        F.col("p_name").alias("name"),
        kinds.alias("kinds"),
    )
    names = part.select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("name"))
    classes = F.array(*[F.lit(k) for k in assemble.SELECTOR_KINDS])
    selectors = customer.join(names, "c_custkey", "left").select(
        "c_custkey",
        F.concat(F.lit("Brand#"), F.col("c_custkey") % 30).alias("package"),
        F.element_at(classes, (F.col("c_custkey") % 4 + 1).cast("int")).alias("kind"),
        "name",
    )
    return assemble.resolve_selector(selectors, "c_custkey", catalog)
