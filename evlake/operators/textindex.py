"""Definitions in module text: symbols, kinds and exact byte ranges.

Works on lines, not on whole texts: quotes and comments end with their line. A line of any length
is read in segments. What a segment does to the state of the reader (code, quote, comment, half an
escape) is tabled for every state it can start in; the tables of a line's segments compose from the
left, and each segment is then read from its known state. Only lines that start or close something
become rows; brace depth, event and definition numbers are running sums over these.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evlake.functions.headers import HEADER_LIMIT, QUOTED, SYMBOL, decode_symbol, read_headers
from evlake.operators.scale import BLOCK, running_totals
from evlake.session import cut_lineage

# Ship the one Python helper with its tasks, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of a long line that are read together, at least; a definition's header is no longer.
SEGMENT = HEADER_LIMIT
# Bytes of a header that are looked at first; most headers end there.
FIRST_LOOK = 1 << 12
# For each look, the bytes of text under one number, where headers look for their lines. All headers
# and lines of a number meet, so it is narrow where headers may be short.
REACH = {FIRST_LOOK: 1 << 10, HEADER_LIMIT: 1 << 16}
# Runs of a line whose places are summed within its row.
FEW = 64

# Java patterns over one line whose characters are single bytes.
_BLANK = r"[ \t\r\f]*"
_HIDDEN = rf"{QUOTED}|;[^\n]*"
_MODIFIERS = r"(?:[a-z_]+(?:\([a-z0-9]*\))?[ \t]+)*?"
_FLAT = r"(?:[^(){}\[\]<>,;\"@=]|\([^(){}\[\]<>;\"@=]*\))++"
# One-line forms the disassembler prints.
_BARE = r'[^()\[\]{}<>";\n]'
_INSIDE = rf"{_BARE}*+"
_AGGREGATE = rf"\{{{_INSIDE}\}}|\[{_INSIDE}\]|<{_INSIDE}>"
_RESULT = rf'define[ \t](?:[^()\[\]{{}}<>@=";\n]|\({_INSIDE}\)|{_AGGREGATE})*+'
_NAMED = rf"^({_RESULT})({SYMBOL})"
_FUNCTION = (
    rf"^(?!.*\bpersonality\b(?! ptr @)){_RESULT}{SYMBOL}\((?:{_BARE}|\({_INSIDE}\))*+\)"
    rf"[^{{}};()\"=\[\]<>@]*(?:personality ptr {SYMBOL}[ \t]*)?\{{{_BLANK}\n?\z"
)
# With one constant, whose type and value are each a number, an integer type, or a flat group.
_PREFIXED = (
    rf"^(?![^\n]*\bpersonality\b)(?![^\n]*\b(?:prefix|prologue)\b[^\n]*\b(?:prefix|prologue)\b)"
    rf"{_RESULT}{SYMBOL}\({_INSIDE}\)[^{{}};()\"=\[\]<>@]*(?<=[ \t)])(?:prefix|prologue)[ \t]+"
    rf"(?:{_AGGREGATE}|i[0-9]++)[ \t]+(?:{_AGGREGATE}|-?[0-9]++)[ \t]*\{{{_BLANK}\n?\z"
)
_SKIPPED = rf"^{SYMBOL}[ \t]*=[ \t]*{_MODIFIERS}(?:global|constant)[ \t]"
_DIRECT = rf"^(({SYMBOL})[ \t]*=[ \t]*{_MODIFIERS}alias[ \t]{_FLAT},[ \t]*ptr[ \t]+)({SYMBOL}){_BLANK}\n?\z"
_EXPRESSION = (
    rf"^({SYMBOL})[ \t]*=[ \t]*(?:(?!(?:alias|ifunc|global|constant)\b)[a-z_]+(?:\([a-z0-9]*\))?[ \t]+)*+alias[ \t]+"
    rf"(?:{_AGGREGATE}|[a-z][a-z0-9]*+(?:[ \t]*\({_INSIDE}\))?)[ \t]*,[ \t]*(?:ptr[ \t]+)?"
    rf"(?:getelementptr(?:[ \t]+inbounds)?|bitcast|addrspacecast|inttoptr)[ \t]*\({_INSIDE}\){_BLANK}\n?\z"
)
# Top-level lines that end with their line and never open a body.
_UNRELATED = (
    r"^(?:!|declare[ \t]|attributes[ \t]|source_filename[ \t]|target[ \t]|module asm[ \t]"
    r"|%[^=]*=[ \t]*type[ \t]|\^[0-9]+[ \t]*=|\$[^=]*=[ \t]*comdat|uselistorder)"
)
_ONE_LINE = ("function", "direct_alias", "expression_alias")
_START_WORD = r"^define(?:[ \t\r\n\f]|\z)"
# A brace behind which a definition starts on the same line, and the pieces that end with one.
_CROWDED = rf"\}}(?=[ \t\r\f]*(?:define[ \t]|{SYMBOL}[ \t]*=))"
_PIECES = rf"(?:{QUOTED}|;[^\n]*|[^\}}]|(?!{_CROWDED})\}})*+(?:\}}|\z)"


# A run without braces outside quotes and comments, or one brace.
_RUNS = rf'(?:{QUOTED}|;[^\n]*+|[^"{{}};]|")++|[{{}}]'
# Up to a quote that is not well-formed, or the end.
_SOUND = rf'^(?:[^";]|{QUOTED}|;[^\n]*+)*+'
# A brace at the end of a segment behind which the next one may go on with a definition.
_TORN = r"\}[ \t\r\f]*(?:d[a-z]{0,5}|@(?:[-A-Za-z0-9_.$]*+|\"[^\"\n]*+\"?))?[ \t]*\z"
# What stands before a segment that starts in code, a quote, a comment, behind a backslash in a
# quote, or behind its first digit.
_LEADS = ["", '"', ";", '"\\', '"\\0']


def _state_behind(text: Column) -> Column:
    """The state at the end of a text without newline that starts in code."""
    rest = F.regexp_replace(text, r'^(?:[^";]|"[^"]*+")*+', "")
    body = r'(?s)^"(?:[^"\\]|\\\\|\\[0-9A-Fa-f]{2})*+'
    return (
        F.when(rest == "", 0).when(rest.startswith(";"), 2)
        .when(rest.rlike(body + r"\\\z"), 3).when(rest.rlike(body + r"\\[0-9A-Fa-f]\z"), 4)
        .otherwise(1)
    )


def _composed(rows: pa.Table) -> pa.Table:
    """The state in which each segment of one line starts."""
    rows = rows.sort_by("seg")
    states, at = [], 0
    for table in rows.column("behind").to_pylist():
        states.append(at)
        at = table[at]
    return rows.drop_columns(["behind"]).append_column("state", pa.array(states, pa.int32()))


def _segments(lines: DataFrame, ks: list[str]) -> DataFrame:
    """``byte_start, text, head, last, lead, quiet``: lines, long ones in segments.

    ``text`` has a character per byte and starts with the ``lead`` characters of its state. ``head``
    and ``last`` tell the ends of a line; ``quiet`` rows go on with a line that opens nothing.
    """
    text = F.decode("line", "ISO-8859-1")
    whole = lines.filter(~F.col("cut")) if "cut" in lines.columns else lines
    whole = whole.select(
        *ks, "byte_start", text.alias("text"), F.lit(True).alias("head"), F.lit(True).alias("last"),
        F.lit(0).alias("lead"), F.lit(False).alias("quiet"),
    )
    if "cut" not in lines.columns:
        return whole
    parts = lines.filter("cut")
    extent = parts.groupBy(*ks, "line_no").agg(
        F.min("byte_start").alias("__from"), F.max("byte_start").alias("__to")
    )
    seg = lambda at: F.floor((at - F.col("__from")) / F.lit(SEGMENT))
    joined = parts.join(extent, [*ks, "line_no"]).select(
        *ks, "line_no", "byte_start", "line", seg(F.col("byte_start")).alias("seg"), seg(F.col("__to")).alias("__last")
    )
    # A segment is bounded: `SEGMENT` bytes and the rest of the piece at its end.
    glued = cut_lineage(
        joined.groupBy(*ks, "line_no", "seg", "__last").agg(
            F.min("byte_start").alias("byte_start"),
            F.expr("listagg(line) within group (order by byte_start)").alias("line"),
        )
    )
    long = glued.filter(F.col("__last") > 0)
    behind = F.array(*[_state_behind(F.concat(F.lit(p), text)).cast("int") for p in _LEADS])
    tables = long.select(*ks, "line_no", "seg", behind.alias("behind"))
    kinds = {f.name: f.dataType.simpleString() for f in tables.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*ks, "line_no", "seg"]) + ", state int"
    states = tables.groupBy(*ks, "line_no").applyInArrow(_composed, schema)
    body = F.ltrim(text, F.lit(" \t\r\f"))
    heads = long.filter("seg = 0").select(
        *ks, "line_no", (text.rlike(_UNRELATED) | body.rlike(_SKIPPED)).alias("quiet")
    )
    lead = F.get(F.array(*[F.lit(p) for p in _LEADS]), F.col("state"))
    later = long.join(states, [*ks, "line_no", "seg"]).join(heads, [*ks, "line_no"]).select(
        *ks, "byte_start", F.concat(lead, text).alias("text"), (F.col("seg") == 0).alias("head"),
        (F.col("seg") == F.col("__last")).alias("last"), F.length(lead).alias("lead"),
        (F.col("quiet") & (F.col("seg") > 0)).alias("quiet"),
    )
    single = glued.filter(F.col("__last") == 0).select(
        *ks, "byte_start", text.alias("text"), F.lit(True).alias("head"), F.lit(True).alias("last"),
        F.lit(0).alias("lead"), F.lit(False).alias("quiet"),
    )
    return whole.unionByName(single).unionByName(later)


def _uncrowded(segments: DataFrame, ks: list[str]) -> DataFrame:
    """Segments cut behind every brace that has a definition behind it on the same line.

    Neither ``define`` nor an assignment to ``@`` can stand inside a body, so where one follows a
    brace, that brace closes a body or the module is broken.
    """
    crowded = F.col("text").contains("}") & F.col("text").rlike(_CROWDED)
    pieces = F.filter(F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0)), lambda p: p != "")
    names = [c for c in segments.columns if c not in ks]
    rows = segments.filter(crowded).select("*", F.size(pieces).alias("__n"), F.posexplode(pieces).alias("__i", "__piece"))
    earlier = W.partitionBy(*ks, "byte_start").orderBy("__i").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("__piece")).over(earlier), F.lit(0))
    first = F.col("__i") == 0
    cut = rows.select(
        *ks,
        (F.col("byte_start") + F.when(first, 0).otherwise(before - F.col("lead"))).cast("bigint").alias("byte_start"),
        F.col("__piece").alias("text"),
        (F.col("head") | ~first).alias("head"),
        (F.col("last") | (F.col("__i") < F.col("__n") - 1)).alias("last"),
        F.when(first, F.col("lead")).otherwise(0).alias("lead"),
        (F.col("quiet") & first).alias("quiet"),
    )
    return segments.filter(~crowded).select(*ks, *names).unionByName(cut.select(*ks, *names))


def _features(units: DataFrame, ks: list[str]) -> DataFrame:
    """What the sums need of lines that start, open or close something; the text stays behind."""
    # No other line can have any of these.
    units = units.filter(~F.col("last") | F.col("text").rlike(r'[{}"@=]|define'))
    # The quote that a segment leaves open is the next one's.
    sound = F.regexp_extract("text", _SOUND, 0)
    rest = F.substr("text", F.length(sound) + 1)
    open_quote = rest.rlike(r'^"(?:[^"\\\r\n]|\\\\|\\[0-9A-Fa-f]{2})*+(?:\\[0-9A-Fa-f]?)?\z')
    text = F.when(~F.col("last") & open_quote, sound).otherwise(F.col("text"))
    rows = units.withColumn("__text", text)
    rows = rows.withColumns({
        "__body": F.ltrim("__text", F.lit(" \t\r\f")), "__bare": F.when(
            F.col("__text").contains('"') | F.col("__text").contains(";"), F.regexp_replace("__text", _HIDDEN, "")
        ).otherwise(F.col("__text")),
    })
    bare = F.col("__bare")
    seen = F.ltrim(bare, F.lit(" \t\r\f"))
    is_define = F.col("__body").startswith("define") & F.col("__body").rlike(_START_WORD)
    is_at = F.col("__body").startswith("@")
    behind = F.regexp_replace("__body", rf"^{SYMBOL}", "")
    behind = F.regexp_replace(behind, r"^[ \t\r\f]*(;[^\n]*)?", "")
    form = F.when(
        F.col("head"),
        F.when(is_define & F.col("last") & F.when(
            bare.rlike(r"\b(?:prefix|prologue)\b"), F.col("__body").rlike(_PREFIXED)
        ).otherwise(F.col("__body").rlike(_FUNCTION)), "function")
        .when(is_define, "header")
        .when(is_at & F.col("__body").rlike(_SKIPPED), "skipped")
        .when(is_at & F.col("last") & F.col("__body").rlike(_DIRECT), "direct_alias")
        .when(is_at & F.col("last") & F.col("__body").rlike(_EXPRESSION), "expression_alias")
        .when(is_at & behind.startswith("="), "header")
        .when(is_at & behind.isin("", "\n"), "symbol_alone")
        .when(is_at, "stray"),
    )
    rows = rows.withColumn("form", form)
    # A global's value ends with its line, whatever it contains.
    quiet = F.col("quiet") | (F.col("head") & (F.col("__text").rlike(_UNRELATED) | F.coalesce(F.col("form") == "skipped", F.lit(False))))
    rows = rows.withColumn("__quiet", quiet)
    quiet = F.col("__quiet")
    braces = ~quiet & (F.col("__text").contains("{") | F.col("__text").contains("}"))
    run = lambda t: F.struct(F.length(t).alias("n"), F.when(t == "{", 1).when(t == "}", -1).otherwise(0).alias("step"))
    runs = F.when(braces, F.transform(F.regexp_extract_all("__text", F.lit(_RUNS), F.lit(0)), run))
    one = F.col("form").isin(*_ONE_LINE)
    symbol = (
        F.when(F.col("form") == "function", F.regexp_extract("__body", _NAMED, 2))
        .when(F.col("form") == "direct_alias", F.regexp_extract("__body", _DIRECT, 2))
        .when(F.col("form") == "expression_alias", F.regexp_extract("__body", _EXPRESSION, 1))
    )
    target = F.when(F.col("form") == "direct_alias", F.regexp_extract("__body", _DIRECT, 3))
    # Where the tokens stand behind the line's blanks.
    symbol_at = F.when(F.col("form") == "function", F.length(F.regexp_extract("__body", _NAMED, 1)))
    target_at = F.when(F.col("form") == "direct_alias", F.length(F.regexp_extract("__body", _DIRECT, 1)))
    bad_quote = F.when(~quiet & bare.contains('"'), F.length(F.regexp_extract("__text", _SOUND, 0)))
    torn = ~F.col("last") & ~quiet & bare.rlike(_TORN)
    found = F.struct(
        "byte_start",
        "head",
        (F.length("text") - F.col("lead")).cast("bigint").alias("byte_len"),
        F.col("lead").alias("shift"),
        "form",
        (F.length("__text") - F.length("__body")).cast("bigint").alias("lead"),
        symbol.alias("symbol_token"),
        target.alias("target_token"),
        F.when(one, F.coalesce(symbol_at, F.lit(0))).cast("bigint").alias("symbol_at"),
        target_at.cast("bigint").alias("target_at"),
        runs.alias("runs"),
        (F.col("head") & seen.startswith("=")).alias("leads_with_equals"),
        (bad_quote - F.col("lead")).cast("bigint").alias("bad_quote"),
        torn.alias("torn"),
    )
    # As generated rows they are computed once; else the filter would compute them all for itself.
    found = rows.select(*ks, found.alias("__f")).select(*ks, F.explode(F.array("__f")).alias("__f"))
    return found.select(*ks, "__f.*").filter(
        F.col("form").isNotNull() | F.col("runs").isNotNull() | F.col("leads_with_equals")
        | F.col("bad_quote").isNotNull() | F.col("torn")
    )


def index_blocks(
    lines: DataFrame, keys: Sequence[str], block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Definitions and errors of module texts given as lines.

    ``lines`` holds ``keys``, ``byte_start`` and ``line`` with its newline, or pieces of lines with
    ``line_no`` and ``cut`` too, as `artifact_lines` makes them. Several definitions may stand on a
    line. Definitions: ``raw_symbol``, ``kind``, ``target``, ``start``, ``length``. Errors: ``error``
    and ``error_at``; a module with an error has no valid index. Where a line longer than ``SEGMENT``
    may hold a further definition across the end of a segment, the error is ``line_too_long``.
    """
    ks = list(keys)
    # The number first: sorts then compare numbers, and texts only where these are equal.
    at_line, at_block = ["byte_start", *ks], ["block_no", *ks]
    features = cut_lineage(_features(_uncrowded(_segments(lines, ks), ks), ks))
    # Braces as rows, with their place. Sums over few runs need no rows of their own; the window of
    # the others is one line's runs.
    few = F.size("runs") <= FEW
    place = lambda before: (F.col("unit") + before - F.col("shift")).cast("bigint").alias("at")
    runs = features.filter(F.col("runs").isNotNull()).select(
        *ks, F.col("byte_start").alias("unit"), "shift", few.alias("__few"), F.when(few, F.col("runs.n")).alias("__ns"),
        F.posexplode("runs").alias("__i", "__r"),
    )
    summed_here = F.aggregate(F.slice("__ns", F.lit(1), F.col("__i")), F.lit(0), lambda a, n: a + n)
    short = runs.filter("__few and __r.step != 0").select(*ks, "unit", place(summed_here), F.col("__r.step").alias("step"))
    earlier = W.partitionBy(*ks, "unit").orderBy("__i").rowsBetween(W.unboundedPreceding, -1)
    long = runs.filter("not __few").withColumn("__b", F.coalesce(F.sum("__r.n").over(earlier), F.lit(0))).select(
        *ks, "unit", place(F.col("__b")), F.col("__r.step").alias("step")
    ).filter(F.col("step") != 0)
    braces = short.unionByName(long)
    # A line comes before a brace at its start.
    marks = features.select(
        *ks, (F.col("byte_start") * 2).alias("pos"), F.col("byte_start").alias("unit"), F.lit(0).alias("step")
    ).unionByName(braces.select(*ks, (F.col("at") * 2 + 1).alias("pos"), "unit", "step"))
    summed = cut_lineage(
        running_totals(
            marks, ks, "pos", {"depth": F.col("step"), "event": (F.col("step") == 0).cast("int")}, block
        )
    )
    depths = summed.filter("step = 0").select(*ks, F.col("unit").alias("byte_start"), "depth", "event")
    events = cut_lineage(features.drop("runs").join(depths, at_line))
    top = F.col("depth") == 0
    zeros = summed.filter((F.col("step") == -1) & (F.col("depth") == 1))
    below = summed.filter((F.col("step") == -1) & (F.col("depth") <= 0))
    plain = events.filter(top & F.col("form").isin(*_ONE_LINE, "skipped", "header"))
    # A symbol alone on its line starts a value when the next event is a line that begins with `=`.
    follows = events.filter(top & F.col("leads_with_equals")).select(*ks, (F.col("event") - 1).alias("event"))
    split = (
        events.filter(top & (F.col("form") == "symbol_alone"))
        .join(follows, ["event", *ks], "left_semi")
        .withColumn("form", F.lit("header"))
    )
    starts = plain.unionByName(split.select(*plain.columns))
    strays = events.filter(top & F.col("form").isin("stray", "symbol_alone")).join(
        split.select(*ks, "byte_start"), at_line, "left_anti"
    )
    # The block of each end and stray: how many definitions have started before it.
    ordered = (
        starts.select(*ks, (F.col("byte_start") * 2).alias("pos"), F.lit(1).alias("__start"))
        .unionByName(zeros.select(*ks, "pos", F.lit(0).alias("__start")))
        .unionByName(strays.select(*ks, (F.col("byte_start") * 2).alias("pos"), F.lit(0).alias("__start")))
    )
    numbered = cut_lineage(running_totals(ordered, ks, "pos", {"block_no": F.col("__start")}, block))
    own = numbered.filter(F.col("pos") % 2 == 0).select(*ks, (F.col("pos") / 2).cast("bigint").alias("byte_start"), "__start", "block_no")
    blocks = cut_lineage(
        starts.join(own.filter("__start = 1").drop("__start"), at_line)
        .withColumn("block_no", F.col("block_no") + 1)
        .withColumn("begin", F.col("byte_start") + F.col("lead"))
    )
    ends = numbered.filter(F.col("pos") % 2 == 1).select(
        *ks, "block_no", ((F.col("pos") + 1) / 2).cast("bigint").alias("end")
    )
    size = lines.groupBy(*ks).agg(F.max(F.col("byte_start") + F.octet_length("line")).cast("bigint").alias("__size"))
    headers = _read_block_headers(lines, blocks, ks)

    read = F.col("form") == "header"
    kind = F.when(read, F.col("h.kind")).otherwise(F.col("form"))
    symbol = decode_symbol(F.when(read, F.col("h.symbol")).otherwise(F.col("symbol_token")))
    target = decode_symbol(F.when(read, F.col("h.target")).otherwise(F.col("target_token")))
    # The limit holds for every form of a header; a global's line is no header.
    too_long = (
        F.col("form").isin(*_ONE_LINE) & (F.col("byte_len") - F.col("lead") > HEADER_LIMIT)
    )
    parsed = blocks.join(headers, at_block, "left").select(
        *ks,
        "block_no",
        "begin",
        symbol.alias("raw_symbol"),
        kind.alias("kind"),
        target.alias("target"),
        F.when(read, F.col("begin") + F.col("h.consumed"))
        .otherwise(F.col("byte_start") + F.col("byte_len"))
        .alias("head_end"),
        (F.col("begin") + F.when(read, F.col("h.symbol_at")).otherwise(F.col("symbol_at"))).alias("symbol_place"),
        (F.col("begin") + F.when(read, F.col("h.target_at")).otherwise(F.col("target_at"))).alias("target_place"),
        F.when(too_long, F.lit("header_too_long")).otherwise(F.col("h.error")).alias("error"),
        (F.col("begin") + F.when(too_long, F.lit(HEADER_LIMIT)).otherwise(F.col("h.error_at"))).alias("error_at"),
    )
    # A body ends at the first brace behind its header that closes to depth zero.
    first_end = (
        parsed.filter(F.col("kind") == "function")
        .select(*ks, "block_no", "head_end")
        .join(ends, at_block)
        .filter(F.col("end") > F.col("head_end") - 1)
        .groupBy(*at_block)
        .agg(F.min("end").alias("body_end"))
    )
    ranged = (
        parsed.join(first_end, at_block, "left")
        .join(size, ks, "left")
        .withColumn(
            "end",
            F.when(F.col("kind") == "function", F.col("body_end")).otherwise(F.col("head_end")),
        )
    )
    named = F.col("kind").isNotNull() & (F.col("kind") != "skipped")
    bad_symbol = named & F.col("raw_symbol").isNull()
    bad_target = (F.col("kind") == "direct_alias") & F.col("target").isNull()
    error = (
        F.when(F.col("error").isNotNull(), F.struct(F.col("error"), F.col("error_at")))
        .when(bad_symbol, F.struct(F.lit("bad_symbol").alias("error"), F.col("symbol_place").alias("error_at")))
        .when(bad_target, F.struct(F.lit("bad_symbol").alias("error"), F.col("target_place").alias("error_at")))
        .when(
            named & F.col("end").isNull(),
            F.struct(F.lit("unclosed_body").alias("error"), F.col("__size").alias("error_at")),
        )
    )
    judged = cut_lineage(ranged.withColumn("__error", error))
    definitions = judged.filter(named & F.col("__error").isNull()).select(
        *ks,
        "raw_symbol",
        "kind",
        "target",
        F.col("begin").alias("start"),
        (F.col("end") - F.col("begin")).alias("length"),
    )
    block_errors = judged.filter(F.col("__error").isNotNull()).select(*ks, "__error.*")
    inside = F.col("depth") > 0
    # Only behind a brace that closes to depth zero can a definition go on.
    closed = (
        summed.filter("step != 0").join(events.filter("torn").select(*ks, F.col("byte_start").alias("unit")), ["unit", *ks])
        .groupBy(*ks, "unit").agg(F.max_by(F.col("depth") + F.col("step"), "pos").alias("__left"))
        .filter("__left = 0").select(*ks, F.col("unit").alias("byte_start"))
    )
    line_errors = (
        below.select(*ks, F.lit("unopened_brace").alias("error"), F.col("unit").alias("error_at"))
        .distinct()
        .unionByName(
            events.filter(F.col("bad_quote").isNotNull() & inside).select(
                *ks, F.lit("bad_quoted_text").alias("error"), (F.col("byte_start") + F.col("bad_quote")).alias("error_at")
            )
        )
        .unionByName(
            events.filter("torn").join(closed, at_line, "left_semi").select(
                *ks, F.lit("line_too_long").alias("error"), (F.col("byte_start") + F.col("byte_len")).alias("error_at")
            )
        )
    )
    # A symbol at the start of a line that neither assigns nor continues an open header.
    held = judged.select(*ks, "block_no", "end", F.col("__error").isNotNull().alias("__bad"))
    stray_errors = (
        strays.withColumn("begin", F.col("byte_start") + F.col("lead"))
        .join(own.drop("__start"), at_line)
        .join(held, at_block, "left")
        .filter(F.col("__bad").isNull() | (~F.col("__bad") & (F.col("begin") >= F.col("end"))))
        .select(*ks, F.lit("expected_assignment").alias("error"), F.col("begin").alias("error_at"))
    )
    return definitions, block_errors.unionByName(line_errors).unionByName(stray_errors)


def _read_block_headers(lines: DataFrame, blocks: DataFrame, ks: list[str]) -> DataFrame:
    """``h`` per block whose header is not one of the one-line forms.

    A header is looked for in the first bytes of its block. Where these don't decide, all of it is
    read, up to one byte over the limit: that byte tells a header that is too long from one that just
    fits.
    """
    at_block = ["block_no", *ks]
    nexts = blocks.select(*ks, (F.col("block_no") - 1).alias("block_no"), F.col("byte_start").alias("__next"))
    wanted = blocks.filter(F.col("form") == "header").select(*ks, "block_no", "begin").join(
        nexts, at_block, "left"
    )
    looks = []
    for limit in (FIRST_LOOK, HEADER_LIMIT):
        heads = cut_lineage(_texts_from(lines, wanted, ks, limit + 1, REACH[limit]))
        read = cut_lineage(read_headers(heads, at_block))
        settled = F.col("settled") | (F.col("size") <= limit)
        looks.append(read if limit == HEADER_LIMIT else read.filter(settled))
        wanted = wanted.join(read.filter(~settled).select(*at_block), at_block, "left_semi")
    fields = ["symbol", "symbol_at", "kind", "target", "target_at", "consumed", "error", "error_at"]
    return looks[0].unionByName(looks[1]).select(*ks, "block_no", F.struct(*fields).alias("h"))


def _texts_from(lines: DataFrame, wanted: DataFrame, ks: list[str], limit: int, reach: int) -> DataFrame:
    """``block_no, text``: at most ``limit`` bytes of each block from ``begin`` to ``__next``.

    Lines and blocks meet by the number of a stretch of ``reach`` bytes of text. A line is cut where
    these end, so that its bytes travel once, however long it is.
    """
    stretch = lambda c: F.call_function("div", c, F.lit(reach).cast("bigint"))
    stop = F.least(F.coalesce("__next", F.col("begin") + limit), F.col("begin") + limit)
    asked = wanted.select(*ks, "block_no", "begin", stop.alias("stop"))
    asked = asked.withColumn("__r", F.explode(F.sequence(stretch(F.col("begin")), stretch(F.col("stop") - 1))))
    end = F.col("byte_start") + F.octet_length("line").cast("bigint")
    first, last = stretch(F.col("byte_start")), stretch(end - 1)
    placed = lines.filter(F.octet_length("line") > 0).select(
        *ks, "byte_start", "line", F.explode(F.sequence(first, last)).alias("__r")
    )
    share = F.greatest("byte_start", F.col("__r") * reach)
    placed = placed.select(
        *ks, "__r", share.alias("__from"),
        F.substring("line", (share - F.col("byte_start") + 1).cast("int"), ((F.col("__r") + 1) * reach - share).cast("int")).alias("__part"),
    )
    skip = F.greatest(F.col("begin") - F.col("__from"), F.lit(0))
    length = F.col("stop") - F.greatest("begin", "__from")
    return (
        asked.join(placed, ["__r", *ks])
        .filter((F.col("__from") < F.col("stop")) & (F.col("__from") + F.octet_length("__part") > F.col("begin")))
        .select(
            *ks, "block_no", "__from",
            F.substring("__part", (skip + 1).cast("int"), length.cast("int")).alias("__part"),
        )
        .groupBy("block_no", *ks)
        .agg(F.expr("listagg(__part) within group (order by __from)").alias("__head"))
        .select(*ks, "block_no", F.decode("__head", "ISO-8859-1").alias("text"))
    )


def tag_index(pages: DataFrame, page_id: str, html: str, tag: str = "a") -> DataFrame:
    """Byte start and length of every ``<tag …>`` of a page, by sums over its tokens.

    Token lengths are summed inside the page's own row group; only lengths are shuffled.
    """
    opening = rf"<{tag}(?:\s[^>]*)?>"
    tokens = F.regexp_extract_all(html, F.lit(rf"(?s){opening}|<|[^<]+"), F.lit(0))
    sized = F.transform(
        tokens,
        lambda t: F.struct(
            F.octet_length(t).cast("bigint").alias("n"),
            t.rlike(rf"(?s)\A{opening}\z").alias("hit"),
        ),
    )
    rows = pages.select(page_id, F.posexplode(sized).alias("__i", "__t"))
    before = W.partitionBy(page_id).orderBy("__i").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.select(
        page_id,
        F.coalesce(F.sum("__t.n").over(before), F.lit(0)).cast("bigint").alias("byte_start"),
        F.col("__t.n").alias("byte_length"),
        F.col("__t.hit").alias("__hit"),
    )
    return placed.filter("__hit").drop("__hit")
