"""Symbols and definition headers of module text, as expressions and aggregates over token rows.

A header's tokens become rows. Tokens inside a parenthesised, bracketed or braced group fold into
one item, and every item into one letter; a header is then a short word over these letters, and the
language's rules are patterns over such words. Where a word ends before its pattern does, the item
behind the longest prefix that fits is the one at fault.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Bytes of a header, in whatever form it is written; a longer one is reported, never cut.
HEADER_LIMIT = 1 << 20

# Possessive loops: the JVM matches them without recursion, however long the text is.
QUOTED = r'"(?:[^"\\\r\n]|\\\\|\\[0-9A-Fa-f]{2})*+"'
NAME = r"[-A-Za-z0-9_.$]++"
SYMBOL = rf"@(?:{QUOTED}|{NAME})"

OPEN, CLOSE = "([{<", ")]}>"
BLANK = r"(?:[ \t\r\n\f]|;[^\n]*+)++"
# A group without groups, quotes or comments in it is one token.
FLAT = "|".join(rf'\{o}[^()\[\]{{}}<>";]*+\{c}' for o, c in zip(OPEN, CLOSE))
# Blanks behind a token go with it, unless they hold the end of a line or a comment.
TOKEN = (
    rf'(?s){BLANK}|(?:{FLAT}|[@%$!](?:{QUOTED}|{NAME})|{QUOTED}|{NAME}|[@%]?"|.)(?:[ \t\r\f]++(?![ \t\r\f\n;]))?'
)

# Letters of items. Words of the language have letters of their own, other words `w`.
WORDS = {
    "D": ("define", "declare"),
    "P": ("personality", "prefix", "prologue"),
    "L": ("false", "none", "null", "poison", "true", "undef", "zeroinitializer"),
    "r": ("ptr",), "d": ("addrspace",), "A": ("alias",), "I": ("ifunc",), "G": ("global", "constant"),
    "T": ("partition",),
}
GROUPS = dict(zip(OPEN, "pkba"))
_GROUP, _PLAIN = "pkba", "wrdPAIGTD"
# A type and a value: the value is a symbol, a group, a literal, or words before one of them.
_SPACE = r"(?:dN*+pN*+|(?!d))"
_TYPE = rf"(?:rN*+{_SPACE}|[{_GROUP}{_PLAIN.replace('r', '')}Lom]N*+)"
_VALUE = rf"(?:(?:[{_PLAIN}]N*+)++[s{_GROUP}Lq]|[s{_GROUP}L])"
# As much of a type and a value as there is; for the place of a fault.
_PART = rf"(?:{_TYPE}(?:[{_PLAIN}]N*+)*+|rN*+(?:dN*+)?)?"
_BEFORE_NAME = r"[^szeDBUM]"
_BEHIND_NAME = rf"(?:[^szeDBUMPb]|PN*+{_TYPE}{_VALUE})"
FUNCTION = rf"^D(?:{_BEFORE_NAME})*+(s)N*+p(?:{_BEHIND_NAME})*+b"
FUNCTION_PART = rf"^D(?:{_BEFORE_NAME})*+(?:sN*+(?:p(?:{_BEHIND_NAME})*+(?:PN*+{_PART})?)?)?"
_LINKAGE = rf"(?:N*+[p{_PLAIN.replace('A', '').replace('I', '').replace('G', '')}Lqom])*+N*+"
_OBJECT = rf"(?:N*+[{_GROUP}{_PLAIN}Lom])"
GLOBAL = rf"^sN*+e{_LINKAGE}G"
_TAIL = r"(?:N*+c(?:N*+[my]N*+[omxyec]|N*+TN*+q))*+"
ALIAS = rf"^sN*+e{_LINKAGE}[AI]{_OBJECT}++N*+cN*+{_TYPE}{_VALUE}{_TAIL}"
DIRECT = rf"^sN*+e{_LINKAGE}A{_OBJECT}++N*+cN*+rN*+{_SPACE}s"
ALIAS_PART = (
    rf"^s(?:N*+(?:e{_LINKAGE}(?:[AI](?:{_OBJECT}++N*+(?:cN*+(?:{_TYPE}{_VALUE}{_TAIL}"
    rf"(?:N*+cN*+(?:[my]N*+|TN*+)?)?|{_PART}))?|N*+))?)?)?"
)


def _code(token: Column) -> Column:
    """The letter of one token; blanks count only where they hold the end of a line."""
    first = F.substring(token, 1, 1)
    code = F.when(first.isin(" ", "\t", "\r", "\n", "\f", ";"), F.when(token.contains("\n"), "N").otherwise(""))
    code = code.when(first == "@", F.when(F.length(token) > 1, F.when(token == '@"', "B").otherwise("s")).otherwise("x"))
    code = code.when(first == '"', F.when(F.length(token) > 1, "q").otherwise("B"))
    code = code.when(token == '%"', "B")
    code = code.when(first == "!", F.when(F.length(token) > 1, "m").otherwise("y"))
    code = code.when(first.isin("%", "$"), F.when(F.length(token) > 1, "o").otherwise("x"))
    for opener, letter in GROUPS.items():
        code = code.when(first == opener, letter)
    code = code.when(token.isin(*CLOSE), "z").when(token == "=", "e").when(token == ",", "c")
    for letter, words in WORDS.items():
        code = code.when(token.isin(*words), letter)
    return code.when(token.rlike("^-?[0-9]"), "L").when(token.rlike(f"^{NAME}"), "w").otherwise("x")


def _items(heads: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per header: ``__items`` in order, their letters ``__codes`` (and ``__whole``, with broken
    groups as if they were whole), and the first fault inside a group.

    The window groups are single headers, whose length is bounded.
    """
    tokens = heads.select(
        *keys, F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("__i", "__all")
    )
    tokens = tokens.select(
        *keys, "__i", "__all", F.when(F.col("__all").rlike(r"^[ \t\r\n\f;]"), F.col("__all")).otherwise(
            F.rtrim("__all", F.lit(" \t\r\f"))
        ).alias("__tok"),
    )
    order = W.partitionBy(*keys).orderBy("__i")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    code = _code(F.col("__tok"))
    step = F.when(F.col("__tok").isin(*OPEN), 1).when(F.col("__tok").isin(*CLOSE), -1).otherwise(0)
    rows = tokens.select(
        *keys, "__i", code.alias("__code"), step.alias("__step"), F.length("__tok").cast("bigint").alias("__n"),
        F.length("__all").alias("__width"), F.when(code == "s", F.col("__tok")).alias("__symbol"),
        F.when(step != 0, F.translate("__tok", CLOSE, OPEN)).alias("__kind"),
    ).filter(F.col("__width") > 0)
    rows = rows.withColumns({
        "__at": F.coalesce(F.sum("__width").over(before), F.lit(0)),
        "__depth": F.coalesce(F.sum("__step").over(before), F.lit(0)),
    })
    top = (F.col("__depth") <= 0) & (F.col("__code") != "")
    rows = rows.withColumn("__item", F.sum(top.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # Other rows have had their part in the sums.
    rows = rows.filter(top | (F.col("__step") != 0) | (F.col("__code") == "B"))
    # On its own level, a delimiter's opener is the one before it, its closer the one behind it.
    level = F.col("__depth") + F.least("__step", F.lit(0))
    delimiters = W.partitionBy(*keys, F.col("__step") != 0, level).orderBy("__i")
    rows = rows.withColumns({
        "__opener": F.lag("__kind").over(delimiters), "__closer": F.lead("__at").over(delimiters),
    })
    inside = F.col("__depth") > 0
    reason = F.when(
        inside & (F.col("__step") == -1) & ~F.col("__kind").eqNullSafe(F.col("__opener")), "mismatched_delimiter"
    ).when(inside & (F.col("__code") == "B"), "bad_quoted_text")
    own_end = F.col("__at") + F.col("__n")
    # A flat group has its ends in itself.
    grouped = F.col("__code").isin(*GROUPS.values()) & (F.col("__step") != 0)
    first_end = F.when(F.col("__code").isin(*GROUPS.values()), F.col("__at") + 1).otherwise(own_end)
    item = F.struct(
        "__item", F.col("__code").alias("whole"), F.col("__at").alias("at"), first_end.alias("first_end"),
        F.when(grouped, F.col("__closer") + 1).otherwise(own_end).alias("end"), F.col("__symbol").alias("symbol"),
        (grouped & F.col("__closer").isNull()).alias("open"),
    )
    found = rows.filter(top | reason.isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(top, item))).alias("__items"),
        # The first fault inside a group; no later one can matter.
        F.min(F.when(reason.isNotNull(), F.struct(F.col("__at").alias("at"), reason.alias("reason"), "__item"))).alias("__wrong"),
    )
    at_fault = lambda x: x["whole"].isin(*GROUPS.values()) & (x["__item"] == F.col("__wrong.__item"))
    code = lambda x: F.when(at_fault(x), "M").when(x["open"], "U").otherwise(x["whole"])
    return found.withColumns({
        "__codes": F.array_join(F.transform("__items", code), ""),
        "__whole": F.array_join(F.transform("__items", lambda x: x["whole"]), ""),
    })


def read_headers(heads: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``symbol, symbol_at, kind, target, target_at, consumed, error, error_at``, ``settled`` and ``size``.

    One header per row, from its first byte, in characters that are single bytes. Symbols are as
    written. ``settled`` is false where the last token decides, so that more text could decide
    otherwise.
    """
    found = heads.select(*keys, text).join(_items(heads, keys, text), list(keys))
    items = F.col("__items")
    def matched(pattern: str, letters: Column) -> Column:
        """Items that the pattern takes up from the start; 0 where it does not fit."""
        return F.length(F.regexp_extract(letters, f"{pattern}", 0))

    # The second word has groups as if all were whole. The brace that opens the body need not be.
    codes, whole = F.col("__codes"), F.col("__whole")
    is_value = codes.startswith("s")
    body = F.length(F.regexp_extract(codes, FUNCTION_PART, 0))
    opens = (
        ~is_value & F.substr(whole, body + 1, F.lit(1)).eqNullSafe(F.lit("b"))
        & (F.length(F.regexp_extract(whole, FUNCTION, 0)) == body + 1)
    )
    function_n = F.when(opens, body + 1).otherwise(F.lit(0))
    global_n, alias_n = matched(GLOBAL, codes), matched(ALIAS, codes)
    # An alias ends with its line.
    line_ends = F.substr(codes, alias_n + 1, F.lit(1)).isin("N", "")
    part = F.length(F.regexp_extract(codes, ALIAS_PART, 0))
    found = found.withColumns({
        "__function": function_n, "__global": F.when(is_value, global_n).otherwise(0),
        "__alias": F.when(is_value & line_ends, alias_n).otherwise(0),
        "__fault": F.when(~is_value, body).otherwise(F.greatest(alias_n, part)),
        # Whether a group could stand at the fault.
        "__grouped": F.when(~is_value, F.length(F.regexp_extract(whole, FUNCTION_PART, 0)) > body).otherwise(
            F.length(F.regexp_extract(whole, ALIAS_PART, 0)) > part
        ),
    })
    n_items, size = F.size(items), F.length(text).cast("bigint")
    at = lambda i: F.get(items, i - 1)
    taken = F.greatest("__function", "__global", "__alias")
    behind = (at(F.greatest("__global", "__alias"))["end"] + 1).cast("int")
    line = F.call_function("locate", F.lit("\n"), F.col(text), behind)
    line_end = F.when(line > 0, line.cast("bigint")).otherwise(size)
    bad = F.get(items, F.col("__fault"))
    bad_code = F.substr(codes, F.col("__fault") + 1, F.lit(1))
    reason = (
        F.when(bad.isNull(), "unexpected_end").when(bad_code == "B", "bad_quoted_text")
        .when(F.col("__grouped") & (bad_code == "U"), "unexpected_end")
        .when(F.col("__grouped") & (bad_code == "M"), F.col("__wrong.reason"))
        .otherwise("unexpected_token")
    )
    place = (
        F.when(reason == "unexpected_end", size)
        .when(F.col("__grouped") & (bad_code == "M"), F.col("__wrong.at"))
        .otherwise(bad["at"])
    )
    named = F.when(F.col("__function") > 0, F.instr(codes, "s")).when(is_value, F.lit(1))
    direct = matched(DIRECT, codes)
    kind = (
        F.when(F.col("__function") > 0, "function").when(F.col("__global") > 0, "skipped")
        .when((F.col("__alias") > 0) & F.regexp_extract(codes, rf"^sN*+e{_LINKAGE}(.)", 1).eqNullSafe(F.lit("I")), "ifunc")
        .when((F.col("__alias") > 0) & (direct > 0), "direct_alias")
        .when(F.col("__alias") > 0, "expression_alias")
    )
    consumed = F.when(F.col("__function") > 0, at(F.col("__function"))["first_end"]).when(taken > 0, line_end)
    found = found.select(
        *keys,
        kind.alias("kind"),
        F.when(kind.isNotNull() & (kind != "skipped"), at(named)["symbol"]).alias("symbol"),
        F.when(kind.isNotNull(), at(named)["at"]).alias("symbol_at"),
        F.when(kind == "direct_alias", at(direct)["symbol"]).alias("target"),
        F.when(kind == "direct_alias", at(direct)["at"]).alias("target_at"),
        consumed.alias("consumed"),
        F.when(taken == 0, reason).alias("error"),
        F.when(taken == 0, place).alias("error_at"),
        # The item that decides is not the last; an alias needs the item behind it too.
        (F.when(taken > 0, taken + 1).otherwise(F.col("__fault") + 2) <= n_items).alias("settled"),
        size.alias("__size"),
    )
    too_long = (
        (F.col("consumed") > HEADER_LIMIT) & (F.col("kind") != "skipped")
    ) | ((F.col("__size") > HEADER_LIMIT) & (F.col("error_at") >= HEADER_LIMIT))
    too_long = F.coalesce(too_long, F.lit(False))
    gone = {c: F.when(~too_long, F.col(c)) for c in ("kind", "symbol", "symbol_at", "target", "target_at", "consumed")}
    return found.select(
        *keys, *[c.alias(n) for n, c in gone.items()],
        F.when(too_long, F.lit("header_too_long")).otherwise(F.col("error")).alias("error"),
        F.when(too_long, F.lit(HEADER_LIMIT)).otherwise(F.col("error_at")).cast("bigint").alias("error_at"),
        "settled", F.col("__size").alias("size"),
    )


def decode_symbol(token: Column) -> Column:
    """Symbol of an ``@`` token whose characters are single bytes; NULL when it is not valid.

    A bare name that starts with a digit is a number. Quoted names are cut into escapes and the runs
    between them, all as hexadecimal digits, and must be UTF-8.
    """
    plain = token.rlike(r"^@(?:[0-9]+|[-A-Za-z_.$][-A-Za-z0-9_.$]*)\z")
    quoted = token.rlike(rf"^@{QUOTED}\z")
    inner = F.regexp_extract(token, r'(?s)^@"(.*)"\z', 1)
    pieces = F.regexp_extract_all(inner, F.lit(r"\\\\|\\[0-9A-Fa-f]{2}|[^\\]++"), F.lit(0))
    digits = F.transform(
        pieces,
        lambda p: F.when(p == "\\\\", F.lit("5C"))
        .when(p.startswith("\\"), F.substring(p, 2, 2))
        .otherwise(F.hex(F.encode(p, "ISO-8859-1"))),
    )
    name = F.try_validate_utf8(F.unhex(F.array_join(digits, "")).cast("string"))
    return F.when(plain, F.substr(token, F.lit(2))).when(quoted & (name != ""), name)
