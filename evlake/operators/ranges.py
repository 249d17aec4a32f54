"""Byte-exact ranges over chunked artifacts, line numbers, and spans of passages in texts."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evlake.operators.scale import BLOCK, running_totals
from evlake.operators.search import containing_pairs

# Ship the one Python helper with its tasks, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 20
# A result cell is one JVM array; longer ranges are delivered by `range_pieces` only.
MAX_CELL = (1 << 31) - 64
NEWLINE = "\n"
# Bytes around the ends of a span that are looked at together.
SPAN_CHUNK = 1 << 12


def _div(a: Column, n: int) -> Column:
    """Integer division that stays exact over the whole 64-bit range."""
    return F.call_function("div", a, F.lit(n).cast("bigint"))


def chunk_bytes(
    df: DataFrame, keys: Sequence[str], content: Column, chunk: int = CHUNK_BYTES
) -> DataFrame:
    """Cut a binary value per row into ``(keys, chunk_no, bytes)``. Empty content has no chunks."""
    # A column of its own: as an expression it would be computed anew for every chunk.
    df, content = df.select(*keys, content.alias("__content")), F.col("__content")
    last = _div(F.octet_length(content).cast("bigint") - 1, chunk).cast("int")
    pieces = F.when(
        F.octet_length(content) > 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                i.cast("bigint").alias("chunk_no"),
                F.substring(content, i * F.lit(chunk) + F.lit(1), F.lit(chunk)).alias("bytes"),
            ),
        ),
    )
    return df.select(*keys, F.explode(pieces).alias("__c")).select(*keys, "__c.*")


def range_pieces(
    ranges: DataFrame,
    range_id: str,
    chunks: DataFrame,
    keys: Sequence[str],
    chunk: int = CHUNK_BYTES,
    start: str = "start",
    length: str = "length",
) -> DataFrame:
    """The parts of each range, one row per chunk it touches, with the chunk's own bytes cut.

    An equi-join on (keys, chunk number): no range comparison between the sides.
    """
    first = _div(F.col(start), chunk)
    last = _div(F.col(start) + F.col(length) - 1, chunk)
    wanted = ranges.filter(F.col(length) > 0).select(
        range_id, *keys, start, length, F.explode(F.sequence(first, last)).alias("chunk_no")
    )
    chunk_start = F.col("chunk_no") * F.lit(chunk)
    begin = F.greatest(F.col(start) - chunk_start, F.lit(0))
    end = F.least(F.col(start) + F.col(length) - chunk_start, F.lit(chunk))
    return wanted.join(chunks, [*keys, "chunk_no"]).select(
        range_id,
        *keys,
        "chunk_no",
        F.substring("bytes", (begin + 1).cast("int"), (end - begin).cast("int")).alias("bytes"),
    )


def read_ranges(
    ranges: DataFrame,
    range_id: str,
    artifacts: DataFrame,
    chunks: DataFrame,
    keys: Sequence[str],
    chunk: int = CHUNK_BYTES,
    start: str = "start",
    length: str = "length",
    byte_len: str = "byte_len",
) -> DataFrame:
    """``status`` and ``content`` of each range.

    Status is ``ok``, ``unknown_artifact``, ``past_end`` or ``too_long_for_a_cell`` (read those with
    `range_pieces`). An empty range has empty content.
    """
    known = ranges.join(artifacts.select(*keys, F.col(byte_len).alias("__len")), list(keys), "left")
    status = (
        F.when(F.col("__len").isNull(), F.lit("unknown_artifact"))
        # Compared without adding, so a start near the top of the range cannot overflow.
        .when(
            (F.col(start) > F.col("__len")) | (F.col(length) > F.col("__len") - F.col(start)),
            F.lit("past_end"),
        )
        .when(F.col(length) > MAX_CELL, F.lit("too_long_for_a_cell"))
        .otherwise(F.lit("ok"))
    )
    checked = known.withColumn("status", status)
    readable = checked.filter((F.col("status") == "ok") & (F.col(length) > 0))
    joined = (
        range_pieces(readable, range_id, chunks, keys, chunk, start, length)
        .groupBy(range_id)
        .agg(F.expr("listagg(bytes) within group (order by chunk_no)").alias("__content"))
    )
    empty = F.when((F.col("status") == "ok") & (F.col(length) == 0), F.lit("").cast("binary"))
    return checked.join(joined, range_id, "left").select(
        *ranges.columns, "status", F.coalesce("__content", empty).alias("content")
    )


def _newlines(data: Column) -> Column:
    text = F.decode(data, "ISO-8859-1")
    return F.length(text) - F.length(F.replace(text, F.lit(NEWLINE), F.lit("")))


def starting_lines(
    offsets: DataFrame,
    chunks: DataFrame,
    keys: Sequence[str],
    chunk: int = CHUNK_BYTES,
    start: str = "start",
) -> DataFrame:
    """One-based line of a byte offset: newlines before it, plus one.

    The sums run over one number per chunk; bytes meet only the offsets that fall into them.
    """
    counted = running_totals(
        chunks.select(*keys, "chunk_no", _newlines(F.col("bytes")).alias("__lines")),
        list(keys),
        "chunk_no",
        {"__before": F.col("__lines")},
    )
    # An offset at the very end of the last chunk belongs to that chunk.
    at = F.greatest(F.when(F.col(start) > 0, _div(F.col(start) - 1, chunk)), F.lit(0))
    placed = offsets.withColumn("chunk_no", F.coalesce(at, F.lit(0).cast("bigint")))
    inside = (F.col(start) - F.col("chunk_no") * chunk).cast("int")
    on = [*keys, "chunk_no"]
    heads = placed.join(chunks.select(*on, "bytes"), on, "left").select(
        *placed.columns, _newlines(F.substring("bytes", F.lit(1), inside)).alias("__head")
    )
    line = F.coalesce(F.col("__before") + F.col("__head"), F.lit(0)) + 1
    return heads.join(counted.select(*on, "__before"), on, "left").select(
        *offsets.columns, line.cast("bigint").alias("starting_line")
    )


def text_lines(df: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """Lines of a text held in one row: ``line_no`` from 1, ``byte_start``, ``byte_len``.

    The window group is one row's text. Only lengths are shuffled, never the text.
    """
    lengths = F.transform(
        F.split(text, NEWLINE, -1), lambda line: F.octet_length(line).cast("bigint")
    )
    lines = df.select(*keys, F.posexplode(lengths).alias("__pos", "byte_len"))
    before = W.partitionBy(*keys).orderBy("__pos").rowsBetween(W.unboundedPreceding, -1)
    return lines.select(
        *keys,
        (F.col("__pos") + 1).cast("bigint").alias("line_no"),
        # Every earlier line also has its newline.
        F.coalesce(F.sum(F.col("byte_len") + 1).over(before), F.lit(0)).alias("byte_start"),
        "byte_len",
    )


def artifact_lines(chunks: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Lines of chunked artifacts in pieces that lie each in one chunk: ``line_no`` from 0,
    ``byte_start``, ``line`` (the piece, the last one with its newline) and ``cut``.

    A line within a chunk is one piece. Pieces of a longer line are ordered by ``byte_start``;
    ``cut`` marks the first and the last piece of a chunk, which alone can belong to such a line.
    Nothing is put together, so a line can be longer than a cell. Text moves once, with its chunk:
    the sums inside a chunk keep the partitioning of the join before them.
    """
    data, size = F.col("bytes"), F.octet_length("bytes").cast("bigint")
    sized = chunks.select(
        *keys, "chunk_no", size.alias("__size"), _newlines(data).cast("bigint").alias("__lines")
    )
    based = running_totals(
        sized,
        list(keys),
        "chunk_no",
        {"__byte": F.col("__size"), "__line": F.col("__lines")},
        block,
    ).select(*keys, "chunk_no", "__byte", "__line")
    # A character per byte, so lengths are bytes; the split keeps every newline with its line.
    texts = F.filter(F.split(F.decode(data, "ISO-8859-1"), "(?<=\n)", -1), lambda t: t != "")
    parts = (
        chunks.filter(size > 0)
        .join(based, [*keys, "chunk_no"])
        .select(*keys, "chunk_no", "__byte", "__line", F.size(texts).alias("__n"), F.posexplode(texts).alias("__i", "__text"))
    )
    # Lengths run up within a chunk, whose rows are bounded.
    earlier = W.partitionBy(*keys, "chunk_no").orderBy("__i").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("__text")).over(earlier), F.lit(0))
    closed = F.substring("__text", -1, 1) == NEWLINE
    return parts.select(
        *keys,
        (F.col("__line") + F.col("__i")).alias("line_no"),
        (F.col("__byte") + before).cast("bigint").alias("byte_start"),
        F.encode("__text", "ISO-8859-1").alias("line"),
        (
            ((F.col("__i") == 0) & (F.col("chunk_no") > 0)) | ((F.col("__i") == F.col("__n") - 1) & ~closed)
        ).alias("cut"),
    )


_SPOTS = "array<struct<byte_start: bigint, starting_line: bigint, excerpt: string>>"


def occurrences(text: Column, part: Column, context: int) -> Column:
    """Every place of a text where the part occurs, overlapping ones too, in one forward pass."""

    def find(texts: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for body, wanted in zip(texts, parts):
            spots, at, byte, line = [], 0, 0, 1
            found = body.find(wanted)
            while found >= 0:
                skipped = body[at:found]
                byte, line, at = byte + len(skipped.encode()), line + skipped.count(NEWLINE), found
                excerpt = body[max(0, found - context) : found + len(wanted) + context]
                spots.append({"byte_start": byte, "starting_line": line, "excerpt": excerpt})
                found = body.find(wanted, found + 1)
            out.append(spots)
        return pd.Series(out)

    return F.pandas_udf(find, _SPOTS)(text, part)


def passage_spans(
    texts: DataFrame,
    text_id: str,
    text: str,
    passages: DataFrame,
    passage_id: str,
    passage: str,
    context: int = 20,
) -> DataFrame:
    """Every occurrence of each passage in each text: byte start, length, line, and an excerpt with
    ``context`` characters on either side."""
    part = F.col("__pattern")
    carry = {
        "byte_length": F.octet_length(part).cast("bigint"),
        "__spots": occurrences(F.col(text), part, context),
    }
    pairs = containing_pairs(texts, text_id, [text], passages, passage_id, passage, carry=carry)
    return pairs.select(text_id, passage_id, "byte_length", F.explode("__spots").alias("__s")).select(
        text_id, passage_id, "__s.byte_start", "byte_length", "__s.starting_line", "__s.excerpt"
    )


# Checked in this order; the first that holds is the reason.
SPAN_REASONS = ("nonlocal", "generated", "unsupported_span", "unloaded", "outside_package")


def source_spans(
    requests: DataFrame,
    texts: DataFrame,
    text_id: str,
    text: str,
    is_local: Column,
    is_generated: Column,
    inside_root: Column,
    start: str = "start",
    end: str = "end",
    chunk: int = SPAN_CHUNK,
) -> DataFrame:
    """Whole-definition span of each request in its text, or the reason there is none.

    ``requests`` hold ``text_id`` and a byte span. A request meets the size of its text and the two
    pieces of ``chunk`` bytes that its ends fall into, never the whole text.
    """
    pieces = chunk_bytes(texts, [text_id], F.col(text).cast("binary"), chunk)
    held = texts.select(text_id, F.octet_length(text).cast("bigint").alias("__size"))
    s, e = F.col(start), F.col(end)

    def with_byte(rows: DataFrame, offset: Column, name: str) -> DataFrame:
        # The byte at the offset, as hexadecimal digits; none behind the end of the text.
        number = F.when(offset >= 0, _div(offset, chunk))
        inside = (offset - F.col("__piece") * chunk + 1).cast("int")
        side = pieces.select(F.col(text_id).alias("__id"), F.col("chunk_no").alias("__piece"), "bytes")
        return (
            rows.withColumn("__wanted", number)
            .join(side, (F.col(text_id) == F.col("__id")) & (F.col("__wanted") == F.col("__piece")), "left")
            .select(*rows.columns, F.hex(F.substring("bytes", inside, F.lit(1))).alias(name))
        )

    def on_boundary(name: str) -> Column:
        # A UTF-8 continuation byte (10xxxxxx) cannot start a span or follow its end.
        return ~F.coalesce(F.col(name).rlike("^[89AB]"), F.lit(False))

    loaded = F.col("__size").isNotNull()
    sound = (s >= 0) & (s <= e) & (
        ~loaded | ((e <= F.col("__size")) & on_boundary("__first") & on_boundary("__last"))
    )
    reason = (
        F.when(~is_local, F.lit("nonlocal"))
        .when(is_generated, F.lit("generated"))
        .when(~F.coalesce((s >= 0) & (s <= e), F.lit(False)), F.lit("unsupported_span"))
        .when(~loaded, F.lit("unloaded"))
        .when(~inside_root, F.lit("outside_package"))
        .when(~F.coalesce(sound, F.lit(False)), F.lit("unsupported_span"))
    )
    rows = with_byte(with_byte(requests.join(held, text_id, "left"), s, "__first"), e, "__last")
    rows = rows.withColumn("reason", reason)
    available = F.col("reason").isNull()
    asked = rows.select(
        *requests.columns,
        "reason",
        F.when(available, s).alias("byte_start"),
        F.when(available, e - s).alias("byte_length"),
    )
    lined = starting_lines(asked, pieces, [text_id], chunk, "byte_start")
    return lined.withColumn("starting_line", F.when(F.col("reason").isNull(), F.col("starting_line")))
