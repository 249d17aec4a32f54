"""The prefix trie of conversations, by ROLLUP over columns that hold turn ids by position.

A conversation is cut into blocks of ``WIDTH`` turns, one row per block with a column per position.
``ROLLUP`` over these columns aggregates every prefix of a block at once, each level with partial
sums before its shuffle, and ``grouping_id`` tells the level. A block after the first continues from
the node its conversation has reached, and is grouped by that node's key too, so conversations of
any length take two rollups in all. A node's key is the sum, over its turns, of a 128-bit hash of
position and turn id: sums run over positions, so no conversation is gathered in one task.
"""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlake.operators.scale import ordinals, running_totals
from evlake.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 4
# Conversation ids in one piece of a node's list.
PIECE = 4096
# The parts of a key, 32 bits of each turn's hash; a sum of 2^31 of them fits in 64 bits.
PARTS = ["f1", "f2", "f3", "f4"]
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def turn_rows(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``conv_id, pos, tid``: the place of every turn in its conversation, from 0, and its id.

    Turns are ordered by number, a null number first; equal numbers by turn id. A turn id is the
    length of the text in UTF-8 and half a SHA-256 of role and text, null ones empty. Rows without
    a conversation id belong to no conversation. Equal rows are turns of their own.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    tid = F.concat(F.octet_length(text).cast("string"), F.lit(":"), F.substring(digest, 1, 32))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        tid.alias("tid"),
    )
    # The range sort reads its rows twice: once written, they are narrow.
    placed = ordinals(
        cut_lineage(rows), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("tid")], "pos"
    )
    return placed.select("conv_id", "pos", "tid")


def rebuilt(turns: DataFrame, step: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c with its first turns from conversation c - c % ``step``.

    With h = crc32(c in decimal) % ``most``: the first h turns of that conversation (all if fewer,
    none if it is absent), then c's own turns after its first h. ``turns`` has ``conv_id, pos,
    tid``, and so has the result, with a row whose ``pos`` and ``tid`` are null for each
    conversation, so that one without turns still counts.
    """
    turns = cut_lineage(turns)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(most)
    convs = sizes.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % F.lit(step)).alias("base"),
        head.alias("h"),
    )
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = cut_lineage(
        convs.join(bases, "base", "left").withColumn(
            "taken", F.least("h", F.coalesce("base_n", F.lit(0)))
        ).drop("base_n")
    )
    # At most `step` conversations take a turn, and only one of the first `most` - 1.
    heads = turns.filter(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").filter(F.col("pos") < F.col("h")).select("conv_id", "pos", "tid")
    own = turns.join(convs, "conv_id").filter(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid"
    )
    present = convs.select("conv_id", F.lit(None).cast("bigint").alias("pos"),
                           F.lit(None).cast("string").alias("tid"))
    return taken.unionByName(own).unionByName(present)


def text_bytes(tid: Column) -> Column:
    """The text's length, which a turn id starts with; 0 where there is no turn."""
    return F.coalesce(F.substring_index(tid, ":", 1).cast("bigint"), F.lit(0))


def hash_part(pos: Column, tid: Column, part: int) -> Column:
    mixed = F.md5(F.concat(pos.cast("string"), F.lit("/"), tid).cast("binary"))
    piece = F.conv(F.substring(mixed, 1 + 8 * part, 8), 16, 10).cast("bigint")
    return F.coalesce(piece, F.lit(0))


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: ``conv_id, block, t1.., f1.., base, len``.

    ``f1..`` are the key of the node before the block, ``base`` the bytes of text on the way to it.
    """
    pos = F.coalesce("pos", F.lit(0))
    rows = turns.withColumn("block", F.floor(pos / F.lit(WIDTH)).cast("bigint"))
    parts = {f: F.sum(hash_part(F.col("pos"), F.col("tid"), i)) for i, f in enumerate(PARTS)}
    rows = rows.groupBy("conv_id", "block").agg(
        *[
            F.max(F.when(F.col("pos") % F.lit(WIDTH) == i, F.col("tid"))).alias(t)
            for i, t in enumerate(TURNS)
        ],
        *[c.alias(f"own_{f}") for f, c in parts.items()],
        F.sum(text_bytes(F.col("tid"))).alias("own_bytes"),
        F.count("tid").alias("own_len"),
    )
    rows = cut_lineage(rows)
    sums = {f: F.col(f"own_{f}") for f in PARTS} | {"base": F.col("own_bytes")}
    return cut_lineage(running_totals(rows, ["conv_id"], "block", sums))


def rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """``depth``, key parts, ``before`` (bytes of text above the node), ``level`` and aggregates."""
    keys = ["block", *PARTS, "base"]
    grouped = rows.sparkSession.sql(
        f"SELECT {', '.join(keys + TURNS)}, {WIDTH} - bit_count(grouping_id()) AS level, {aggregates} "
        f"FROM {{rows}} GROUP BY {', '.join(keys)}, ROLLUP({', '.join(TURNS)})",
        rows=rows,
    )
    # A group whose last column is null holds conversations that end before; a later block's
    # empty level is the node that the block before has made.
    last = F.element_at(F.array(F.lit("root"), *TURNS), F.col("level") + F.lit(1))
    grouped = grouped.filter(last.isNotNull() & ((F.col("level") > 0) | (F.col("block") == 0)))
    start = F.col("block") * F.lit(WIDTH)
    hashes = {
        f: sum((hash_part(start + F.lit(j), F.col(t), i) for j, t in enumerate(TURNS)), F.lit(0))
        for i, f in enumerate(PARTS)
    }
    own = text_bytes(F.when(F.col("level") > 0, last))
    above = sum((text_bytes(F.col(t)) for t in TURNS), F.lit(0)) - own
    depth = start + F.col("level")
    last_pos = F.greatest(depth - F.lit(1), F.lit(0))
    last_turn = F.when(F.col("level") > 0, last)
    parents = [F.col(f) + h - hash_part(last_pos, last_turn, i) for i, (f, h) in enumerate(hashes.items())]
    dropped = {*keys, *TURNS, "level"}
    return grouped.select(
        depth.alias("depth"),
        key(depth, [F.col(f) + h for f, h in hashes.items()]).alias("k"),
        F.when(depth > 0, key(depth - F.lit(1), parents)).alias("parent"),
        (F.col("base") + above).alias("before"),
        F.col("level"),
        *[c for c in grouped.columns if c not in dropped],
    )


def key(depth: Column, parts: list[Column]) -> Column:
    return F.concat_ws("-", depth, *parts)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of a conversation: the nodes of the trie, the root included.

    ``turns`` has ``conv_id, pos, tid`` as `turn_rows` and `rebuilt` give them. The result:
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``
    (members), ``n_children``, ``n_leaves`` (childless nodes at or below), ``saved_tokens`` (at or
    below: members but one, times the bytes of the last text), ``ends_sha256`` (of the ids of the
    members that end here, ascending). Conversations without a turn are members of the root; without
    any conversation there are no nodes.
    """
    blocks = blocks_of(turns)
    convs = blocks.groupBy("conv_id").agg(
        F.sum("own_len").alias("len"), F.sum("own_bytes").alias("bytes"),
        *[F.sum(f"own_{f}").alias(f) for f in PARTS],
    )
    convs = cut_lineage(
        convs.select("conv_id", "len", "bytes", key(F.col("len"), [F.col(f) for f in PARTS]).alias("k"))
    )
    rows = blocks.join(convs.select("conv_id", "len"), "conv_id")
    nodes = cut_lineage(
        rollup(rows, "min(conv_id) AS conv_id, count(*) AS n_convs, max(len) AS longest")
    )
    # A conversation that is the smallest of a node is so all the way down: above its topmost node
    # all its texts are saved ones, below none. And it stands for a leaf if none goes on from its end.
    tops = nodes.groupBy("conv_id").agg(
        F.min_by("before", "depth").alias("saved"),
        F.max(F.when(F.col("longest") == F.col("depth"), 1).otherwise(0)).alias("leaf"),
    )
    shares = convs.join(tops, "conv_id", "left").select(
        "conv_id", F.coalesce("saved", "bytes").alias("saved"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    above = [F.lit(0), *itertools.accumulate([F.col("base"), *[text_bytes(F.col(t)) for t in TURNS[:-1]]])]
    shared = blocks.join(shares, "conv_id").withColumns(
        {f"s{i}": F.greatest(F.col("saved") - a, F.lit(0)) for i, a in enumerate(above)}
    )
    levels = range(WIDTH + 1)
    sums = rollup(shared, ", ".join(["sum(leaf) AS n_leaves", *[f"sum(s{i}) AS s{i}" for i in levels]]))
    sums = sums.select(
        "k", "n_leaves",
        F.element_at(F.array(*[f"s{i}" for i in levels]), F.col("level") + F.lit(1)).alias("saved_tokens"),
    )
    children = nodes.filter(F.col("depth") > 0).groupBy(F.col("parent").alias("k")).agg(
        F.count("*").alias("n_children")
    )
    # By key both sides are unique, but for parents: those of the root's children are dealt anew
    # by adaptive execution where they are many.
    parents = nodes.select(F.col("k").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(sums, "k").join(children, "k", "left").join(ends(convs), "k", "left")
        .join(parents, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", empty).alias("ends_sha256"),
        )
    )


def ends(convs: DataFrame) -> DataFrame:
    """``k, ends_sha256``: a digest of the ascending ids of the conversations that end at a node.

    Ids are sorted by range, so a node with very many spreads over tasks, which join them to pieces;
    a digest, being sequential, then passes over the pieces only, and holds one batch of them.
    """
    ids = convs.select("k", "conv_id").repartitionByRange("k", "conv_id")
    pieces = ids.sortWithinPartitions("k", "conv_id").mapInArrow(
        joined_ids, "k string, first bigint, ids string"
    )
    pieces = cut_lineage(pieces).repartition("k").sortWithinPartitions("k", "first")
    return pieces.mapInArrow(digests, "k string, ends_sha256 string")


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held = None, []
    for batch in batches:
        out: list[tuple] = []
        for k, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if held and (k != at or len(held) == PIECE):
                out.append((at, held[0], ",".join(map(str, held))))
                held = []
            at = k
            held.append(conv)
        yield pieces_batch(out)
    if held:
        yield pieces_batch([(at, held[0], ",".join(map(str, held)))])


def pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = [pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "first", "ids"]
    )


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, state = None, None
    for batch in batches:
        keys, found = [], []
        for k, text in zip(batch.column("k").to_pylist(), batch.column("ids").to_pylist()):
            if state is not None and k == at:
                state.update(b",")
            else:
                if state is not None:
                    keys.append(at)
                    found.append(state.hexdigest())
                at, state = k, hashlib.sha256()
            state.update(text.encode())
        yield digest_batch(keys, found)
    if state is not None:
        yield digest_batch([at], [state.hexdigest()])


def digest_batch(keys: list[str], found: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["k", "ends_sha256"]
    )
