"""Chat formatting with role repair of least cost.

A legal conversation is an optional system turn and then user and assistant turns by turns, the last
an assistant's. The automaton's state is the last role written. Each turn is written in its own or
another role, merged into the turn before, or written behind an empty turn; dynamic programming
finds the cheapest way. Conversations of any length are cut into segments; a segment is summed up by
its cost from every state to every state, these tables compose along the conversation, and then each
segment is repaired between its known states on its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlake.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# Costs: joining a turn to the one before, an empty turn, another role for a turn whose role is
# known, and a role for a turn without one.
MERGE, INSERT, RELABEL, LABEL = 1, 2, 3, 1
FAR = 1 << 40
# Turns and characters of one segment at most; a longer text is a segment of its own.
TURNS, CHARACTERS = 4096, 1 << 20


def label_cost(role: int | None, target: int) -> int:
    return LABEL if role is None else 0 if role == target else RELABEL


def moves(role: int | None) -> list[list[tuple[int, str, int]]]:
    """Per state before and after: the cheapest cost, its action, and the role inserted. At equal
    cost a turn is rather written than merged, and merged rather than set behind an empty one."""
    table = [[(FAR, "", 0)] * 4 for _ in range(4)]

    def offer(s: int, t: int, cost: int, action: str, extra: int = 0) -> None:
        if cost < table[s][t][0]:
            table[s][t] = (cost, action, extra)

    for s in range(4):
        for t in NEXT[s]:
            offer(s, t, label_cost(role, t), "write")
        if s != START:
            offer(s, s, MERGE + label_cost(role, s), "merge")
        for x in NEXT[s]:
            for t in NEXT[x]:
                offer(s, t, INSERT + label_cost(role, t), "insert", x)
    return table


MOVES = {role: moves(role) for role in (None, SYSTEM, USER, ASSISTANT)}
STEPS = {role: np.array([[m[0] for m in row] for row in table]) for role, table in MOVES.items()}


def ending(state: int) -> tuple[int, list[int]]:
    """Cost and roles of the empty turns that end a conversation in this state."""
    added = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}[state]
    return INSERT * len(added), added


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest costs through both, from every state to every state."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def summed(roles: list[int | None]) -> np.ndarray:
    total = np.where(np.eye(4, dtype=bool), 0, FAR)
    for role in roles:
        total = compose(total, STEPS[role])
    return total


def states(tables: list[np.ndarray], first: int, last: int) -> list[int]:
    """The states around each table on a cheapest way from ``first`` to ``last``."""
    reach, ways = np.full(4, FAR), []
    reach[first] = 0
    for table in tables:
        costs = reach[:, None] + table
        ways.append(costs.argmin(axis=0))
        reach = np.minimum(costs.min(axis=0), FAR)
    out = [last]
    for way in reversed(ways):
        out.append(int(way[out[-1]]))
    return out[::-1]


def cheapest_end(table: np.ndarray) -> int:
    return int(np.argmin([table[START][t] + ending(t)[0] for t in range(4)]))


def role_of(name: str | None) -> int | None:
    return ROLES.get((name or "").strip().lower())


def repaired(turns: list[tuple[str | None, str | None]], first: int, last: int, closing: bool):
    """Rendered text, cost and counts (merged, relabelled, inserted) of one segment's turns.

    The texts of the segments of a conversation, one after the other, are its rendering: a segment
    closes the open turn before it writes a new one, and the closing segment closes the last.
    """
    roles = [role_of(r) for r, _ in turns]
    way = states([STEPS[r] for r in roles], first, last)
    out, cost, merged, relabelled, inserted = [], 0, 0, 0, 0

    def turn(before: int, role: int, text: str) -> None:
        out.append(("<|end|>\n" if before != START else "") + f"<|{NAMES[role]}|>\n{text}")

    for (_, text), role, s, t in zip(turns, roles, way, way[1:]):
        price, action, extra = MOVES[role][s][t]
        cost += price
        plain = (text or "").replace("<|", "< |")
        relabelled += role != t
        if action == "merge":
            merged += 1
            out.append("\n\n" + plain)
        elif action == "insert":
            inserted += 1
            turn(s, extra, "")
            turn(extra, t, plain)
        else:
            turn(s, t, plain)
    if closing:
        price, added = ending(last)
        cost += price
        inserted += len(added)
        state = last
        for role in added:
            turn(state, role, "")
            state = role
        if state != START:
            out.append("<|end|>\n")
    return "".join(out), cost, merged, relabelled, inserted


SEGMENT = "conv_id bigint, part bigint, seg bigint, roles array<string>, texts array<string>, costs array<bigint>"
STATE = "seg bigint, place int, first int, last int, closing boolean"


def segments(turns: DataFrame, most: int) -> DataFrame:
    """Rows of consecutive turns of one conversation; written once.

    ``part`` is a stretch of ``most`` turn numbers. Rows are dealt
    by conversation and part, so a very long conversation spreads over many tasks, and pass through
    a task in order. Where segments end depends on the turns alone, never on the partitions.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, key = 0, None
        roles: list = []
        texts: list = []
        size = 0
        done: list = []

        def close() -> None:
            nonlocal number, size
            if roles:
                table = summed([role_of(r) for r in roles]).ravel().tolist()
                done.append((*key, (task << 32) + number, list(roles), list(texts), table))
                number += 1
            roles.clear(), texts.clear()
            size = 0

        def emit() -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.list_(pa.string())] * 2 + [pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SEGMENT.split(", ")])

        for batch in batches:
            for conv, part, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                length = len(text or "")
                if roles and ((conv, part) != key or len(roles) >= most or size + length > CHARACTERS):
                    close()
                key = conv, part
                roles.append(role)
                texts.append(text)
                size += length
                if len(done) >= 512 or sum(len(t or "") for d in done[-1:] for t in d[4]) > CHARACTERS:
                    yield emit()
        close()
        if done:
            yield emit()

    # Null and negative numbers stand with those from 0.
    stretch = F.greatest(F.floor(F.coalesce("turn", F.lit(0)) / F.lit(most)), F.lit(0)).cast("bigint")
    order = [F.col("conv_id"), F.col("part"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    placed = turns.withColumn("part", stretch).repartition("conv_id", "part").sortWithinPartitions(*order)
    return cut_lineage(placed.select("conv_id", "part", "role", "text").mapInArrow(cut, SEGMENT))


def known_states(rows: DataFrame) -> DataFrame:
    """The states around each segment of the conversations that have more than one.

    Tables compose per (conversation, part) and then per conversation, so a group has the segments of
    one stretch of turns, or one row per stretch.
    """
    narrow = rows.select("conv_id", "part", "seg", "costs")
    many = narrow.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
    narrow = narrow.join(many, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    lots = narrow.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("seg", "costs"))).alias("chain"))
    square = lambda costs: np.array(costs, dtype=np.int64).reshape(4, 4)

    @F.pandas_udf("array<bigint>")
    def through(chains: pd.Series) -> pd.Series:
        out = []
        for chain in chains:
            total = square(chain[0]["costs"])
            for x in chain[1:]:
                total = compose(total, square(x["costs"]))
            out.append(total.ravel())
        return pd.Series(out)

    @F.pandas_udf("array<struct<part: bigint, place: int, first: int, last: int, closing: boolean>>")
    def whole(chains: pd.Series) -> pd.Series:
        out = []
        for chain in chains:
            tables = [square(x["costs"]) for x in chain]
            total = tables[0]
            for t in tables[1:]:
                total = compose(total, t)
            way = states(tables, START, cheapest_end(total))
            counts, place, rows_ = [x["n"] for x in chain], 0, []
            for i, x in enumerate(chain):
                rows_.append({"part": x["part"], "place": place, "first": way[i], "last": way[i + 1],
                              "closing": i == len(chain) - 1})
                place += counts[i]
            out.append(rows_)
        return pd.Series(out)

    @F.pandas_udf("array<struct<seg: bigint, place: int, first: int, last: int, closing: boolean>>")
    def inside(chains: pd.Series, first: pd.Series, last: pd.Series, place: pd.Series, closing: pd.Series) -> pd.Series:
        out = []
        for chain, a, b, at, end in zip(chains, first, last, place, closing):
            way = states([square(x["costs"]) for x in chain], int(a), int(b))
            out.append([
                {"seg": x["seg"], "place": int(at) + i, "first": way[i], "last": way[i + 1],
                 "closing": bool(end) and i == len(chain) - 1} for i, x in enumerate(chain)])
        return pd.Series(out)

    lots = cut_lineage(lots.withColumn("costs", through("chain")))
    tops = (
        lots.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("part", "costs", F.size("chain").alias("n")))).alias("chain"))
        .select(F.col("conv_id").alias("c"), F.explode(whole("chain")).alias("w")).select("c", "w.*")
        .withColumnRenamed("part", "p")
    )
    match = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    found = lots.join(tops, match).select(F.explode(inside("chain", "first", "last", "place", "closing")).alias("s"))
    return found.select("s.*")


def formatted(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", most: int = TURNS,
) -> DataFrame:
    """``conv_id, part, n_turns, cost, n_merged, n_relabelled, n_inserted, text``.

    One row per segment. A segment ends where the turn numbers pass a multiple of ``most``, and after
    ``most`` turns or ``CHARACTERS`` characters (a longer text is alone): a conversation of fewer,
    shorter turns is one row, on any cluster. Texts in the order of ``part`` joined are the
    rendering, and costs and counts add up. Turns are ordered
    by number (null first), then role and a hash of the text; repeated rows are turns of their own. Roles are
    compared without case and outer blanks; a null or unknown one is free to be any. A null text is
    empty. Rows without a conversation are one conversation. ``<|`` in a text is written ``< |``.
    Other columns are not read; an empty table gives no rows.
    """
    rows = segments(turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")), most)
    # Written first: where few conversations have several segments, texts need not move to meet it.
    known = cut_lineage(known_states(rows).withColumnRenamed("seg", "s"))
    schema = ("conv_id bigint, part int, n_turns bigint, cost bigint, n_merged bigint, n_relabelled bigint, "
              "n_inserted bigint, text string")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5 + [pa.string()]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["first"] is None:
                    last = cheapest_end(np.array(r["costs"]).reshape(4, 4))
                    place, first, closing = 0, START, True
                else:
                    place, first, last, closing = r["place"], r["first"], r["last"], r["closing"]
                text, *numbers = repaired(list(zip(r["roles"], r["texts"])), first, last, closing)
                out.append((r["conv_id"], place, len(r["roles"]), *numbers, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.join(known, F.col("seg") == F.col("s"), "left").mapInArrow(repair, schema)
