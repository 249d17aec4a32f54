"""Near duplicates by SimHash, compared in bit slices.

Fingerprints of one word within ``radius`` bits agree on all but ``radius`` of the blocks that the
64 bits are cut into, so each pair meets in a table keyed by some choice of the remaining blocks. A
similarity of 0.8 is some 15 % of the bits, too many for that: there, sketches of minima of hashes
meet in tables keyed by a few minima each. Rows that meet are compared vertically: one bit plane
holds one bit of 64 fingerprints per word, differing planes are added to carry-save counters, and
words whose lanes are all beyond the radius are abandoned. What the sketches propose is confirmed on the sets of shingles themselves. A bucket larger than a tile is cut into tiles, and each pair of tiles is a group of its
own, so no bucket gathers in one task. Groups return a forest of their links, not the links.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlake.llm.common import fresh, tidied
from evlake.llm.components import components, forest
from evlake.llm.suffix import stored
from evlake.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SEED = 42
# Rows of a tile, rows compared at once, and links held before they are reduced to a forest (which
# has fewer links than rows).
TILE = 2048
ROWS = 1 << 16
PAIRS = 1 << 18
SHINGLES = 1 << 15
# Groups above this size are compared as lists, shingles are hashed in blocks.
DENSE = 64
# For a similarity of 0.8 of the sets of shingles. Of the minima 0.8 agree, and of the bits that stand
# for them 0.9: some 26 of 256 differ, with a standard deviation of 4.8, so one pair in a million is
# beyond the radius; one in 300,000 meets in no table. A lone pair is missed once in 200,000.
MINIMA, WORDS = 256, 4
BANDS, BAND = 32, 5
RADIUS = 50
# Similarity in hundredths, and shingles of a tile in which proposed pairs are confirmed.
SIMILARITY = 80
WEIGHT = 1 << 20
MASKS, FACTORS = np.random.default_rng(3).integers(0, 1 << 32, (2, MINIMA), dtype=np.uint32)
FACTORS |= np.uint32(1)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``size`` words, in blocks; a shorter text is one shingle."""
    import xxhash

    joined = b" ".join((text or "").encode("utf-8", "replace").translate(LOWER).split())
    if not joined:
        return
    digest = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    count = max(1, len(starts) - size + 1)
    ends = ends[min(size, len(ends)) - 1 :]
    for at in range(0, count, SHINGLES):
        stop = min(count, at + SHINGLES)
        pairs = zip(starts[at:stop].tolist(), ends[at:stop].tolist())
        yield np.array([digest(joined[s:e], SEED) for s, e in pairs], dtype="<u8")


def fingerprint(text: str | None, size: int) -> int:
    """Majority of the bits of the hashes of all shingles, as a signed 64-bit integer."""
    votes, count = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, size):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, size: int = 4) -> Column:
    """The SimHash of a whole text as a signed 64-bit integer; zero without a word, null too."""

    @F.pandas_udf("bigint")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(
            pd.Series([fingerprint(t, size) for t in texts], dtype="int64") for texts in batches
        )

    return udf(text.cast("string"))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of the different shingles; empty without a word."""
    blocks = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, "<u8")


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each of ``MINIMA`` one-to-one functions of 32 bits. Two
    sets agree on one with a probability equal to their similarity."""
    narrow = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)[:, None]
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    held = np.empty((min(512, len(narrow)), MINIMA), np.uint32)
    for at in range(0, len(narrow), 512):
        part = narrow[at : at + 512]
        values = np.bitwise_xor(part, MASKS, out=held[: len(part)])
        np.multiply(values, FACTORS, out=values)
        np.minimum(least, values.min(axis=0), out=least)
    return least


def sketch(text: str | None, size: int) -> np.ndarray:
    """Signed words: two that tell the set of shingles, its size, ``WORDS`` with one bit per minimum,
    and ``BANDS`` keys made of ``BAND`` minima each."""
    import xxhash

    own = shingle_set(text, size)
    least = minima(own)
    bits = np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31), bitorder="little").view("<i8")
    bands = [
        xxhash.xxh64_intdigest(least[b * BAND : (b + 1) * BAND].tobytes(), b) for b in range(BANDS)
    ]
    name = np.frombuffer(xxhash.xxh128_digest(own.tobytes()), "<i8")
    return np.concatenate([name, [len(own)], bits, np.array(bands, "<u8").view("<i8")])


def sketches(text: Column, size: int) -> Column:
    """The sketch of a whole text, as an array."""

    @F.pandas_udf("array<bigint>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(pd.Series([sketch(t, size) for t in texts], dtype=object) for texts in batches)

    return udf(text.cast("string"))


def shingle_sets(text: Column, size: int) -> Column:
    """The hashes of the different shingles of a whole text, as an array."""

    @F.pandas_udf("array<bigint>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(
            pd.Series([shingle_set(t, size).view("<i8") for t in texts], dtype=object) for texts in batches
        )

    return udf(text.cast("string"))


def similar_links(sizes: np.ndarray, hashes: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``i, j`` with the same components as all pairs of sets with a similarity of
    ``SIMILARITY`` or more; in a pair of tiles, of pairs across. The sets lie one after another.

    A row that is reached is compared with those not reached yet, so a group of copies takes few
    comparisons.
    """
    ids = np.unique(hashes, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marked = np.zeros(len(ids), bool)
    left = np.arange(len(sizes))
    rest, owner = ids, np.repeat(left, sizes)
    found_i, found_j = [], []
    while len(left):
        waiting = [left[0]]
        left, keep = left[1:], owner != left[0]
        rest, owner = rest[keep], owner[keep]
        while waiting and len(left):
            i = waiting.pop()
            own = ids[starts[i] : ends[i]]
            marked[own] = True
            common = np.bincount(owner[marked[rest]], minlength=len(sizes))[left]
            marked[own] = False
            near = (100 + SIMILARITY) * common >= SIMILARITY * (sizes[i] + sizes[left])
            near &= (side[left] != side[i]) | (side[i] == 0)
            if not near.any():
                continue
            reached, left = left[near], left[~near]
            found_i.append(np.full(len(reached), i))
            found_j.append(reached)
            waiting += reached.tolist()
            gone = np.zeros(len(sizes), bool)
            gone[reached] = True
            keep = ~gone[owner]
            rest, owner = rest[keep], owner[keep]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is more than the radius."""
    greater, equal = np.zeros_like(over), ~np.zeros_like(over)
    for level in reversed(range(len(counters))):
        c = counters[level]
        if radius >> level & 1:
            equal = equal & c
        else:
            greater |= equal & c
            equal = equal & ~c
    return greater | over


def within(
    plane: Callable[[int, np.ndarray], np.ndarray], valid: np.ndarray, radius: int, bits: int = BITS
) -> tuple[np.ndarray, np.ndarray]:
    """Words with lanes that differ in at most ``radius`` bits, and those lanes.

    ``plane(bit, words)`` gives the differing lanes of the words asked for.
    """
    words = np.flatnonzero(valid)
    alive = valid[words]
    counters = [np.zeros(len(words), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(words), np.uint64)
    for bit in range(bits):
        carry = plane(bit, words)
        for c in counters:
            carry, c[:] = c & carry, c ^ carry
        over |= carry
        if bit % 8 == 7:
            alive = alive & ~above(counters, over, radius)
            keep = np.flatnonzero(alive)
            if not len(keep):
                return words[:0], alive[:0]
            if 2 * len(keep) < len(words) or bit == bits - 1:
                words, alive, over = words[keep], alive[keep], over[keep]
                counters = [c[keep] for c in counters]
    return words, alive


def planes_of(values: np.ndarray) -> np.ndarray:
    """A plane per bit of the rows of ``values``, which have a column per word; word w of a plane
    holds the bit of rows 64 w to 64 w + 63."""
    words = -(-len(values) // 64)
    padded = np.zeros((words * 64, values.shape[1]), dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def lanes(bits: np.ndarray) -> np.ndarray:
    """A boolean per lane as words."""
    words = -(-len(bits) // 64)
    padded = np.zeros(words * 64, dtype=np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


def lane_numbers(words: np.ndarray, alive: np.ndarray) -> np.ndarray:
    at = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(at)
    return words[row] * 64 + lane


def sparse_links(nodes: np.ndarray, values: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows of one group, for many small groups at once: each row against the row
    ``step`` places on, for growing steps, until no group is that long."""
    planes = planes_of(values)
    planes = np.concatenate([planes, np.zeros((len(planes), 1), np.uint64)], axis=1)
    for step in range(1, len(values)):
        same = group[:-step] == group[step:]
        if not same.any():
            break
        skip, shift = divmod(step, 64)

        def plane(bit, words):
            p = planes[bit]
            moved = p[words + skip] >> np.uint64(shift)
            if shift:
                moved = moved | (p[np.minimum(words + skip + 1, len(p) - 1)] << np.uint64(64 - shift))
            return p[words] ^ moved

        i = lane_numbers(*within(plane, lanes(same), radius, len(planes)))
        yield nodes[i], nodes[i + step]


def dense_links(a_nodes: np.ndarray, a: np.ndarray, b_nodes: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A forest of the links between two lists: all of ``a`` against the bit planes of ``b``.

    The lanes linked to one value of ``a`` are one integer; sets that share a lane are merged.
    """
    planes, width = planes_of(b), -(-len(b) // 64)
    exists = lanes(np.ones(len(b), bool))
    groups: list[tuple[int, list[int]]] = []
    for first in range(0, len(a), 512):
        part = a[first : first + 512]
        asked = planes_mask(part)

        def plane(bit, words):
            return planes[bit][words % width] ^ asked[bit][words // width]

        words, alive = within(plane, np.tile(exists, len(part)), radius, len(planes))
        rows = words // width
        borders = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(rows)]
        for start, end in zip(borders, borders[1:] if len(rows) else []):
            whole = np.zeros(width, np.uint64)
            whole[words[start:end] % width] = alive[start:end]
            linked = int.from_bytes(whole.tobytes(), "little")
            if a is b and linked.bit_count() == 1:
                continue
            joined, members, apart = linked, [first + int(rows[start])], []
            for lanes_, rows_ in groups:
                if lanes_ & linked:
                    joined |= lanes_
                    members += rows_
                else:
                    apart.append((lanes_, rows_))
            groups = [*apart, (joined, members)]
    for joined, members in groups:
        raw = np.frombuffer(joined.to_bytes(width * 8, "little"), np.uint8)
        found = np.concatenate([a_nodes[members], b_nodes[np.flatnonzero(np.unpackbits(raw, bitorder="little"))]])
        yield found, np.full(len(found), found.min())


def planes_mask(values: np.ndarray) -> np.ndarray:
    """Per bit and row: all ones where the bit is set."""
    bits = np.arange(BITS, dtype=np.uint64)[None, :, None]
    ones = (values.T[:, None, :] >> bits & np.uint64(1)) * np.uint64(0xFFFFFFFFFFFFFFFF)
    return ones.reshape(-1, len(values))


def group_links(nodes: np.ndarray, values: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int):
    """Forests of the links of complete groups. ``side`` is 0, or 1 and 2 in a pair of tiles."""
    edges = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(group)]])
    large = (ends - starts > DENSE) | (side[starts] > 0)
    for s, e in zip(starts[large].tolist(), ends[large].tolist()):
        own, ids = values[s:e], nodes[s:e]
        if side[s] == 0:
            yield from dense_links(ids, own, ids, own, radius)
        else:
            a, b = side[s:e] == 1, side[s:e] == 2
            yield from dense_links(ids[a], own[a], ids[b], own[b], radius)
    small = np.repeat(~large, ends - starts)
    yield from sparse_links(nodes[small], values[small], group[small], radius)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def tables_of(radius: int) -> list[list[int]]:
    """Masks of the bits that a table is keyed by: two of ``radius + 2`` blocks of a word."""
    n = radius + 2
    cuts = [BITS * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [[signed(x | y)] for x, y in itertools.combinations(blocks, 2)]


def random_tables(words: int, tables: int, key_bits: int) -> list[list[int]]:
    """Masks of ``key_bits`` random bits of all words, per table; always the same."""
    rng = np.random.default_rng(3)
    out = []
    for _ in range(tables):
        chosen = rng.permutation(BITS * words)[:key_bits].tolist()
        out.append([signed(sum(1 << b % BITS for b in chosen if b // BITS == w)) for w in range(words)])
    return out


def links(prints: DataFrame, node: str, words: list[str], radius: int, masks: list[list[int]], tile: int = TILE) -> DataFrame:
    """Edges ``u, v`` between nodes with the same components as all pairs that meet in a table and
    differ in at most ``radius`` bits. ``prints`` holds each fingerprint once."""
    masked = [[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(words, table)] for table in masks]
    keys = F.array(*[m[0] if len(words) == 1 else F.xxhash64(*m) for m in masked])
    names = [f"w{i}" for i in range(len(words))]
    rows = prints.select(
        F.col(node).alias("node"), *[F.col(w).alias(n) for w, n in zip(words, names)],
        F.posexplode(keys).alias("t", "key"),
    )
    hot = (
        rows.groupBy("t", "key")
        .count()
        .filter(F.col("count") > tile)
        .select("t", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    )
    return compared(rows.join(hot, ["t", "key"], "left"), names, radius)


def proposals(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges ``u, v`` with the same components as all pairs of sketches that share a key and differ in
    at most ``RADIUS`` bits. ``prints`` has ``node, print``, each sketch once.

    Most keys stand alone: only the others meet with the bits.
    """
    names = [f"w{i}" for i in range(WORDS)]
    keys = prints.select("node", F.explode(F.slice("print", 4 + WORDS, BANDS)).alias("key"))
    shared = keys.groupBy("key").count().filter("count > 1")
    bits = prints.select("node", *[F.get("print", F.lit(3 + i)).alias(w) for i, w in enumerate(names)])
    rows = (
        keys.join(shared, "key")
        .join(bits, "node")
        .select("node", *names, F.lit(0).alias("t"), "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    )
    return compared(rows, names, RADIUS)


def compared(rows: DataFrame, names: list[str], radius: int) -> DataFrame:
    """Forests of the links between rows of one ``t, key``, in as many tiles as ``tiles`` says."""
    own = F.pmod(F.xxhash64(F.lit("tile"), "node"), F.col("tiles")).cast("int")
    other = F.explode_outer(F.when(F.col("tiles") > 1, F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = (
        rows.select("node", *names, "t", "key", own.alias("own"), other.alias("other"))
        .select(
            "node", *names, "t", "key",
            F.coalesce(F.least("own", "other"), F.lit(0)).alias("low"),
            F.coalesce(F.greatest("own", "other"), F.lit(0)).alias("high"),
            F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2)
            .otherwise(0).alias("side"),
        )
    )
    group = ["t", "key", "low", "high"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0

        def compare(frame: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            number = (frame[group] != frame[group].shift()).any(axis=1).cumsum().to_numpy()
            nodes = frame["node"].to_numpy().astype(np.int64)
            values = np.ascontiguousarray(frame[names].to_numpy().astype(np.int64)).view(np.uint64)
            found, pairs = [(nodes[:0], nodes[:0])], 0
            for u, v in group_links(nodes, values, number, frame["side"].to_numpy(), radius):
                found.append((u, v))
                pairs += len(u)
                if pairs > PAIRS:
                    found = [forest(*map(np.concatenate, zip(*found)))]
                    pairs = len(found[0][0])
            u, v = forest(*map(np.concatenate, zip(*found)))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append(batch.to_pandas())
            size += batch.num_rows
            if size < ROWS:
                continue
            frame = pd.concat(held, ignore_index=True)
            last = (frame[group] == frame[group].iloc[-1]).all(axis=1).to_numpy()
            border = int(np.argmax(last))
            if border:
                yield from compare(frame.iloc[:border])
            held, size = [frame.iloc[border:].reset_index(drop=True)], len(frame) - border
        if size:
            yield from compare(pd.concat(held, ignore_index=True))

    return (
        placed.repartition(*group)
        .sortWithinPartitions(*group, "side", "node")
        .mapInArrow(lambda b: tidied(task(b)), "u bigint, v bigint")
    )


def confirmed(proposed: DataFrame, prints: DataFrame, texts: DataFrame, size: int, weight: int = WEIGHT) -> DataFrame:
    """Edges ``u, v`` with the same components as all pairs of nodes that are in one component of
    ``proposed`` (``node, root``) and have a similarity of ``SIMILARITY`` or more.

    Only texts of proposed nodes are read, from ``texts`` (``node, text``). The sets of a component
    meet in tiles of about ``weight`` shingles, a group per pair of tiles.
    """
    members = proposed.unionByName(proposed.select(F.col("root").alias("node"), "root").distinct())
    members = cut_lineage(members.join(prints.select("node", F.get("print", F.lit(2)).alias("n")), "node"))
    tiles = members.groupBy("root").agg(F.ceil(F.sum("n") / weight).cast("int").alias("tiles"))
    wanted = members.join(tiles, "root").select("node", "root", "tiles")
    own = F.pmod(F.xxhash64(F.lit("tile"), "node"), F.col("tiles")).cast("int")
    other = F.explode_outer(F.when(F.col("tiles") > 1, F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = (
        texts.join(wanted, "node")
        .select("node", "root", "tiles", shingle_sets(F.col("text"), size).alias("hashes"))
        .select("node", "root", "hashes", own.alias("own"), other.alias("other"))
        .select(
            "root",
            F.coalesce(F.least("own", "other"), F.lit(0)).alias("low"),
            F.coalesce(F.greatest("own", "other"), F.lit(0)).alias("high"),
            F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2)
            .otherwise(0).alias("side"),
            "node", "hashes",
        )
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        group, found, pairs = None, [], 0

        def compare() -> None:
            nonlocal pairs
            side, nodes, sizes, hashes = map(np.concatenate, zip(*held))
            i, j = similar_links(sizes, hashes, side)
            found.append((nodes[i], nodes[j]))
            pairs += len(i)
            held.clear()

        def flush() -> pa.RecordBatch:
            u, v = map(np.concatenate, zip(*found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            side, nodes = (batch.column(c).to_numpy().astype(np.int64) for c in (3, 4))
            offsets, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:] if len(keys) else []):
                key = tuple(keys[s].tolist())
                if held and key != group:
                    compare()
                    if pairs > PAIRS:
                        yield flush()
                        pairs = 0
                group = key
                held.append((side[s:e], nodes[s:e], np.diff(offsets[s : e + 1]).astype(np.int64), values[offsets[s] : offsets[e]]))
        if held:
            compare()
        if found:
            yield flush()

    return (
        placed.repartition("root", "low", "high")
        .sortWithinPartitions("root", "low", "high", "side", "node")
        .mapInArrow(lambda b: tidied(task(b)), "u bigint, v bigint")
    )


def groups(rows: DataFrame, id_col: str, print_col: str, radius: int = 4) -> DataFrame:
    """``fp, root, component_id`` once per fingerprint: a member of its group that all share, and
    the smallest id of the group (null if no row of the group has an id)."""
    prints = cut_lineage(
        rows.groupBy(F.col(print_col).alias("fp")).agg(F.min(F.col(id_col)).alias("first"))
    )
    roots = components(links(prints, "fp", ["fp"], radius, tables_of(radius)))
    labelled = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    A null, empty or blank text has fingerprint zero and is linked like any other. Rows with equal
    ids each give a row. A group whose ids are all null has a null component. Other columns are not
    read; an empty table gives no rows.
    """
    rows = cut_lineage(
        docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), size).alias("fp"))
    )
    found = groups(rows, "doc_id", "fp", radius)
    return rows.join(found, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5
) -> DataFrame:
    """The rows of ``docs`` with one row per group of near duplicates: the smallest id (null last).

    Groups are linked where the sets of shingles of ``size`` words have a similarity of 0.8 or more:
    sketches propose groups, in which the sets themselves are compared. Texts without
    a word are copies of each other. Of rows with one id in a group one stays, by number. The columns
    are those of ``docs``. The rows are written once with a number each, bucketed by it: the choice
    is made on narrow rows, and joins on the number do not move the texts again.
    """
    seat = fresh(docs.columns, "__seat")
    rows = stored(docs, seat)
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "seat")).alias("best")
    prints = cut_lineage(
        rows.select(
            F.col(seat).alias("seat"), F.col(id_col).alias("id"), sketches(F.col(text_col), size).alias("print")
        )
        .groupBy("print")
        .agg(best, F.min("seat").alias("node"))
    )
    texts = rows.select(F.col(seat).alias("node"), F.col(text_col).alias("text"))
    found = confirmed(components(proposals(prints)), prints, texts, size)
    roots = components(found).withColumnRenamed("node", "n")
    chosen = (
        prints.select("node", "best").join(roots, F.col("node") == F.col("n"), "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.seat").alias(seat))
    )
    return rows.join(chosen, seat, "left_semi").select(*docs.columns)
