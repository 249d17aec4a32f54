"""Alignment of two tokenizers over a corpus: which tokens share bytes, and how often.

Both tokenizers are cut-safe at a word's start: no merge of either crosses a place where a space or
line feed follows a character that is neither. A text is thus a sequence of chunks, and the tokens,
groups and links of a chunk depend on the chunk alone.

A first pass over the documents counts links of id pairs, added up per task. The distinct pairs,
dealt by their B id, get a minimal perfect hash per bucket: levels of bit sets, where a key rests on
the first level on which no other key has its place, and ranks among the set bits number the keys
without gaps. The counts of the tasks become dense vectors indexed by the hash and are summed in a
tree. A bucket holds all pairs of its B ids, so the largest count of a B id is known in the bucket.
A second pass aligns the documents again and looks counts up by hash, each checked against its key.
Tables travel to the tasks in rounds of at most ``ROUND`` bytes; a round adds its share to every row.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlake.llm import packing, tokencount
from evlake.llm.common import fresh, per_process, tidied
from evlake.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(packing)
cloudpickle.register_pickle_by_value(tokencount)

# Buckets of B ids; pairs held before a task hands them on; characters of chunks remembered by a
# task; chunks encoded as one text; chunks taken together; vectors summed by one task; rows a table starts with; bytes of one
# round's tables.
BUCKETS = 64
HELD = 1 << 19
REMEMBERED = 40 << 20
TOGETHER = 256
AT_ONCE = 1 << 16
FAN = 16
ROWS = 1 << 12
ROUND = 64 << 20
# A pair is one number: the A id above, the B id below.
SHIFT = 32
# Bits per key on a level of the hash, and the odd multipliers of its hash (fixed values).
ROOM = 2
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

SPACE_MARK = tokencount.MARK


class Aligned(NamedTuple):
    """Many chunks at once: numbers per chunk, pairs of all their links in order, groups as text."""

    numbers: np.ndarray
    pairs: np.ndarray
    groups: list[str]


class Aligner:
    """Tokens of texts by both tokenizers, chunk by chunk."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        with open(path_a, encoding="utf-8") as file:
            settings = json.load(file)
        split = settings["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not plain or settings["normalizer"] or settings["model"]["type"] != "BPE":
            raise ValueError(f"{path_a} is not a byte-level BPE with the usual words")
        self.a = packing.Encoder(path_a)
        self.a.whole.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        alone = tokencount.isolated(tokencount.vocabulary(path_b))
        sizes = {i: len(t) for t, i in settings["model"]["vocab"].items()}
        self.size_a = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)])
        self.size_b = np.array([piece_size(self.b, i) for i in range(self.b.get_piece_size())])
        # Ids in decimal, with what follows inside a group and at its end.
        self.shown_a = [np.array([f"{i}{end}" for i in range(len(self.size_a))], object) for end in ",|"]
        self.shown_b = [np.array([f"{i}{end}" for i in range(len(self.size_b))], object) for end in ",;"]
        # A chunk ends before a space (or an isolated control) that follows a visible character.
        starts = " " + alone
        odd = rf"(?:(?![{starts}])[\s{SPACE_MARK}])"
        self.find = re.compile(
            rf"[\s{SPACE_MARK}]*[^\s{SPACE_MARK}]+(?:{odd}[\s{SPACE_MARK}]*[^\s{SPACE_MARK}]+)*(?:{odd}[\s{SPACE_MARK}]*$)?"
            rf"|[\s{SPACE_MARK}]+$"
        )
        self.alone = alone[0]

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The chunks of a space and the text, in lists of bounded length."""
        text = " " + text
        if len(text) < AT_ONCE:
            yield self.find.findall(text)
        else:
            found = (m.group() for m in self.find.finditer(text))
            yield from map(list, itertools.batched(found, AT_ONCE))

    def align(self, chunks: list[str]) -> Aligned:
        """All chunks in one row of bytes. Two tokens share bytes on exactly one stretch between
        neighbouring token ends, so a link is such a stretch; a group ends where both end."""
        runs = self.runs(chunks)
        # The library puts a space mark in front; an isolated character parts the text from it.
        found_a = b"".join(map(self.a.encode, runs))
        found_b = self.b.encode([self.alone + r for r in runs], num_threads=1)
        a = np.frombuffer(found_a, "<u4").astype(np.int64)
        b = np.fromiter(itertools.chain.from_iterable(x[2:] for x in found_b), np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        borders = np.cumsum([len(c.encode()) for c in chunks])
        last_a, last_b = np.searchsorted(ends_a, borders), np.searchsorted(ends_b, borders)
        if ends_a[-1] != borders[-1] or (ends_a[last_a] != borders).any() or (ends_b[last_b] != borders).any():
            raise ValueError("the tokenizers do not give back the same bytes")
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        ends = np.union1d(ends_a, ends_b)
        pairs = pair_numbers(a[np.searchsorted(ends_a, ends)], b[np.searchsorted(ends_b, ends)])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        n_links = np.diff(np.searchsorted(ends, borders, "right"), prepend=0)
        n_groups = np.diff(np.searchsorted(both, borders, "right"), prepend=0)
        numbers = np.stack([n_a, n_b, n_groups, n_links], axis=1)
        return Aligned(numbers, pairs, self.shown(a, b, ends_a, ends_b, both, borders))

    def runs(self, chunks: list[str]) -> list[str]:
        """The chunks as few texts: what is cut-safe in a text is so in any row of chunks, but for a
        chunk that ends with a space, which nothing may follow."""
        out, first = [], 0
        for i, c in enumerate(chunks, 1):
            if i - first == TOGETHER or c[-1].isspace():
                out.append("".join(chunks[first:i]))
                first = i
        if first < len(chunks):
            out.append("".join(chunks[first:]))
        return out

    def shown(self, a, b, ends_a, ends_b, both, borders) -> list[str]:
        """Per chunk its groups as ``a,a|b;a|b,b;``, cut from the text of all."""
        last_a, last_b = np.isin(ends_a, both), np.isin(ends_b, both)
        # A group's A ids stand behind the B ids of all earlier groups, its B ids behind its A ids.
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        until_a, until_b = np.searchsorted(ends_a, both, "right"), np.searchsorted(ends_b, both, "right")
        place_a = np.arange(len(a)) + np.concatenate(([0], until_b))[group_a]
        place_b = np.arange(len(b)) + until_a[group_b]
        words = np.empty(len(a) + len(b), object)
        words[place_a] = np.where(last_a, self.shown_a[1][a], self.shown_a[0][a])
        words[place_b] = np.where(last_b, self.shown_b[1][b], self.shown_b[0][b])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)[place_b[np.searchsorted(ends_b, borders)]].tolist()
        text = "".join(words)
        return [text[i:j] for i, j in zip([0, *ends], ends)]


def parts_of(aligner: Aligner, texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    """Chunks of many texts with the texts' numbers, in bundles of bounded length."""
    bundle: list[tuple[int, list[str]]] = []
    size = 0
    for i, text in enumerate(texts):
        for chunks in aligner.chunks(text) if has_tokens(text) else ():
            bundle.append((i, chunks))
            size += len(chunks)
            if size >= AT_ONCE:
                yield bundle
                bundle, size = [], 0
    yield bundle


def piece_size(model, i: int) -> int:
    """Bytes of a piece in a text: a byte piece has one, a space mark is one space."""
    if model.is_byte(i):
        return 1
    return len(model.id_to_piece(i).replace(SPACE_MARK, " ").encode())


def has_tokens(text: str | None) -> bool:
    """Whether both tokenizers give back the bytes of the text. A literal space mark is the one
    character that comes back otherwise: neither model rewrites texts (`vocabulary` sees to it)."""
    return bool(text) and SPACE_MARK not in text


def bucket_of(pairs: np.ndarray) -> np.ndarray:
    ids = (pairs & 0xFFFFFFFF).astype(np.uint64)
    return ((ids * np.uint64(MIX[0])) >> np.uint64(40)).astype(np.int64) % BUCKETS


class Remembered:
    """Numbers chunks by their first appearance, until they hold too many characters together.

    ``add`` is told new chunks in the order of their numbers, ``forget`` that numbers start again.
    """

    def __init__(self, add, forget):
        self.add, self.forget = add, forget
        self.known: dict[str, int] = {}
        self.room = REMEMBERED

    def numbers(self, bundle: list[tuple[int, list[str]]]) -> list[np.ndarray]:
        if self.room < 0:
            self.forget()
            self.known.clear()
            self.room = REMEMBERED
        known = self.known
        new = list(dict.fromkeys(c for _, chunks in bundle for c in chunks if c not in known))
        if new:
            first = len(known)
            known.update(zip(new, range(first, first + len(new))))
            self.room -= sum(map(len, new)) + 64 * len(new)
            self.add(first, new)
        return [np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks)) for _, chunks in bundle]


def grown(table: np.ndarray, rows: int) -> np.ndarray:
    """The same rows and room for more."""
    if rows <= len(table):
        return table
    out = np.zeros((max(rows, 2 * len(table)), *table.shape[1:]), table.dtype)
    out[: len(table)] = table
    return out


def counted_pairs(docs: DataFrame, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """First pass: ``part, bucket, pair, n``, added up in each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_process(f"aligner_{path_a}_{path_b}", lambda: Aligner(path_a, path_b))
        part = TaskContext.get().partitionId()
        uses = np.zeros(ROWS, np.int64)
        pairs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        totals: Counter = Counter()

        def add(first: int, new: list[str]) -> None:
            nonlocal uses
            uses = grown(uses, first + len(new))
            aligned = aligner.align(new)
            pairs.append(aligned.pairs)
            sizes.append(aligned.numbers[:, 3])

        def settle() -> None:
            """Add the chunks' links, each times its uses."""
            if pairs:
                keys, places = np.unique(np.concatenate(pairs), return_inverse=True)
                each = np.concatenate(sizes)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, places, np.repeat(uses[: len(each)], each))
                totals.update(dict(zip(keys.tolist(), sums.tolist())))
            pairs.clear()
            sizes.clear()
            uses[:] = 0

        def handed_on() -> pa.RecordBatch:
            pairs = np.fromiter(totals.keys(), np.int64, len(totals))
            counts = np.fromiter(totals.values(), np.int64, len(totals))
            totals.clear()
            columns = [np.full(len(pairs), part, np.int64), bucket_of(pairs), pairs, counts]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["part", "bucket", "pair", "n"])

        remembered = Remembered(add, settle)
        for batch in batches:
            for bundle in parts_of(aligner, batch.column(0).to_pylist()):
                for numbers in remembered.numbers(bundle):
                    np.add.at(uses, numbers, 1)
            if len(totals) > HELD:
                yield handed_on()
        settle()
        yield handed_on()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(
        lambda batches: tidied(task(batches)), "part bigint, bucket bigint, pair bigint, n bigint"
    )


def pair_numbers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left << SHIFT) | right


def places_of(pairs: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each key on a level of the hash."""
    with np.errstate(over="ignore"):
        x = pairs.astype(np.uint64) + np.uint64(MIX[0]) * np.uint64(level + 1)
        for shift, factor in ((30, MIX[1]), (27, MIX[2])):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash: distinct keys to 0 .. n - 1. Made of the sizes and bit sets of its levels."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        self.ranks = []
        self.n = 0
        for level in bits:
            self.ranks.append(np.cumsum(level, dtype=np.int32) - level + np.int32(self.n))
            self.n += int(level.sum())

    @classmethod
    def over(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        left = keys
        while len(left):
            size = ROOM * len(left) + 1
            places = places_of(left, len(sizes), size)
            single = np.bincount(places, minlength=size) == 1
            sizes.append(size)
            bits.append(single)
            left = left[~single[places]]
        return cls(sizes, bits)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that was not hashed, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits) in enumerate(zip(self.sizes, self.bits)):
            places = places_of(keys[left], level, size)
            here = bits[places]
            out[left[here]] = self.ranks[level][places[here]]
            left = left[~here]
            if not len(left):
                break
        return out

    def stored(self) -> tuple[list[int], bytes]:
        return self.sizes, b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def restored(cls, sizes: list[int], data: bytes) -> PerfectHash:
        bits, at = [], 0
        for size in sizes:
            n = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at), count=size).astype(bool))
            at += n
        return cls(sizes, bits)


HASHES = "bucket bigint, sizes array<bigint>, bits binary, keys binary"
VECTORS = "bucket bigint, branch bigint, counts binary"


def hash_tables(distinct: DataFrame) -> DataFrame:
    """A minimal perfect hash per bucket of ``bucket, pair``, with its keys in the hash's order."""

    def made(rows: pa.Table) -> pa.Table:
        keys = rows.column("pair").to_numpy()
        table = PerfectHash.over(keys)
        ordered = np.empty(len(keys), "<i8")
        ordered[table.of(keys)] = keys
        sizes, bits = table.stored()
        return pa.table({"bucket": rows.column("bucket")[:1], "sizes": [sizes], "bits": [bits],
                         "keys": [ordered.tobytes()]})

    return distinct.groupBy("bucket").applyInArrow(made, HASHES)


def summed(counts: DataFrame, hashes: DataFrame, tasks: int) -> DataFrame:
    """``bucket, counts``: dense vectors indexed by the hash, summed in a tree of ``FAN`` branches."""
    branch = F.floor(F.col("part") / F.lit(FAN)).cast("bigint")
    partial = counts.select("bucket", branch.alias("branch"), "pair", "n")
    present = partial.select(F.col("bucket").alias("home"), F.col("branch").alias("arm")).distinct()
    hashes = present.join(hashes.select("bucket", "sizes", "bits"), F.col("home") == F.col("bucket")).drop("bucket")

    def dense(rows: pa.Table, table: pa.Table) -> pa.Table:
        numbers = PerfectHash.restored(table.column("sizes")[0].as_py(), table.column("bits")[0].as_py())
        vector = np.zeros(numbers.n, "<i8")
        np.add.at(vector, numbers.of(rows.column("pair").to_numpy()), rows.column("n").to_numpy())
        return pa.table({"bucket": rows.column("bucket")[:1], "branch": rows.column("branch")[:1],
                         "counts": [vector.tobytes()]})

    def added(rows: pa.Table) -> pa.Table:
        vector = sum(np.frombuffer(c.as_py(), "<i8") for c in rows.column("counts"))
        return pa.table({"bucket": rows.column("bucket")[:1], "branch": rows.column("branch")[:1],
                         "counts": [vector.tobytes()]})

    vectors = partial.groupBy("bucket", "branch").cogroup(hashes.groupBy("home", "arm")).applyInArrow(
        dense, VECTORS
    )
    width = -(-tasks // FAN)
    while width > 1:
        vectors = vectors.withColumn("branch", F.floor(F.col("branch") / F.lit(FAN)).cast("bigint"))
        vectors = vectors.groupBy("bucket", "branch").applyInArrow(added, VECTORS)
        width = -(-width // FAN)
    return vectors.drop("branch")


def lookup_tables(counts: DataFrame) -> DataFrame:
    """``bucket, sizes, bits, keys, counts, best``; ``best``: the count is its B id's largest."""
    hashes = cut_lineage(hash_tables(counts.select("bucket", "pair").distinct()))
    tasks = (counts.agg(F.max("part")).first()[0] or 0) + 1
    tables = hashes.join(summed(counts, hashes, tasks), "bucket")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for keys, values in zip(batch.column("keys"), batch.column("counts")):
                ids = np.frombuffer(keys.as_py(), "<i8") & 0xFFFFFFFF
                numbers = np.frombuffer(values.as_py(), "<i8")
                names, places = np.unique(ids, return_inverse=True)
                most = np.zeros(len(names), np.int64)
                np.maximum.at(most, places, numbers)
                flags.append((numbers == most[places]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.binary())],
                                             names=[*batch.schema.names, "best"])

    return cut_lineage(tables.mapInArrow(marked, f"{HASHES}, counts binary, best binary"))


class Lookup:
    """Counts of pairs in the buckets of one round; pairs of other buckets count nothing."""

    def __init__(self, rows: list[tuple]):
        self.tables = {
            bucket: (PerfectHash.restored(sizes, bits), np.frombuffer(keys, "<i8"),
                     np.frombuffer(counts, "<i8"), np.frombuffer(best, bool))
            for bucket, sizes, bits, keys, counts, best in rows
        }

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        buckets = bucket_of(pairs)
        for bucket in np.unique(buckets).tolist():
            if bucket not in self.tables:
                continue
            numbers, keys, values, flags = self.tables[bucket]
            here = np.flatnonzero(buckets == bucket)
            found = numbers.of(pairs[here])
            if (found < 0).any() or (keys[found] != pairs[here]).any():
                raise ValueError("the documents have changed between the two passes")
            counts[here], best[here] = values[found], flags[found]
        return counts, best


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def looked_up(docs: DataFrame, keep: list[str], text_col: str, path_a: str, path_b: str, tables: list[tuple]) -> DataFrame:
    """Second pass, one round: the kept columns, ``NUMBERS`` and ``groups_sha256``."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    text_name = fresh(keep, "text")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text_name))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_process(f"aligner_{path_a}_{path_b}", lambda: Aligner(path_a, path_b))
        lookup = Lookup(shared.value)
        table = np.zeros((ROWS, len(NUMBERS)), np.int64)
        groups: list[str] = []

        def add(first: int, new: list[str]) -> None:
            nonlocal table
            aligned = aligner.align(new)
            starts = np.cumsum(aligned.numbers[:, 3]) - aligned.numbers[:, 3]
            found = [np.add.reduceat(x.astype(np.int64), starts) for x in lookup.of(aligned.pairs)]
            table = grown(table, first + len(new))
            table[first : first + len(new)] = np.column_stack([aligned.numbers, found[1], found[0]])
            groups.extend(aligned.groups)

        remembered = Remembered(add, groups.clear)

        for batch in batches:
            texts = batch.column(text_name).to_pylist()
            sums = np.zeros((len(texts), len(NUMBERS)), np.int64)
            digests: dict[int, Any] = {}
            for bundle in parts_of(aligner, texts):
                for (i, _), numbers in zip(bundle, remembered.numbers(bundle)):
                    sums[i] += table[numbers].sum(axis=0)
                    shown = "".join(map(groups.__getitem__, numbers.tolist()))
                    # The last separator is held back until more follows.
                    digest = digests.get(i)
                    if digest is None:
                        digest = digests[i] = hashlib.sha256()
                    else:
                        digest.update(b";")
                    digest.update(shown[:-1].encode())
            place = batch.schema.get_field_index(text_name)
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            columns += [pa.array(sums[:, i]) for i in range(len(NUMBERS))]
            found = [digests[i].hexdigest() if i in digests else "" for i in range(len(texts))]
            columns.append(pa.array(found, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *NUMBERS, "groups_sha256"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text_name]
    schema += [f"{n} bigint" for n in NUMBERS] + ["groups_sha256 string"]
    return rows.mapInArrow(lambda batches: tidied(task(batches)), ", ".join(schema))


def rounds(tables: DataFrame, limit: int) -> list[list[int]]:
    """Buckets dealt to rounds of at most ``limit`` bytes; a larger bucket is a round by itself."""
    sizes = tables.select(
        "bucket", (F.length("bits") + F.length("keys") + F.length("counts") + F.length("best")).alias("size")
    ).orderBy("bucket").collect()
    out: list[list[int]] = []
    room = 0
    for bucket, size in sizes:
        if size > room or not out:
            out.append([])
            room = limit
        out[-1].append(bucket)
        room -= size
    return out or [[]]


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
    round_bytes: int = ROUND,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    A is a byte-level BPE vocabulary, which gets a space and the text, B a piece-wise BPE model,
    which adds the space itself. A link is a pair of token occurrences that share bytes; the count of
    an id pair is its number of links in all rows. ``n_best`` has the links whose count is the
    largest of their B id, ties included. A text that is null, empty or has a literal space mark has
    no tokens: zeros, and ''. Equal rows count each by itself; ids may be null or equal; an empty
    table gives no rows; other columns are not read, whatever their names.

    The tables of counts grow with the distinct pairs only. They are given to the tasks in rounds of
    ``round_bytes`` bytes; a bucket, all pairs of one 64th of the B ids, is the least of a round.
    """
    counts = cut_lineage(counted_pairs(docs, text_col, path_a, path_b))
    tables = lookup_tables(counts)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def one_round(keep: list[str], buckets: list[int]) -> DataFrame:
        columns = ["bucket", "sizes", "bits", "keys", "counts", "best"]
        rows = tables.filter(F.col("bucket").isin(buckets)).select(*columns).collect()
        return looked_up(source, keep, "text", path_a, path_b, [tuple(r) for r in rows])

    first, *others = rounds(tables, round_bytes)
    result = one_round(["doc_id"], first)
    if not others:
        return result
    # Equal groups mean equal links, so later rounds add their sums by the digest of the groups.
    sums = ["n_best", "count_sum"]
    shares = [
        cut_lineage(one_round([], d).groupBy("groups_sha256").agg(*[F.max(c).alias(f"more_{c}") for c in sums]))
        for d in others
    ]
    more = functools.reduce(DataFrame.unionByName, shares).groupBy("groups_sha256").agg(
        *[F.sum(f"more_{c}").alias(f"more_{c}") for c in sums]
    )
    return cut_lineage(result).join(more, "groups_sha256").select(
        "doc_id", *NUMBERS[:4], *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in sums], "groups_sha256"
    )
