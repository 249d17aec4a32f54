"""Packing documents into token sequences by minimum bin slack.

A document's ids are cut into whole windows and one rest. Rests wait in a pool per task; for each
window a subset-sum over the multiset of waiting lengths, kept as a bit set, finds the fill closest
to the capacity, and the counts are read back from the bit sets. The pool is bounded, and a window
is closed only when it is full: where no subset fills it, one more rest is cut to size. What is left
at the end of a task, less than a window, is cut at powers of two, which need no padding. No row is shuffled: a task packs what it reads, and a repeated task packs
the same.
"""

from __future__ import annotations

import array
import base64
import json
import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlake.llm.common import per_process, tidied

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 1024
# Rests of documents that wait in one task: at most 4 KiB of ids each.
POOL = 4096
# Characters tokenized at once, and pre-tokens remembered by one Python worker.
BLOCK = 1 << 20
REMEMBERED = 1 << 18

# Fixed values of the byte-level vocabulary: its pre-token pattern, written for the characters of
# SAFE, whose letter, number and space classes are the same in every version of Unicode. Other
# texts go through the tokenizer itself.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBER = "0-9²³¹¼-¾"
SPACE = r" \t\n\r\x0b\x0c"
PRE_TOKEN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
SAFE = r"[\t\n\r\x0b\x0c -~¡-¬®-ÿ]*"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of texts, equal to the tokenizer's own, with the ids of pre-tokens remembered.

    Pre-tokens are merged by rank (a pre-token's ids do not depend on what stands around it). A
    text with characters outside ``SAFE`` or with the special token is encoded by the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = byte_symbols()
        ranks = {
            bytes(byte_of[c] for c in token): rank
            for token, rank in vocabulary.items()
            if token != SPECIAL
        }
        self.merge = tiktoken.Encoding(
            "ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.split = re.compile(PRE_TOKEN).findall
        self.safe = re.compile(SAFE).fullmatch
        # A space between a visible character and a letter starts a pre-token in any context.
        self.border = re.compile(rf"(?<=[!-~])(?= [{LETTER}])")
        self.known: dict[str, bytes] = {}

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in blocks."""
        start = 0
        while start < len(text):
            found = self.border.search(text, start + BLOCK) if len(text) - start > BLOCK else None
            end = found.start() if found else len(text)
            yield self.encode(text[start:end] if start or end < len(text) else text)
            start = end

    def encode(self, text: str) -> bytes:
        if SPECIAL in text or not self.safe(text):
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        tokens = self.split(text)
        known = self.known
        try:
            return b"".join([known[t] for t in tokens])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for token in set(tokens).difference(known):
                known[token] = packed(self.merge(token))
            return b"".join([known[t] for t in tokens])


def byte_symbols() -> dict[str, int]:
    """The visible symbol that byte-level vocabularies write for each byte, back to the byte.

    Fixed by the format: visible Latin-1 characters stand for themselves, the others follow in
    order from code point 256.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def packed(ids: list[int]) -> bytes:
    values = array.array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


def fill(lengths: dict[int, int], capacity: int) -> list[int]:
    """The multiset of lengths whose sum is closest to the capacity from below.

    ``lengths`` has the count of each length. Bit s of ``reach`` says that the sum s can be made.
    Lengths enter from the longest, so large rests go first; a length with count c enters as
    bundles of 1, 2, 4, ... copies. The bit sets before each bundle are kept, and the way back
    takes a bundle where the sum could not be made without it.
    """
    reach, full, whole = 1, 1 << capacity, (1 << (capacity + 1)) - 1
    trail: list[tuple[int, int, int]] = []
    for length in sorted(lengths, reverse=True):
        left, bundle = min(lengths[length], capacity // length), 1
        while left:
            n = min(bundle, left)
            trail.append((length, n, reach))
            reach |= (reach << (n * length)) & whole
            left, bundle = left - n, 2 * bundle
            if reach & full:
                break
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen: list[int] = []
    for length, n, before in reversed(trail):
        if not before >> total & 1:
            chosen += [length] * n
            total -= length * n
    return chosen


class Packer:
    """Packs the documents of one task. ``emit`` gets a piece with its place."""

    def __init__(self, first_sequence: int, window: int, pool: int, emit):
        self.next, self.window, self.limit, self.emit = first_sequence, window, pool, emit
        self.waiting: dict[int, list] = {}
        self.count = self.tokens = 0

    def add(self, doc, start: int, ids: bytes) -> None:
        """A piece of at most one window."""
        length = len(ids) // 4
        if length == self.window:
            self.place([(doc, start, ids)])
            return
        self.put((doc, start, ids))
        while self.count >= self.limit and self.tokens >= self.window:
            self.one()

    def one(self) -> None:
        """Fill and close one window; if no subset fills it, cut one more piece to size."""
        chosen = fill({k: len(v) for k, v in self.waiting.items()}, self.window)
        pieces = [self.take(length) for length in chosen]
        slack = self.window - sum(chosen)
        if slack:
            doc, start, ids = self.take(min(k for k in self.waiting if k > slack))
            pieces.append((doc, start, ids[: 4 * slack]))
            self.put((doc, start + slack, ids[4 * slack :]))
        self.place(pieces)

    def put(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        self.waiting.setdefault(length, []).append(piece)
        self.count += 1
        self.tokens += length

    def take(self, length: int):
        pieces = self.waiting[length]
        piece = pieces.pop()
        self.count -= 1
        self.tokens -= length
        if not pieces:
            del self.waiting[length]
        return piece

    def place(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids in pieces:
            self.emit(doc, start, ids, self.next, offset)
            offset += len(ids) // 4
        self.next += 1

    def close(self) -> None:
        """Pack the rest: full windows, then sequences whose lengths are powers of two."""
        while self.tokens >= self.window:
            self.one()
        left = [piece for length in sorted(self.waiting, reverse=True)
                for piece in reversed(self.waiting[length])]
        rest = self.tokens
        for size in (1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1):
            row, room = [], size
            while room:
                doc, start, ids = left.pop()
                n = min(room, len(ids) // 4)
                row.append((doc, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    left.append((doc, start + n, ids[4 * n :]))
                room -= n
            self.place(row)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    window: int = WINDOW,
    pool: int = POOL,
    keep_words: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the ids of its text (null: empty) and ``end_id``. Pieces of a document are
    gapless, and so are the offsets of a sequence. Rows with equal or null ids are documents of
    their own; an empty table gives no rows; other columns are not read. ``tokenizer`` is the path
    of a byte-level vocabulary on every executor. Sequence numbers are unique; they hold the task's
    number in the upper bits. Without ``keep_words``, remembered pre-tokens go at the end of each
    task, for jobs whose other steps need the memory of the Python workers.
    """
    source = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = packed([end_id])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(f"encoder_{tokenizer}", lambda: Encoder(tokenizer))
        rows: list[list] = []
        totals: dict[int, int] = {}

        def emit(doc, start, ids, sequence, offset):
            doc_id, number = doc
            rows.append([doc_id, start, len(ids) // 4, zlib.crc32(ids), totals[number],
                         sequence, offset])

        packer = Packer(TaskContext.get().partitionId() << 33, window, pool, emit)
        number = 0
        for batch in batches:
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                number += 1
                pieces = list(windows(encoder.blocks(text), end, 4 * window))
                totals[number] = (len(pieces) - 1) * window + len(pieces[-1]) // 4
                for i, ids in enumerate(pieces):
                    packer.add((doc_id, number), i * window, ids)
                if len(rows) >= 8192:
                    yield table(rows)
                    rows.clear()
            if len(totals) > 4 * pool:
                held = {p[0][1] for pieces in packer.waiting.values() for p in pieces}
                totals = {k: v for k, v in totals.items() if k in held}
        packer.close()
        if not keep_words:
            encoder.known.clear()
        if rows:
            yield table(rows)

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*rows)], names=names
        )

    return source.mapInArrow(lambda batches: tidied(task(batches)), ", ".join(f"{n} bigint" for n in names))


def windows(blocks: Iterator[bytes], end: bytes, size: int) -> Iterator[bytes]:
    """Cut a document's ids, with the closing id, into pieces of ``size`` bytes and a rest."""
    held = b""
    for block in blocks:
        held += block
        whole = len(held) // size * size
        for i in range(0, whole, size):
            yield held[i : i + size]
        held = held[whole:]
    held += end
    yield held


