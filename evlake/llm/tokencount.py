"""Token counts of whole texts for a piece-wise BPE model, mostly without merging.

Two facts of the model, both read off its vocabulary before any text is counted, make the work
local. No piece has the space mark behind another character, so no merge crosses a place where a
space mark follows something else. And a character that no longer piece contains (a line feed, a
tab) never merges at all. A text is therefore a sequence of pre-tokens that are merged each by
itself. A piece that the model, given that piece alone, encodes as just that piece is proved to be
one token wherever it stands as a pre-token; texts are counted by looking pre-tokens up among the
proved ones, and only the rest is merged.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlake.llm.common import per_process, tidied

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The format's mark for a space.
MARK = "▁"
# Control characters looked at for isolation; other characters may be isolated too, unused.
CONTROLS = "\n\t"
# Pre-tokens remembered by one Python worker, the longest of them, and pre-tokens taken at once.
REMEMBERED = 1 << 18
LONGEST = 64
AT_ONCE = 1 << 16


class Counter:
    """Counts the tokens of texts; equal to the library's own encoding without special tokens."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.encode = SentencePieceProcessor(model_file=path).encode
        pieces = vocabulary(path)
        self.alone = isolated(pieces)
        self.find = re.compile(pre_token(self.alone))
        self.proved = self.whole_tokens(pieces)
        self.known = dict(self.proved)

    def whole_tokens(self, pieces: list[str]) -> dict[str, int]:
        """The pieces that are one pre-token and that the model, given them alone, leaves whole."""
        asked = [p for p in pieces if self.find.fullmatch(p)]
        return {p: n for p, n in zip(asked, self.merged(asked)) if n == 1}

    def merged(self, tokens: list[str]) -> list[int]:
        """Token counts of pre-tokens, by the library's merges.

        The library puts a space mark in front of a text. An isolated character parts the pre-token
        from that mark; both are a token of their own and count off.
        """
        found = self.encode([self.alone[0] + t for t in tokens], num_threads=1)
        return [len(ids) - 2 for ids in found]

    def count(self, text: str) -> int:
        """Tokens of a whole text; its pre-tokens are never held together for a long one."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if len(marked) < AT_ONCE:
            return self.total(self.find.findall(marked))
        found = (m.group() for m in self.find.finditer(marked))
        return sum(self.total(part) for part in itertools.batched(found, AT_ONCE))

    def total(self, tokens) -> int:
        known = self.known
        try:
            return sum(map(known.__getitem__, tokens))
        except KeyError:
            pass
        new = list(set(tokens).difference(known))
        known.update(zip(new, self.merged(new)))
        result = sum(map(known.__getitem__, tokens))
        for token in new:
            if len(token) > LONGEST:
                del known[token]
        if len(known) > REMEMBERED:
            self.known = dict(self.proved)
        return result


def pre_token(alone: str) -> str:
    """A run of space marks with what follows it, or an isolated character by itself."""
    return f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{alone}]"


def isolated(pieces: list[str]) -> str:
    return "".join(c for c in CONTROLS if not any(c in p and len(p) > 1 for p in pieces))


def vocabulary(path: str) -> list[str]:
    """The pieces that merges can make; refuses a model whose texts don't fall into pre-tokens."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kinds = model.SentencePiece
    rules, trainer = model.normalizer_spec, model.trainer_spec
    pieces = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
    crossing = re.compile(f"[^{MARK}]{MARK}")
    faults = {
        "is not merged by pairs": trainer.model_type != trainer.BPE,
        "rewrites texts": bool(rules.precompiled_charsmap) or rules.remove_extra_whitespaces,
        "marks spaces otherwise": not rules.add_dummy_prefix or not rules.escape_whitespaces
        or trainer.treat_whitespace_as_suffix,
        "has pieces of its user": any(p.type == kinds.USER_DEFINED for p in model.pieces),
        "has a space mark inside a piece": any(map(crossing.search, pieces)),
        "merges every control character": not isolated(pieces),
    }
    for fault, present in faults.items():
        if present:
            raise ValueError(f"the model {path} {fault}; its pre-tokens are not independent")
    return pieces


def count_tokens(
    docs: DataFrame, model: str, text_col: str = "text", limit: int = 4096,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The columns ``keep``, then ``n_bytes, n_tokens, over_limit`` for every row.

    ``n_bytes`` is the length in UTF-8, ``over_limit`` whether there are more than ``limit`` tokens.
    A null text counts as empty: 0 bytes, 0 tokens. Strings of special tokens inside a text are
    plain text, as in the library. Rows with null or equal ids are rows of their own; an empty table
    gives no rows; columns not kept are not read, whatever their names; a kept column named like a
    result is refused. ``model`` is the path of the model on every executor. One scan, no shuffle.
    """
    taken = {"n_bytes", "n_tokens", "over_limit"} & {c.lower() for c in keep}
    if taken:
        raise ValueError(f"kept columns named like results: {sorted(taken)}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.select(*keep, F.octet_length(text).cast("bigint").alias("n_bytes"),
                          text.alias("n_tokens"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(f"counts_{model}", lambda: Counter(model))
        for batch in batches:
            numbers = [counter.count(t.as_py()) for t in batch.column("n_tokens")]
            place = batch.schema.get_field_index("n_tokens")
            yield batch.set_column(place, "n_tokens", pa.array(numbers, pa.int64()))

    schema = ", ".join(
        f"`{f.name}` {'bigint' if f.name == 'n_tokens' else f.dataType.simpleString()}"
        for f in counted.schema
    )
    rows = counted.mapInArrow(lambda batches: tidied(task(batches)), schema)
    return rows.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def token_count(text: Column, model: str) -> Column:
    """The tokens of a text column, for use in any expression (null: 0)."""

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        counter = per_process(f"counts_{model}", lambda: Counter(model))
        return pa.array([counter.count(t.as_py() or "") for t in texts], pa.int64())

    return counted(text)
