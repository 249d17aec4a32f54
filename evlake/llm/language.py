"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords, which are runs of two to four bytes within a
word and its borders, hashed to a fixed number of rows. Embeddings and the softmax layer are learnt
by stochastic gradient descent in numpy from a bounded sample of fragments; a temperature fitted on
fragments that were kept apart makes the scores probabilities, and a threshold from the same
fragments says when to reject. Whole texts are scored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evlake.llm.common import fresh, starts_of, text_blocks, tidied

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
UNKNOWN = "und"
# Bytes whose subwords are held at once, and texts that are prepared together.
BLOCK = 1 << 18
TEXTS = 256
FRAGMENTS = (40, 200, 1000)
SPACE = 32
TO_LETTERS = bytes(
    b if b >= 128 or 97 <= b <= 122 or 65 <= b <= 90 else SPACE for b in range(256)
)


@dataclass
class LanguageModel:
    """``weights`` holds per subword bucket its embedding times the softmax layer."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def letters(text: str | None) -> bytes:
    """Lower-cased UTF-8 with everything in ASCII but letters as spaces, and a space at each end."""
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(TO_LETTERS) + b" "


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any(map(str.isalpha, text))


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords and where each starts. None holds a space inside or only spaces."""
    blank = data == SPACE
    found, places = [], []
    for n in SIZES:
        count = len(data) - n + 1
        if count <= 0:
            continue
        value = np.zeros(count, dtype=np.uint32)
        for i in range(n):
            value |= data[i : i + count].astype(np.uint32) << np.uint32(8 * i)
        good = ~(blank[:count] & blank[n - 1 :]) if n == 2 else np.ones(count, dtype=bool)
        for i in range(1, n - 1):
            good &= ~blank[i : i + count]
        at = np.flatnonzero(good)
        mixed = (value[at] + np.uint32(n)) * np.uint32(2654435761)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(2246822519)
        found.append((mixed >> np.uint32(17)).astype(np.int64))
        places.append(at)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    examples: list[tuple[str, int]],
    apart: list[tuple[str, int]],
    languages: list[str],
    dimensions: int = 16,
    epochs: int = 5,
    rate: float = 0.5,
    reject: float = 0.001,
) -> LanguageModel:
    """Fit on ``examples`` (text, class); ``apart`` fits temperature and threshold.

    The threshold rejects at most the share ``reject`` of the fragments set apart that are
    classified rightly, and nothing that is more likely right than wrong.
    """
    rng = np.random.default_rng(7)
    k = len(languages)
    embedding = rng.normal(0, 1 / dimensions, (BUCKETS, dimensions))
    layer, bias = np.zeros((dimensions, k)), np.zeros(k)
    prepared = []
    for text, label in examples:
        bucket, count = np.unique(subwords(np.frombuffer(letters(text), np.uint8))[0], return_counts=True)
        if len(bucket):
            prepared.append((bucket, count / count.sum(), label))
    steps, done = max(1, epochs * len(prepared)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(prepared)):
            bucket, share, label = prepared[i]
            step = rate * (1 - done / steps)
            rows = embedding[bucket]
            mean = share @ rows
            error = softmax(mean @ layer + bias)
            error[label] -= 1
            back = layer @ error
            layer -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            embedding[bucket] = rows - step * np.outer(share * len(share), back)
            done += 1
    model = LanguageModel(languages, (embedding @ layer).astype(np.float32), bias, 1.0, 0.0)
    rows = [(t, c) for t, c in apart if has_letter(t)]
    if rows:
        logits, classes = raw_scores([letters(t) for t, _ in rows], model), np.array([c for _, c in rows])
        grid = np.geomspace(0.05, 20, 120)
        losses = [
            -np.log(softmax(logits / t)[np.arange(len(rows)), classes] + 1e-12).mean() for t in grid
        ]
        model.temperature = float(grid[int(np.argmin(losses))])
        shares = softmax(logits / model.temperature)
        right = shares.max(axis=1)[shares.argmax(axis=1) == classes]
        if len(right):
            model.threshold = float(min(0.5, np.quantile(right, reject)))
    return model


def raw_scores(texts: list[bytes], model: LanguageModel) -> np.ndarray:
    """Mean subword score per text and class, in blocks of bounded size."""
    k = len(model.languages)
    sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts))
    for first, last in text_blocks(texts, BLOCK):
        joined = b" ".join(texts[first:last])
        starts = starts_of(np.array([len(t) + 1 for t in texts[first:last]]))
        for at in range(0, len(joined), BLOCK):
            data = np.frombuffer(joined[at : at + BLOCK + max(SIZES) - 1], np.uint8)
            bucket, place = subwords(data)
            inside = place < BLOCK
            bucket, place = bucket[inside], place[inside]
            owner = first + np.searchsorted(starts, place + at, side="right") - 1
            counts += np.bincount(owner, minlength=len(texts))
            for c in range(k):
                sums[:, c] += np.bincount(owner, model.weights[bucket, c], minlength=len(texts))
    return sums / np.maximum(counts, 1)[:, None] + model.bias


def fit(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 1500,
) -> LanguageModel:
    """Learn from the rows where ``learn`` holds and text and language are not null.

    About ``per_language`` rows of each language, chosen by a hash of the id (all, if fewer), give
    one fragment of each length in ``FRAGMENTS`` from a place that the hash chooses; so at most
    some megabytes reach the driver, however large the table or a text is. Without rows to learn
    from, the model knows no language.
    """
    text = F.col(text_col).cast("string")
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & text.isNotNull())
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30))
    share = F.create_map(
        *[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"]))]
    )
    chosen = rows.filter(draw < share[F.col(lang_col).cast("string")] * float(1 << 30))
    pieces = [
        F.substring(text, (F.pmod(F.xxhash64(F.lit(n), F.col(id_col)),
                                  F.greatest(F.length(text) - n, F.lit(1))) + 1).cast("int"), F.lit(n))
        for n in FRAGMENTS
    ]
    sample = sorted(
        (r[0], r[1], *r[2])
        for r in chosen.select(draw, F.col(lang_col).cast("string"), F.array(*pieces)).collect()
    )
    index = {name: i for i, name in enumerate(languages)}
    examples = [(t, index[r[1]]) for i, r in enumerate(sample) if i % 5 for t in r[2:]]
    apart = [(t, index[r[1]]) for i, r in enumerate(sample) if i % 5 == 0 for t in r[2:]]
    return train(examples, apart, languages)


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("rejected", T.BooleanType())])


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to every row, from its whole text.

    ``und`` with score 0, rejected, if the text is null, empty or has no letter. Else the likeliest
    language (ties: the first by name), its calibrated probability, and whether that is below the
    model's threshold. Equal texts have equal results. Columns of these names are replaced, all
    others stay; an empty table stays empty.
    """

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return tidied(judged(batches))

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = np.array([has_letter(t) for t in texts], dtype=bool) & bool(model.languages)
            names = np.full(len(texts), UNKNOWN, dtype=object)
            best = np.zeros(len(texts))
            if known.any():
                some = texts[known]
                logits = [
                    raw_scores([letters(t) for t in some.iloc[at : at + TEXTS]], model)
                    for at in range(0, len(some), TEXTS)
                ]
                shares = softmax(np.concatenate(logits) / model.temperature)
                names[known] = np.array(model.languages, dtype=object)[shares.argmax(axis=1)]
                best[known] = shares.max(axis=1)
            yield pd.DataFrame(
                {"lang_pred": names, "score": best, "rejected": ~known | (best < model.threshold)}
            )

    result = score(F.col(text_col).cast("string"))
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in RESULT}]
    box = fresh(docs.columns, "__language")
    return docs.withColumn(box, result).select(*[F.col(f"`{c}`") for c in kept], f"{box}.*")
