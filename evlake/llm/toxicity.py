"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive examples; all other texts are unlabelled, toxic ones among
them. With the share of toxic texts known, the risk of a classifier on clean texts is its risk on
unlabelled texts less the part that the positives explain. Where that estimate falls below zero the
model only fits chance, so the step goes the other way. The classifier is linear in the distinct
beginnings of the words of a text and is trained in numpy. Every beginning takes part, by how
surprising its number of positives is; whole texts are learnt from and scored. A text without
evidence is always below the cut.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlake.llm.language import SPACE, letters
from evlake.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 18
# Lengths of word beginnings in bytes; a longer word also counts by its first ten.
SHORTEST, LONGEST = 4, 10
BLOCK = 1 << 18
# The surprise (a log-likelihood ratio) that gives a feature half its weight, and the one that a cut
# must have; the least that counts as any; and the number of positives from which the cut stands in the middle of the equally good
# ones.
EVIDENCE = 20.0
CERTAIN = 20.0
ANY = 2.0
SURE = 10
FOLDS = 5
# Distinct word beginnings are weighed down by the root of their number, in units of this root.
UNIT = 30.0


@dataclass
class ToxicityModel:
    """``weights`` per subword bucket; a text's logit is ``slope * (raw - cut)``."""

    weights: np.ndarray
    cut: float
    slope: float


def beginnings(data: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Hash buckets of the beginnings of the words behind the spaces at ``starts``; the space after
    a word counts as its last byte. ``data`` has ``LONGEST`` bytes or only spaces after a start."""
    value = np.zeros(len(starts), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        byte = data[starts + n]
        value = (value ^ byte.astype(np.uint64)) * np.uint64(0x100000001B3) + np.uint64(n)
        if n >= SHORTEST:
            mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int32)
        going = byte != SPACE
        starts, value = starts[going], value[going]


def distinct(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The distinct buckets of a whole text, in blocks. ``seen`` is all False before and after."""
    raw = letters(text) + b" " * LONGEST
    for at in range(0, len(raw) - LONGEST, BLOCK):
        data = np.frombuffer(raw[at : at + BLOCK + LONGEST], np.uint8)
        blank = data[: len(data) - LONGEST + 1] == SPACE
        for found in beginnings(data, np.flatnonzero(blank[:-1] & ~blank[1:])):
            seen[found] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out.astype(np.int32)


def raw_score(weights: np.ndarray, features: np.ndarray) -> float:
    return float(weights[features].sum() * UNIT / np.sqrt(max(1, len(features))))


def surprise(found: np.ndarray, n: int, share: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of ``found`` out of ``n``, where ``share`` of all were to be expected."""
    expected = share * n
    ratio = np.log(np.maximum(found, 1) / expected)
    return np.where(found > expected, 2 * (found * ratio - (found - expected)), 0)


def trust_of(positive: np.ndarray, unlabelled: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """From 0 to 1 per feature, by the surprise of its count among ``n_p`` positives, given its share
    of ``n_u`` unlabelled texts. What a single positive has, no other text can confirm: 0."""
    found = surprise(positive, n_p, (unlabelled + 1) / (n_u + 2))
    return np.where((positive > 1) & (found > ANY), found**2 / (found**2 + EVIDENCE**2), 0)


@dataclass
class Example:
    """A text's features, their common factor, its fold, and whether it is positive and unlabelled."""

    features: np.ndarray
    unit: float
    fold: int
    positive: bool
    unlabelled: bool


def descend(
    positive: list[Example], unlabelled: list[Example], trust: np.ndarray, prior: float, epochs: int = 8, rate: float = 0.05
) -> np.ndarray:
    """Weights that minimize the non-negative risk; a feature moves, and weighs, by its trust."""
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    if not positive or not unlabelled or not trust.any():
        return weights
    rng = np.random.default_rng(5)
    fit_p, fit_u = ([(x.features, trust[x.features] * x.unit) for x in xs] for xs in (positive, unlabelled))
    steps, bias = max(1, len(fit_u) // 64), -2.0
    for _ in range(epochs):
        turn = rng.permutation(len(fit_u))
        for step in range(steps):
            clean = [fit_u[i] for i in turn[step::steps]]
            toxic = [fit_p[i] for i in rng.integers(0, len(fit_p), 24)]
            z = np.array([weights[f] @ unit for f, unit in toxic + clean]) + bias
            share = 1 / (1 + np.exp(-z))
            loss = np.logaddexp(0, z)
            n = len(toxic)
            if loss[n:].mean() - prior * loss[:n].mean() >= 0:
                slope = np.concatenate([np.full(n, -prior / n), share[n:] / len(clean)])
            else:
                slope = np.concatenate([prior * share[:n] / n, -share[n:] / len(clean)])
            for (f, unit), s in zip(toxic + clean, slope):
                g = s * unit
                squares[f] += g * g
                weights[f] -= rate * g / np.sqrt(squares[f])
            bias -= rate * slope.sum()
    return weights * trust


def train(examples: list[Example], counts: np.ndarray, prior: float) -> ToxicityModel:
    """A model of all examples, with a cut from scores that each got from the other folds.

    ``counts`` has, per kind (positive, unlabelled), fold and feature, the texts that have it. The
    cut minimizes the same risk estimate for the 0-1 loss among the cuts above which positives are
    surprisingly many; of equally good ones a higher one is taken the fewer positives there are.
    Without such a cut every score is 0. The logit is scaled so that the positives are, at their
    middle, at 0.95.
    """
    sizes = np.array([[sum(getattr(x, kind) and x.fold == k for x in examples) for k in range(FOLDS)]
                      for kind in ("positive", "unlabelled")])

    def learnt(without: int | None) -> np.ndarray:
        rest = [x for x in examples if x.fold != without]
        seen, n = counts.sum(axis=1), sizes.sum(axis=1)
        if without is not None:
            seen, n = seen - counts[:, without], n - sizes[:, without]
        trust = trust_of(seen[0], seen[1], *n) if n.all() else np.zeros(1 << BITS)
        return descend([x for x in rest if x.positive], [x for x in rest if x.unlabelled], trust, prior)

    none = ToxicityModel(np.zeros(1 << BITS, np.float32), np.inf, 1.0)
    if not sizes.sum(axis=1).all() or prior <= 0:
        return none
    scores: tuple[list[float], list[float]] = ([], [])
    for k in range(FOLDS):
        weights = learnt(k)
        for x in (x for x in examples if x.fold == k):
            score = float(weights[x.features].sum() * x.unit)
            for held, wanted in zip(scores, (x.positive, x.unlabelled)):
                if wanted:
                    held.append(score)
    p, u = map(np.sort, scores)
    cuts = np.unique(np.concatenate([p, u]))
    cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, cuts])
    # A text without evidence scores 0, below every cut.
    cuts = cuts[cuts > 1e-3]
    caught = len(p) - np.searchsorted(p, cuts)
    called = (len(u) - np.searchsorted(u, cuts) + 1) / (len(u) + 2)
    certain = (caught > 1) & (surprise(caught, len(p), called) > CERTAIN)
    if not certain.any():
        return none
    missed = 1 - caught[certain] / len(p)
    risk = prior * missed + np.maximum(0, called[certain] - prior * (1 - missed))
    best = cuts[certain][risk <= risk.min() + 1e-12]
    cut = float(np.quantile(best, 1 - 0.5 * len(p) / (len(p) + SURE)))
    return ToxicityModel(learnt(None).astype(np.float32), cut, 3.0 / max(float(np.median(p)) - cut, 0.1))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    positives: int = 2000,
    unlabelled: int = 6000,
) -> ToxicityModel:
    """Learn from the rows of both tables where ``learn``, on the id, holds.

    About ``positives`` rows labelled 1 and ``unlabelled`` rows of ``docs``, chosen by a hash of the
    id (all, if fewer), are learnt from, with their whole texts. Features are taken in the tasks: the
    driver gets counts of those that two positives have, at most one row for each fold and each of
    2^18 buckets, and then per chosen text those that have any trust. The prior is the share of ones
    among the labels. Null labels, ids and texts are passed over. Without positives, or where they
    have nothing in common that others lack, every score is 0.
    """
    draw = F.pmod(F.xxhash64(F.lit("toxic"), F.col(id_col)), F.lit(1 << 30))
    marks = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    seen, ones = marks.agg(F.count("*"), F.coalesce(F.sum((F.col(label_col) == 1).cast("int")), F.lit(0))).first()
    counts = np.zeros((2, FOLDS, 1 << BITS), np.int32)
    if not ones:
        return train([], counts, 0.0)
    chosen = marks.filter((F.col(label_col) == 1) & (draw < min(1.0, positives / ones) * float(1 << 30)))
    toxic = {r[0] for r in chosen.select(id_col).collect()}
    rows = docs.filter(learn & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    some = draw < min(1.0, unlabelled / max(1, rows.select(id_col).count())) * float(1 << 30)

    @F.pandas_udf("array<int>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = np.zeros(1 << BITS, dtype=bool)
        for texts in batches:
            yield pd.Series([distinct(t, flags) for t in texts])

    is_toxic = F.col(id_col).isin(list(toxic))
    sample = cut_lineage(
        rows.filter(some | is_toxic).select(
            F.col(id_col).alias("id"), some.cast("int").alias("u"), is_toxic.cast("int").alias("p"),
            F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(FOLDS)).cast("int").alias("fold"),
            features(F.col(text_col).cast("string")).alias("f"),
        )
    )
    seen_in = sample.select(F.explode("f").alias("f"), "fold", "p", "u").groupBy("f", "fold").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u")
    )
    common = seen_in.groupBy("f").agg(F.sum("p").alias("all")).filter("all > 1").select("f")

    def packed(rows: pa.Table) -> pa.Table:
        numbers = np.stack([rows.column(c).to_numpy() for c in ("f", "fold", "p", "u")], axis=1)
        return pa.table({"numbers": pa.array([numbers.astype("<i4").tobytes()], pa.binary())})

    found = seen_in.join(common, "f").groupBy(F.col("f") % 16).applyInArrow(packed, "numbers binary")
    for r in found.collect():
        f, fold, p, u = np.frombuffer(r.numbers, "<i4").reshape(-1, 4).T
        counts[0, fold, f], counts[1, fold, f] = p, u
    # Features that all examples, or those outside one of the folds, trust.
    kept = np.zeros(1 << BITS, dtype=bool)
    sizes = sample.groupBy().agg(*[F.coalesce(F.sum(F.col(k) * (F.col("fold") != f).cast("int")), F.lit(0))
                                   for f in [*range(FOLDS), -1] for k in "pu"]).first()
    for i, f in enumerate([*range(FOLDS), None]):
        rest = counts.sum(axis=1) - (0 if f is None else counts[:, f])
        if sizes[2 * i] and sizes[2 * i + 1]:
            kept |= trust_of(rest[0], rest[1], sizes[2 * i], sizes[2 * i + 1]) > 0

    @F.pandas_udf("binary")
    def trusted(found: pd.Series) -> pd.Series:
        return found.map(lambda f: f[kept[f]].astype("<i4").tobytes())

    part = sample.select("id", "p", "u", "fold", F.size("f").alias("n"), trusted("f").alias("f"))
    examples = [
        Example(np.frombuffer(r.f, "<i4"), UNIT / np.sqrt(max(1, r.n)), r.fold, bool(r.p), bool(r.u))
        for r in part.orderBy("id").collect()
    ]
    return train(examples, counts, ones / seen)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """Add the score of each whole text, from 0 to 1; 0.5 is the cut. A null text is empty, and
    equal texts have equal scores. All other columns and rows stay as they are."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = np.zeros(1 << BITS, dtype=bool)
        for texts in batches:
            raw = np.array([raw_score(model.weights, distinct(t, flags)) for t in texts])
            logit = np.clip(model.slope * (raw - model.cut), -700, 700)
            yield pd.Series(np.where(np.isinf(model.cut), 0.0, 1 / (1 + np.exp(-logit))))

    return docs.withColumn(name, scores(F.col(text_col).cast("string")))
