"""URL rules by a cascade of Bloom filters, on Spark's own functions only.

A rule is a host and the beginning of a path; it fits its host and all subdomains. The keys that a
URL could be listed under are few: its last labels, as many as some rule has, each with the
beginnings of its path, as long as some rule's. The cascade tells listed keys from all other keys
of the corpus without error: the first level encodes the listed keys, the second the keys of the
corpus that wrongly pass the first, the third the listed keys that wrongly pass the second, and so
on until none is left. Levels are sized so that each stays in proportion to the list, times the
logarithm of the corpus, and applying them takes no join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlake.llm.common import fresh
from evlake.session import cut_lineage

HASHES = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    """A Bloom filter: 64-bit words, their number of bits, and the hashes of a key."""

    words: list[int]
    bits: int
    hashes: int


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to a slash, question mark, number sign or the end."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host to a question mark, number sign or the end."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise(F.lit(""))


def candidates(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """The keys that a URL could be listed under: hosts of so many labels, paths of so many
    characters; shorter hosts and paths have none of that size."""
    keys = []
    for n in labels:
        tail = F.substring_index(host, ".", -n)
        there = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1 >= n
        for size in lengths:
            key = F.concat(tail, F.substring(path, 1, size))
            keys.append(F.when(there & (F.length(path) >= size), key))
    return F.array_compact(F.array(*keys))


def spots(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """The bits of a key, by double hashing."""
    mask = F.lit((1 << 48) - 1)
    first = F.xxhash64(F.lit(2 * level), key).bitwiseAND(mask)
    step = F.xxhash64(F.lit(2 * level + 1), key).bitwiseAND(mask).bitwiseOR(F.lit(1).cast("bigint"))
    return [(first + step * i) % bits for i in range(hashes)]


def encoded(keys: DataFrame, level: int, count: int, false_rate: float) -> Level:
    """A filter of the ``count`` keys in column ``key``. Bits of equal words are joined map-side;
    the words come back as one array, as long as ``count`` times ``log2(1 / false_rate)`` asks."""
    hashes = max(1, min(HASHES, math.ceil(-math.log2(false_rate))))
    bits = max(64, 64 * math.ceil(count * hashes / math.log(2) / 64))
    at = keys.select(F.explode(F.array(*spots(F.col("key"), level, bits, hashes))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("bits")
    )
    filled = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    array = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(bits // 64 - 1).cast("bigint")),
        lambda w: F.coalesce(F.try_element_at(F.col("m"), w), F.lit(0).cast("bigint")),
    )
    return Level(filled.select(array.alias("a")).first()["a"], bits, hashes)


def passes(key: Column, number: int, level: Level) -> Column:
    words = F.array(*[F.lit(w).cast("bigint") for w in level.words])
    tests = [
        F.call_function("shiftrightunsigned", F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int"))
        .bitwiseAND(F.lit(1).cast("bigint")) == 1
        for at in spots(key, number, level.bits, level.hashes)
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def cascade(universe: DataFrame) -> list[Level]:
    """Levels for a table of ``key, listed`` with every key once.

    With r keys listed and s others, the first level lets about r of the others pass, and each
    later level half of what it is asked; so r and log(s) bound every level.
    """
    left = {True: universe.filter("listed").select("key"), False: universe.filter("not listed").select("key")}
    counts = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    levels: list[Level] = []
    inside = True
    while counts.get(inside, 0):
        rate = 0.5
        if not levels:
            rate = min(0.5, counts[inside] / max(1, counts.get(not inside, 0)))
        level = encoded(left[inside], len(levels), counts[inside], rate)
        left[not inside] = left[not inside].filter(passes(F.col("key"), len(levels), level))
        counts[not inside] = left[not inside].count()
        levels.append(level)
        inside = not inside
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the first level that it fails tells."""
    result = F.lit(len(levels) % 2 == 1)
    for number in reversed(range(len(levels))):
        result = F.when(passes(key, number, levels[number]), result).otherwise(F.lit(number % 2 == 1))
    return result


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row.

    ``rules`` are (host, beginning of the path, verdict); the longest that fits decides (ties: the
    first in the alphabet), a URL under none gets ``default`` and a null rule. A null URL or one
    without ``://`` has an empty host and path. Columns of these names are replaced, others stay.
    The list is a parameter and goes into the plan, so its size is known; the corpus only decides
    how many bits a listed key takes.
    """
    verdicts = {h.translate(str.maketrans(UPPER, LOWER)) + p: v for h, p, v in rules}
    labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    url = F.col(url_col).cast("string")
    host, path = F.coalesce(host_of(url), F.lit("")), F.coalesce(path_of(url), F.lit(""))
    box = fresh(pages.columns, "__keys")
    if not rules:
        found, levels = F.lit(None).cast("string"), []
    else:
        spark = pages.sparkSession
        listed = spark.createDataFrame([(k, True) for k in verdicts], "key string, listed boolean")
        corpus = pages.select(F.explode(candidates(host, path, labels, lengths)).alias("key"))
        universe = cut_lineage(
            corpus.withColumn("listed", F.lit(False)).unionByName(listed)
            .groupBy("key").agg(F.max("listed").alias("listed"))
        )
        levels = cascade(universe)
        hits = F.filter(F.col(box), lambda k: member(k, levels))
        ranked = F.array_sort(hits, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
                              .when(a < b, -1).when(a > b, 1).otherwise(0))
        found = F.get(ranked, F.lit(0))
    verdict = F.lit(default)
    if verdicts:
        table = F.create_map(*[F.lit(x) for pair in verdicts.items() for x in pair])
        verdict = F.coalesce(F.try_element_at(table, F.col("rule")), F.lit(default))
    named = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    keys = candidates(F.col("host"), F.col("path"), labels, lengths) if rules else F.array().cast("array<string>")
    return (
        named.withColumn(box, keys).withColumn("rule", found).withColumn("verdict", verdict)
        .select(*kept, "host", "path", "rule", "verdict")
    )
