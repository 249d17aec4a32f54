"""Removing repeated passages by suffix order and longest previous factors.

Every string of ``length`` bytes belongs to the bucket of the least hash among its runs of
``GRAM`` bytes, so all places where a string starts share a bucket, and neighbouring starts mostly
do too: a text becomes a few stretches, each some consecutive starts of one bucket. Stretches equal
as a whole repeat as a whole. Where a bucket holds different stretches, the suffixes of one copy of
each are sorted to the depth ``length``. In that order, with ties by place, the previous smaller
place of a suffix stands just before it if and only if the longest previous factor has at least
``length`` bytes, so the later places of a string are told from its first.

Only narrow rows move; texts are stored once by document, and the bytes of stretches are fetched
only for buckets in question. A bucket too large for one task is resolved by hashes of its strings.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evlake.llm.common import fresh, per_process, starts_of, text_blocks, tidied
from evlake.session import cut_lineage, shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 16
# Starts of one stretch at most; bytes of text looked at together, of suffixes sorted together, and
# of a bucket that one task may sort.
STRETCH = 256
BLOCK = 1 << 19
SORTED = 1 << 19
BUCKET = 8 << 20
BASE = 0x9E3779B97F4A7C15
BASE_BACK = pow(BASE, -1, 1 << 64)


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place, the first as the highest; zeros after the end."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def sliding(values: np.ndarray, width: int, ufunc) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, values[-1], dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = ufunc.accumulate(grid, axis=1).ravel()
    back = ufunc.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, borders: np.ndarray, length: int):
    """Stretches of the texts in ``data``: start, number of starts, bucket, content hash, and
    whether a string may repeat inside. ``borders`` holds the texts' offsets and the end."""
    n = len(data)
    w8 = words_at(data)[: n - 7]
    gram = mixed(w8[: n - GRAM + 1] * np.uint64(BASE) + mixed(w8[GRAM - 8 :]))
    width = length - GRAM + 1
    bucket = sliding(gram, width, np.minimum)
    starts = np.arange(len(bucket))
    owner = np.searchsorted(borders, starts, side="right")
    good = starts + length <= borders[np.minimum(owner, len(borders) - 1)]
    change = np.ones(len(bucket), dtype=bool)
    change[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]) | (good[1:] != good[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(bucket)))
    first, count = first[good[first]], count[good[first]]
    parts = -(-count // STRETCH)
    if (parts > 1).any():
        piece = np.arange(parts.sum()) - np.repeat(starts_of(parts)[:-1], parts)
        first = np.repeat(first, parts) + piece * STRETCH
        count = np.minimum(np.repeat(count, parts) - piece * STRETCH, STRETCH)
    # Equal neighbouring minima at different places: the text has a short period there.
    highest = np.concatenate([np.full(width - 1, 0, np.uint64), bucket, np.full(width - 1, 0, np.uint64)])
    anchors = np.flatnonzero(sliding(highest, width, np.maximum)[: len(gram)] == gram)
    again = anchors[:-1][gram[anchors[1:]] == gram[anchors[:-1]]]
    inside = np.searchsorted(again, first + count + length - GRAM) > np.searchsorted(again, first)
    ups, downs, table = per_process("suffix_powers", lambda: (
        powers(BASE, 2 * BLOCK + 4096), powers(BASE_BACK, 2 * BLOCK + 4096), byte_values()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[data] * ups[:n], out=sums[1:])
    content = mixed((sums[first + count + length - 1] - sums[first]) * downs[first])
    return first, count, bucket[first].view(np.int64), content.view(np.int64), inside


def text_stretches(texts: list[bytes], length: int):
    """The stretches of whole texts: index of the text, then as above, with starts in the text."""
    long_enough = [i for i, t in enumerate(texts) if len(t) >= length]
    for a, b in text_blocks([texts[i] for i in long_enough], BLOCK):
        chosen = long_enough[a:b]
        joined = b"".join(texts[i] for i in chosen)
        borders = starts_of(np.array([len(texts[i]) for i in chosen]))
        step = len(joined) if len(joined) <= 2 * BLOCK else BLOCK
        for at in range(0, len(joined) - length + 1, step):
            data = np.frombuffer(joined[at : at + step + length - 1], np.uint8)
            ends = borders if step == len(joined) else np.array([0, len(data)])
            start, *rest = stretches(data, ends, length)
            text = np.searchsorted(borders, start + at, side="right") - 1
            yield np.array(chosen)[text], start + at - borders[text], *rest


def ranks(high: np.ndarray, low: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of places by (high, low, place), whether each equals the one before, and dense ranks."""
    bits = max(1, int(n).bit_length())
    place = np.arange(len(high), dtype=np.uint64)
    if low is not None and 3 * bits <= 64:
        key = (high.astype(np.uint64) << np.uint64(2 * bits)) | (low.astype(np.uint64) << np.uint64(bits))
        key |= place
        key.sort()
        order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        key >>= np.uint64(bits)
    else:
        key = high if low is None else high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[1:] == key[:-1]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(~same)
    return order, same, rank


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` (ascending) in order to the depth ``length``, ties by place, and
    whether each shares at least ``length`` bytes with the one before it.

    Ranks to a depth of 8 bytes are doubled, as two ranks side by side give the rank to twice the
    depth; the last step overlaps them to reach the length.
    """
    depth, n = 8, len(data)
    _, _, rank = ranks(words_at(data), None, n)
    while 2 * depth <= length:
        beyond = np.zeros(n, dtype=np.int64)
        beyond[: n - depth] = rank[depth:]
        _, _, rank = ranks(rank, beyond, n)
        depth *= 2
    order, same, _ = ranks(rank[starts], rank[starts + length - depth], n)
    return order, same


def repeats(pieces: list[bytes], counts: np.ndarray, copies: np.ndarray, length: int, keep_first: bool) -> np.ndarray:
    """Per start of the pieces, in order of place: whether its string repeats.

    ``copies`` tells how many places a piece stands for. With ``keep_first``, only strings with an
    earlier place repeat: the longest previous factor, from the previous smaller place.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begin = starts_of(np.array([len(p) for p in pieces]))[:-1]
    total = starts_of(counts)
    starts = np.repeat(begin - total[:-1], counts) + np.arange(total[-1])
    order, same = suffix_order(data, starts, length)
    found = np.zeros(len(starts), dtype=bool)
    found[order[same]] = True
    if not keep_first:
        found[order[:-1][same[1:]]] = True
        found |= np.repeat(copies > 1, counts)
    return found


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def stored(docs: DataFrame, key: str) -> DataFrame:
    """The rows with a number each, bucketed by it in the shared folder, so that joins on the
    number do not move the texts again."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    (
        docs.withColumn(key, F.monotonically_increasing_id())
        .repartition(parts, key)
        .write.bucketBy(parts, key)
        .option("path", shared_path(spark, "texts"))
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    return spark.table(name)


def repeated_spans(texts: DataFrame, length: int, keep_first: bool, bucket: int = BUCKET) -> DataFrame:
    """``key, spans`` (list of start, end in bytes) of the documents with something repeated.

    ``texts`` has ``key, doc_id, text``; the first place of a string is that with the smallest
    ``doc_id`` (null last), then the smallest key, then the smallest offset.
    """
    found = "key bigint, doc_id bigint, start bigint, n int, m bigint, c bigint, inner boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc_id = batch.column(0), batch.column(1)
            rows = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            for text, start, count, m, c, inside in text_stretches(rows, length):
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [key.take(at), doc_id.take(at), pa.array(start), pa.array(count.astype(np.int32)),
                     pa.array(m), pa.array(c), pa.array(inside)],
                    names=["key", "doc_id", "start", "n", "m", "c", "inner"],
                )

    def scan_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t or "").encode("utf-8", "replace") for t in batch.column(0).to_pylist()]
            for _, _, count, m, _, inside in text_stretches(rows, length):
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(inside)], names=["m", "inner"])

    asked = (
        texts.select("text").mapInArrow(lambda b: tidied(scan_buckets(b)), "m bigint, inner boolean")
        .groupBy("m").agg(F.count("*").alias("n"), F.max("inner").alias("inner"))
        .filter("n > 1 or inner").select("m")
    )
    hits = cut_lineage(
        texts.select("key", F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda b: tidied(scan(b)), found)
        .join(asked, "m", "left_semi")
    )
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "start")
    kinds = cut_lineage(
        hits.groupBy("m", "c", "n")
        .agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max("inner").alias("inner"))
        .select("m", "c", "n", "copies", "inner", "first.*")
    )
    whole = hits.join(
        kinds.filter("copies > 1").select(
            "m", "c", "n", F.col("key").alias("first_key"), F.col("start").alias("first_start")
        ),
        ["m", "c", "n"],
    )
    if keep_first:
        whole = whole.filter("key <> first_key or start <> first_start")
    end = F.col("start") + F.col("n") + F.lit(length - 1)
    spans = whole.select("key", "start", end.alias("end"))

    per_bucket = kinds.groupBy("m").agg(
        F.count("*").alias("kinds"), F.max("inner").alias("inner"),
        F.sum(F.col("n") + F.lit(length - 1)).alias("bytes"),
    )
    open_ = cut_lineage(
        kinds.drop("inner").join(
            per_bucket.filter("kinds > 1 or inner").select("m", (F.col("bytes") > bucket).alias("large")), "m"
        )
    )
    wanted = open_.groupBy("key").agg(F.collect_list(
        F.struct("start", "n", "m", "copies", "unnamed", "doc_id", "large")).alias("wanted"))
    stretch = "m bigint, key bigint, start bigint, n int, copies bigint, unnamed boolean, doc_id bigint, large boolean, bytes binary"

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["start", "n", "m", "copies", "unnamed", "doc_id", "large"]
        for batch in batches:
            rows, size = [], 0
            for key, text, wanted in zip(batch["key"], batch["text"], batch["wanted"]):
                data = text.encode("utf-8", "replace")
                for w in wanted:
                    piece = data[w["start"] : w["start"] + w["n"] + length - 1]
                    rows.append((key, piece, *[w[x] for x in names]))
                    size += len(piece)
                    if size > 16 * BLOCK:
                        yield frame(rows, names)
                        rows, size = [], 0
            if rows:
                yield frame(rows, names)

    def frame(rows: list, names: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "bytes", *names])
        return out.astype({"doc_id": "Int64"})[[c.split()[0] for c in stretch.split(", ")]]

    fetched = texts.select("key", "text").join(wanted, "key").mapInPandas(lambda b: tidied(fetch(b)), stretch)
    any_large = not open_.filter("large").isEmpty()
    if any_large:
        fetched = cut_lineage(fetched)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            counts = rows["n"].to_numpy().astype(np.int64)
            copies = rows["copies"].to_numpy()
            flags = repeats(list(rows["bytes"]), counts, copies, length, keep_first)
            offsets = starts_of(counts)
            starts, key = rows["start"].to_numpy(), rows["key"].to_numpy()
            # A gap after each piece keeps runs apart.
            spaced = np.zeros(len(flags) + len(counts), dtype=bool)
            spaced[np.arange(len(flags)) + np.repeat(np.arange(len(counts)), counts)] = flags
            a, b = runs(spaced)
            piece = np.searchsorted(offsets + np.arange(len(offsets)), a, side="right") - 1
            base = starts[piece] - offsets[piece] - piece
            return pd.DataFrame({"key": key[piece], "start": a + base, "end": b + base + length})

        for batch in batches:
            while len(batch):
                held.append(batch)
                size += int(batch["n"].sum()) + len(batch) * (length - 1)
                batch = batch.iloc[:0]
            if size > SORTED:
                rows = pd.concat(held, ignore_index=True)
                sizes = starts_of(rows["n"].to_numpy().astype(np.int64) + length - 1)
                m = rows["m"].to_numpy()
                borders = np.append(np.flatnonzero(np.diff(m)) + 1, 0)
                border = borders[:-1].max(initial=0)
                at = 0
                while at < border:
                    cuts = borders[:-1][(borders[:-1] > at) & (borders[:-1] <= border)]
                    fit = cuts[sizes[cuts] - sizes[at] <= SORTED]
                    to = int(fit.max()) if len(fit) else int(cuts.min())
                    yield flush(rows.iloc[at:to])
                    at = to
                held = [rows.iloc[border:]]
                size = int(sizes[-1] - sizes[border])
        if size:
            yield flush(pd.concat(held, ignore_index=True))

    ordered = (
        fetched.filter("not large").repartition("m")
        .sortWithinPartitions("m", "unnamed", "doc_id", "key", "start")
    )
    spans = spans.unionByName(ordered.mapInPandas(lambda b: tidied(compare(b)), "key bigint, start bigint, end bigint"))
    if any_large:
        spans = spans.unionByName(large_spans(fetched.filter("large"), length, keep_first))
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def large_spans(fetched: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Repeated strings of buckets of any size: equal 128-bit hashes, counted map-side."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ups, downs, table = powers(BASE, 4096), powers(BASE_BACK, 4096), byte_values()
        more = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)
        for batch in batches:
            for row in batch.itertuples():
                data = np.frombuffer(row.bytes, np.uint8)
                columns = {}
                for name, values in (("h1", table), ("h2", more)):
                    sums = np.zeros(len(data) + 1, dtype=np.uint64)
                    np.cumsum(values[data] * ups[: len(data)], out=sums[1:])
                    columns[name] = mixed((sums[length:] - sums[:-length]) * downs[: row.n]).view(np.int64)
                doc_id = pd.array([row.doc_id] * row.n, dtype="Int64")
                yield pd.DataFrame({**columns, "unnamed": row.unnamed, "doc_id": doc_id, "key": row.key,
                                    "start": row.start + np.arange(row.n), "copies": row.copies})

    schema = "h1 bigint, h2 bigint, unnamed boolean, doc_id bigint, key bigint, start bigint, copies bigint"
    rows = fetched.mapInPandas(hashes, schema)
    classes = (
        rows.groupBy("h1", "h2")
        .agg(F.sum("copies").alias("all"), F.count("*").alias("kinds"),
             F.min(F.struct("unnamed", "doc_id", "key", "start")).alias("first"))
        .filter("kinds > 1" if keep_first else "all > 1")
    )
    found = rows.join(classes, ["h1", "h2"])
    if keep_first:
        found = found.filter("key <> first.key or start <> first.start")
    return found.select("key", "start", (F.col("start") + length).alias("end"))


def merged(spans, aligned: bytes | None = None) -> list[tuple[int, int]]:
    """Maximal spans. With a text, ends move inward to whole UTF-8 characters."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in ([] if spans is None else spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    if aligned is not None:
        for span in out:
            while span[0] < span[1] and aligned[span[0]] & 0xC0 == 0x80:
                span[0] += 1
            while span[0] < span[1] < len(aligned) and aligned[span[1]] & 0xC0 == 0x80:
                span[1] -= 1
    return [(s, e) for s, e in out if s < e]


def remaining(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    pieces, at = [], 0
    for start, end in spans:
        pieces.append(data[at:start])
        at = end
    return b"".join([*pieces, data[at:]])


def with_spans(docs: DataFrame, id_col: str, text_col: str, length: int, keep_first: bool, bucket: int):
    """The stored rows with their spans (null: none); and the names of the number and the spans."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    key = fresh(docs.columns, "__key")
    box = fresh([*docs.columns, key], "__spans")
    rows = stored(docs, key)
    texts = rows.select(F.col(key).alias("key"), F.col(id_col).alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(texts, length, keep_first, bucket)
    spans = spans.select(F.col("key").alias(key), F.col("spans").alias(box))
    return rows.join(spans, key, "left"), key, box


DIGEST = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                       T.StructField("kept_sha256", T.StringType())])


def repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
    keep_first: bool = False, bucket: int = BUCKET,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    A byte is removed if a string of ``length`` bytes over it also starts anywhere else (with
    ``keep_first``: earlier), in any document, judged on the texts as given. A null text is empty.
    Rows with equal ids or equal texts are different documents. An empty table gives no rows. Rows
    must come in a repeatable order, as from files.
    """
    rows, _, box = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                              "doc_id", "text", length, keep_first, bucket)

    @F.pandas_udf(DIGEST)
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, spans):
            data, gone = (text or "").encode("utf-8", "replace"), merged(found)
            out.append((sum(e - s for s, e in gone), len(gone), hashlib.sha256(remaining(data, gone)).hexdigest()))
        return pd.DataFrame(out, columns=[f.name for f in DIGEST])

    text = F.col("text").cast("string")
    return rows.select(
        "doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        digest(text, F.col(box)).alias("d"),
    ).select("doc_id", "n_bytes", "d.*")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
    length: int = 200, bucket: int = BUCKET,
) -> DataFrame:
    """``docs`` with later copies of passages of at least ``length`` bytes cut out of the texts.

    The first copy of each passage stays, by id. Cuts keep whole characters. A row whose whole text
    is a later copy goes; rows without repeats stay as they are, null and empty texts too.
    ``chars_col`` is set anew where a text changes.
    """
    rows, key, box = with_spans(docs, id_col, text_col, length, True, bucket)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans):
            if text is not None and found is not None:
                data = text.encode("utf-8", "replace")
                text = remaining(data, merged(found, data)).decode("utf-8")
            out.append(text)
        return pd.Series(out, dtype=object)

    kept = fresh([*docs.columns, key, box], "__kept")
    result = rows.withColumn(kept, cut(F.col(text_col).cast("string"), F.col(box)))
    result = result.filter(F.col(box).isNull() | (F.length(kept) > 0))
    columns = {text_col: F.col(kept)}
    if chars_col is not None and chars_col in docs.columns:
        columns[chars_col] = F.when(F.col(box).isNull(), F.col(chars_col)).otherwise(
            F.length(kept).cast(docs.schema[chars_col].dataType))
    return result.withColumns(columns).select(*docs.columns)
