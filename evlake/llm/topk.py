"""Exact top-k search by a three-phase uniform threshold.

A vector is cut into slices, and a slice of it gives one local score list per query. First, the
heads of the local lists are gathered and scored in full; the k-th best of them is a safe cutoff.
Second, every slice gives the entries at or above the cutoff divided by the number of slices: a
total that reaches the cutoff has a slice that does. Third, the scores of those entries are
completed exactly, and the best k stay. Rows travel as blocks of vectors; a query block meets every
block once, by an equality join on block numbers, and a task holds one pair of blocks at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evlake.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096
QUERIES = 1024
SLICES = 2
TOGETHER = 8
EXACT = float(1 << 53)
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def matrix(values: bytes, rows: int, size: int) -> np.ndarray:
    """A block's integers, a row per vector, from ``size`` bytes each."""
    whole = np.frombuffer(values, f"<i{size}").astype(np.int64)
    return whole.reshape(rows, -1) if values else np.zeros((rows, 0), np.int64)


def narrow(values: np.ndarray) -> int:
    """The fewest bytes that hold every integer."""
    low, high = values.min(initial=0), values.max(initial=0)
    return next(n for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact as long as they fit in 64 bits. A shorter vector counts
    as filled up with zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if top < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def heads(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest entries of each row, in no order."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def slices_of(width: int, count: int) -> list[tuple[int, int]]:
    cuts = [width * i // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best entries per query: high scores, then small ids."""
    order = np.lexsort((vec, -score, query))
    sorted_query = query[order]
    first = np.concatenate([[True], sorted_query[1:] != sorted_query[:-1]])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[place < k]


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """``block, n, ids, vecs, wide``: the rows of each task in blocks of at most ``size``, their
    integers in as many bytes as the largest needs."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        held: list[pd.DataFrame] = []
        count = number = 0
        for batch in batches:
            for at in range(0, len(batch), size):
                held.append(batch.iloc[at : at + size])
                count += len(held[-1])
                while count >= size:
                    frame = pd.concat(held, ignore_index=True)
                    yield block(first + number, frame.iloc[:size])
                    number, held, count = number + 1, [frame.iloc[size:]], count - size
        if count:
            yield block(first + number, pd.concat(held, ignore_index=True))

    def block(number: int, frame: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, frame["vec"]), default=0)
        out = np.zeros((len(frame), width), dtype=np.int64)
        for i, vec in enumerate(frame["vec"]):
            out[i, : len(vec)] = vec
        wide = narrow(out)
        return pd.DataFrame({
            "block": [number], "n": [len(frame)], "ids": [frame["id"].to_numpy(np.int64).tobytes()],
            "vecs": [out.astype(f"<i{wide}").tobytes()], "wide": [wide],
        })

    return rows.mapInPandas(pack, "block bigint, n int, ids binary, vecs binary, wide int")


def search(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: int = 64, slices: int = SLICES, block: int = BLOCK, query_block: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest scores of every row where ``queries`` holds.

    Components become floor(scale * x), x as double; the score is the integer inner product. A
    query's own id is no candidate; ties go to the smaller id. Vectors that are null or hold a null
    or non-finite component, and rows without an id, take no part. A shorter vector counts as
    filled up with zeros. Rows that repeat an id are candidates of their own, as queries they are
    one. Other columns are not read; an empty table gives no rows.
    """
    component = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    clean = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    rows = clean.select(F.col(id_col).cast("bigint").alias("id"), component.alias("vec"))
    asked = clean.filter(queries).select(F.col(id_col).cast("bigint").alias("id"), component.alias("vec"))
    left = cut_lineage(numbered(blocks(asked.dropDuplicates(["id"]), query_block)))
    right = cut_lineage(blocks(rows, block))
    count = left.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], RESULT)
    # Query blocks repeat for every ``TOGETHER`` blocks of candidates, so that no join key has more.
    spread = -(-right.count() // TOGETHER)
    asking = left.select(
        "q", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("lot"), F.col("n").alias("q_n"),
        F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("wide").alias("q_wide"),
    )
    pairs = (
        right.withColumn("lot", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        .join(asking, ["q", "lot"])
    )
    found = "query_id bigint, vec_id bigint, score bigint"

    def sides(row: dict):
        return (np.frombuffer(row["q_ids"], np.int64), matrix(row["q_vecs"], row["q_n"], row["q_wide"]),
                np.frombuffer(row["ids"], np.int64), matrix(row["vecs"], row["n"], row["wide"]))

    def output(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q, ids, v = sides(row)
                columns = [
                    heads(products(q[:, a:b], v[:, a:b]), k + 1)
                    for a, b in slices_of(max(q.shape[1], v.shape[1]), slices)
                ]
                at = np.unique(np.concatenate(
                    [c + np.arange(len(q))[:, None] * len(v) for c in columns], axis=1).ravel())
                i, j = np.divmod(at, len(v))
                keep = q_ids[i] != ids[j]
                i, j = i[keep], j[keep]
                score = paired(q, v, i, j)
                top = best(q_ids[i], score, ids[j], k)
                yield output(q_ids[i][top], ids[j][top], score[top])

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # The k-th best of the gathered entries, as a pair of score and id; without one, no cutoff.
    cutoffs = cut_lineage(
        pairs.mapInArrow(gather, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
        .select(F.col("query_id").alias("cut_id"), F.col("score").alias("cut_score"), F.col("vec_id").alias("cut_vec"))
    )
    # The cutoffs of a block's queries go with the block.
    ids = left.select("q", "ids", "n").mapInPandas(
        lambda frames: (pd.DataFrame({"q": q, "query_id": np.frombuffer(i, np.int64)})
                        for f in frames for q, i in zip(f["q"], f["ids"])), "q int, query_id bigint")
    per_block = ids.join(cutoffs, F.col("query_id") == F.col("cut_id"), "left").groupBy("q").agg(
        F.collect_list(F.struct("query_id", "cut_score", "cut_vec")).alias("cuts"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = np.iinfo(np.int64).min
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q, ids, v = sides(row)
                known = {c["query_id"]: c for c in row["cuts"] if c["cut_score"] is not None}
                cut = np.array([known[x]["cut_score"] if x in known else lowest for x in q_ids.tolist()])
                last = np.array([known[x]["cut_vec"] if x in known else 0 for x in q_ids.tolist()])
                enough = np.zeros((len(q), len(v)), dtype=bool)
                for a, b in slices_of(max(q.shape[1], v.shape[1]), slices):
                    part = products(q[:, a:b], v[:, a:b])
                    enough |= part >= -(-cut // slices)[:, None]
                enough |= (cut == lowest)[:, None]
                i, j = np.nonzero(enough & (q_ids[:, None] != ids[None, :]))
                for first in range(0, len(i), 1 << 19):
                    ii, jj = i[first : first + (1 << 19)], j[first : first + (1 << 19)]
                    score = paired(q, v, ii, jj)
                    keep = (score > cut[ii]) | ((score == cut[ii]) & (ids[jj] <= last[ii])) | (cut[ii] == lowest)
                    ii, jj, score = ii[keep], jj[keep], score[keep]
                    if len(ii):
                        top = best(q_ids[ii], score, ids[jj], k)
                        yield output(q_ids[ii][top], ids[jj][top], score[top])

    return (
        pairs.join(per_block, "q").mapInArrow(resolve, found)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def paired(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs (i, j), in parts of bounded size."""
    width = min(q.shape[1], v.shape[1])
    out = np.zeros(len(i), dtype=np.int64)
    for at in range(0, len(i), 1 << 16):
        a, b = q[i[at : at + (1 << 16)], :width], v[j[at : at + (1 << 16)], :width]
        out[at : at + len(a)] = np.einsum("ij,ij->i", a, b)
    return out


def numbered(left: DataFrame) -> DataFrame:
    """Query blocks numbered from zero. The window holds one number per block, without vectors."""
    left = cut_lineage(left)
    place = left.select("block", (F.row_number().over(W.orderBy("block")) - 1).alias("q"))
    return left.join(place, "block")

