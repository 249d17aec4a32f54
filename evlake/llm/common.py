"""Helpers shared by the operators: Arrow batches, text blocks, per-process values."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlake.session import cut_lineage

# Ship these helpers with their tasks, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The separators of words: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most so many rows travel to Python together. For jobs over whole texts: the default of
    10,000 rows times the mean length of a text is held several times over in every task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def fresh(columns: list[str], name: str) -> str:
    """A column name that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def seated(df: DataFrame, name: str) -> DataFrame:
    """Add a number per row, fixed once by writing the rows to the shared folder.

    Ids of a table may be null or repeat; this number tells every row from every other.
    """
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def remainder_of(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def held_out_rows(doc_id: Column, divisor: int, remainder: int) -> Column:
    """Whether the row is held out from learning; a row without id is not, nor is it learnt from."""
    return F.coalesce(remainder_of(doc_id, divisor) == remainder, F.lit(False))


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """A value made once per Python worker. Shipped helpers are rebuilt for each task, so their own
    globals don't last."""
    holder = sys.modules.setdefault("evlake_worker_values", types.ModuleType("evlake_worker_values"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def tidied(batches: Iterator) -> Iterator:
    """The same batches; after the last, memory that a task has freed goes back to the machine. A
    Python worker outlives its tasks and would keep it."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_blocks(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of texts of about ``limit`` bytes together; a longer text is alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive pieces, with the end as the last entry."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
