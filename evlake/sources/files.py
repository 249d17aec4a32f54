"""Files of any length as chunk rows, read by byte ranges."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ship the reader with its tasks, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Chunks of one range, which one task reads in order, and bytes that a task reads about.
RUN = 64
TASK_BYTES = 256 << 20


def read_file_chunks(files: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    """``keys, chunk_no, bytes`` of files given by ``path`` and ``length``; an empty file has none.

    Ranges are rows, dealt by file and place over tasks of about ``TASK_BYTES``, in the order of keys
    and places in each; only the sum of the lengths reaches the driver. A file that is shorter than its length by now is an error.
    """
    total = files.agg(F.sum("length")).first()[0] or 0
    n_chunks = F.ceil(F.col("length") / F.lit(chunk))
    firsts = F.sequence(F.lit(0).cast("bigint"), n_chunks.cast("bigint") - 1, F.lit(RUN).cast("bigint"))
    ranges = files.filter(F.col("length") > 0).select(
        *keys, "path", F.col("length").cast("bigint").alias("length"), F.explode(firsts).alias("first")
    )
    dealt = ranges.repartition(int(total // TASK_BYTES) + 1, "path", "first").sortWithinPartitions(*keys, "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lengths, starts = (batch.column(c).to_pylist() for c in ("path", "length", "first"))
            for i, (path, length, first) in enumerate(zip(paths, lengths, starts)):
                with opened(path) as file:
                    file.seek(first * chunk)
                    for number in range(first, min(first + RUN, -(-length // chunk))):
                        size = min(chunk, length - number * chunk)
                        data = file.read(size)
                        if len(data) != size:
                            raise ValueError(f"{path} has changed while it was read")
                        columns = [batch.column(k).slice(i, 1) for k in keys]
                        columns += [pa.array([number], pa.int64()), pa.array([data], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "chunk_no", "bytes"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keys).schema]
    return dealt.mapInArrow(read, ", ".join([*kinds, "chunk_no bigint", "bytes binary"]))


def opened(path: str):
    """A file of any store that Arrow knows, by its address; a plain path is a local file."""
    local = re.fullmatch(r"(?:file:/*)?(?=/|[^:]*$)/*(.*)", path)
    if local:
        return LocalFileSystem().open_input_file("/" + local[1])
    system, inner = FileSystem.from_uri(path)
    return system.open_input_file(inner)
