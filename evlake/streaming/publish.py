"""Publishing capture batches from a stream, with one effect per capture id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlake.session import cut_lineage
from evlake.sources.lake import SEQ, Lake


def publish_stream(
    captures: DataFrame,
    lake: Lake,
    checkpoint: str,
    available_now: bool = True,
    first_seq: int = 0,
) -> None:
    """Append new captures of a stream to the lake, batch by batch.

    A batch keeps one row per id and drops ids that other batches already hold; of these it opens
    only those whose filter may have one of its ids. It writes its own partition and commits last, so replays and repeated ids are no-ops. Batches are numbered
    from ``first_seq``; writers of one lake need ranges that do not meet.
    """

    def write(rows: DataFrame, batch: int) -> None:
        seq = first_seq + batch
        if lake.is_committed(seq):
            return
        # Both reads below must see the same choice among repeated ids.
        fresh = cut_lineage(rows.dropDuplicates(["capture_id"]))
        known = lake.batches_with(fresh)
        if known is not None:
            held = known.filter(F.col(SEQ) != seq).select("capture_id")
            fresh = fresh.join(held, "capture_id", "left_anti")
        # Both tables below must come from the same choice among repeated ids.
        fresh = cut_lineage(fresh)
        pointers = fresh.select(
            F.col("analysis.request_key").alias("request_key"),
            F.col("analysis.token").alias("token"),
            "capture_id",
            "completed_at_unix_ms",
        )
        lake.write({"candidates": pointers, "captures": fresh}, seq)

    writer = captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    query.awaitTermination()
