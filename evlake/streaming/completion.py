"""Build completion over a live message stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evlake.session import shared_path


def latest_rows(
    spark: SparkSession, path: str, keys: Sequence[str], schema: StructType | None = None
) -> DataFrame:
    """Current row per key of a change log: the one of the highest batch.

    With the ``schema`` of its rows, a log that has no batch yet gives no rows.
    """
    try:
        log = spark.read.parquet(path)
    except AnalysisException as error:
        if schema is None or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    values = [c for c in log.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), F.col("batch"))
    return log.groupBy(*keys).agg(newest.alias("__row")).select(*keys, "__row.*")


def run_to_log(
    aggregate: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> None:
    """Run a streaming aggregate in update mode into a change log.

    A batch owns its partition, so a replayed batch replaces its own rows.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = (
        aggregate.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    query.awaitTermination()


def completion_stream(
    stream: DataFrame, keys: Sequence[str], outcome: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Feed the stream's available input through ``outcome`` and return the current row per key.

    State is one small row of counts per build, kept by Spark in its state store.
    """
    spark = stream.sparkSession
    log, checkpoint = shared_path(spark, "completion-log"), shared_path(spark, "completion-state")
    rows = outcome(stream)
    run_to_log(rows, log, checkpoint)
    return latest_rows(spark, log, keys, rows.schema)
