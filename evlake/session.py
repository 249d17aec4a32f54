"""Session settings for local runs, and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", app: str = "evlake") -> SparkSession:
    """A local session for tests and the bench. On a cluster, use the cluster's own session."""
    partitions = str(cpus) if str(cpus).isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Call sites of every column expression cost more than small queries themselves.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        # The driver and the executors of a local session share one disk.
        context.setCheckpointDir(tempfile.mkdtemp(prefix="evlake-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    # A folder of one machine would be incomplete or unreadable on the others.
    raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this application's own.

    The folder can be removed when the application has ended.
    """
    own = f"evlake-{spark.sparkContext.applicationId}"
    return os.path.join(shared_folder(spark), own, f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared folder and read them back.

    Later reads all see the same rows, prune columns, know the size for join planning, and survive
    the loss of any executor. `DataFrame.checkpoint` would compute the rows twice.
    """
    spark = df.sparkSession
    path = shared_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
