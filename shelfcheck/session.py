"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "shelfcheck") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster, pass the cluster's own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # Pages and listings cost much work per byte, so a few hundred kilobytes are worth a task of their own.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SHELFCHECK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Building a plan of many columns is much quicker without a stack trace for each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


CHECKPOINT = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session, else the checkpoint folder of its
    context. Only where neither is set and Spark runs in this process alone, as in tests, one is made and set."""
    folder = spark.conf.get(CHECKPOINT, None)
    if not folder:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError(f"set {CHECKPOINT} to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfcheck-"))
            known = context._jsc.sc().getCheckpointDir()
        folder = known.get()
    return folder.rstrip("/")


def kept_table(rows: DataFrame, name: str) -> DataFrame:
    """`rows` as a Parquet table of its own in the shared folder: what reads it several times doesn't compute it again, and a
    lost executor costs its tasks only."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
