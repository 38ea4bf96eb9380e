"""Session set-up and the shared folder used to cut long lineages."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "tablewright") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABLEWRIGHT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in ``spark.checkpoint.dir``.

    Only a session that is one process may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("Name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="tablewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Rows that are worth a task of their own, and the most that one is given.
TASK_ROWS, MOST_TASK_ROWS = 10_000, 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for costly work on ``rows`` rows: all cores once they have enough, more as the rows grow."""
    return max(1, min(rows // TASK_ROWS, spark.sparkContext.defaultParallelism), math.ceil(rows / MOST_TASK_ROWS))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt for costly work on its rows; partitions of a scan or a join follow bytes, not work."""
    n = tasks_for(df.sparkSession, rows)
    return df.repartition(n) if n > 1 else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder that all executors share and read it back.

    The folder is the one named in ``spark.checkpoint.dir``.  Without one, a session of one
    process takes a temporary folder; on a cluster the plan is returned uncut, so that no
    machine-local folder is ever used there.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and context.master.split("[")[0] != "local":
            return df
        context.setCheckpointDir(configured or shared_scratch(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder: each reader scans the columns it wants.

    For a costly source (a shuffle of all rows) of many runs.  On a cluster without
    ``spark.checkpoint.dir`` the plan is returned as it is.
    """
    spark = df.sparkSession
    try:
        path = f"{shared_scratch(spark)}/table-{uuid.uuid4().hex}"
    except ValueError:
        return df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
