"""Steps of jobs as tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all run on one machine, a temporary one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


#: Rows that one task sorts and holds, however many there are and whatever the session's shuffle partitions.
TASK_ROWS = 100_000


def parts(spark: SparkSession, rows: int) -> int:
    """So many partitions that one has about TASK_ROWS of ``rows``; at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` partitioned by ``key``, in so many partitions that one has about TASK_ROWS of its ``rows``; at least one a core. What is
    grouped by ``key`` after it, alone or with more columns, is not shuffled again."""
    return df.repartition(parts(df.sparkSession, rows), key)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in :func:`shared_dir`."""
    path = f"{shared_dir(df.sparkSession)}/spanflow-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
