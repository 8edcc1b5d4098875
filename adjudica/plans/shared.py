"""Tables in the folder that driver and executors share, and how many tasks a table is dealt to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all run in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="adjudica-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/adjudica-{spark.sparkContext.applicationId}"


#: Rows of a table that one task sorts, joins or windows, about; more rows mean more tasks.
TASK_ROWS = 400_000


def parts(spark: SparkSession, rows: int) -> int | None:
    """The number of partitions for so many rows, the session's own at least, or None where those do. Adaptive execution joins the
    session's partitions down to one for each core, whatever their rows; it leaves a stated number alone."""
    n, own = -(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))
    joins = all(spark.conf.get(f"spark.sql.adaptive.{x}enabled", "true") == "true" for x in ("", "coalescePartitions."))
    return max(n, own) if n > (min(own, spark.sparkContext.defaultParallelism) if joins else own) else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df in n partitions by its keys; as it is where n is None."""
    return df.repartition(n, *keys) if n else df


def store(df: DataFrame, what: str) -> DataFrame:
    """Writes df and reads it back."""
    path = f"{folder(df.sparkSession)}/core/{what}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(df.sparkSession))
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # scratch goes with the driver's JVM
    return df.sparkSession.read.schema(df.schema).parquet(path)
