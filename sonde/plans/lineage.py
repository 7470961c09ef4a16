"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting for deleting the shuffle files of a job when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a few numbers each that one task takes easily; see packed().
TASK_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sonde-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back: later uses neither recompute it nor depend on executors' disks.

    The shuffle files of the write go when it is done; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def release(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for these frames, once nothing that is still to run reads them; frames it did not write are left alone."""
    for df in frames:
        path = df.__dict__.pop("_written_to", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def packed(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """df, a table of `rows` short rows, in no more partitions than `each` rows a task call for.

    What fits one task is then grouped and joined there without a shuffle, however many shuffle partitions are set; more rows
    get more tasks in proportion, and are shuffled.
    """
    fewer = df.coalesce(max(1, math.ceil(rows / each)))
    fewer._written_to = df.__dict__.get("_written_to")  # release() takes either frame
    return fewer
