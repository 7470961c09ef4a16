"""Loaders for the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_utc(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Like load, with zone-free timestamps read as UTC instants."""
    df = load(spark, sf_dir, name)
    casts = {
        f.name: F.col(f.name).cast("timestamp")
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


def spread(df: DataFrame) -> DataFrame:
    """The rows in at least four partitions a core, for work that is large for each row: a small file is read as one partition. Larger tables stay as they are."""
    least = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def partitions_for(df: DataFrame, rows: int = 250_000) -> int:
    """A number of partitions that grows with a table, about `rows` rows each, so that a task's memory does not; the count of a parquet table is in its files' ends."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def with_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temporary views for spark.sql."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
