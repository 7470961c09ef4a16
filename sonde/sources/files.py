"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.operators.records import sniffed

#: Schema of a chat export, one JSON object a line.
MESSAGES = "actor_key string, platform_groupid string, platform_msgid string, body string, sent_at_source timestamp"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A typed scan; lines that do not parse keep null fields and are dropped."""
    return spark.read.schema(MESSAGES).json(path).where("actor_key is not null and body is not null")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, layer string, family string, priority int, path_glob string, pattern string").json(path, multiLine=True)


def write_records(df: DataFrame, path: str, *partitions: str) -> None:
    """Append; readers remove repeats by identity, so a repeated write does no harm."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_labels(df: DataFrame, bodies: DataFrame, key: str, path: str) -> None:
    """Labels joined to their bodies, as JSON lines; labels without a body are left out."""
    df.join(bodies, key).write.mode("overwrite").json(path)


def audit(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, kind, sample) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.substring("content", 1, 4096).cast("string")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), sniffed(head).alias("kind"), F.substring(head, 1, 120).alias("sample"))
