"""Structured Streaming forms of the features; each ends in the state its batch form gives."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonde.operators.rollup import newest
from sonde.plans.lineage import shared_dir


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's file as a stream, with UTC event times."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads a folder: the parent, limited to the one table
    folder, pattern = path.rsplit("/", 1)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def sliding(events: DataFrame, width: str = "1 day", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def folded(events: DataFrame) -> DataFrame:
    """Per-actor state kept across batches: messages, first and last time; an associative fold over each batch's rows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, None, None)
        for pdf in batches:
            if len(pdf):
                low, high = pdf["us"].min(), pdf["us"].max()
                n, first, last = n + len(pdf), int(low if first is None else min(first, low)), int(high if last is None else max(last, high))
        state.update((n, first, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "first_us": [first], "last_us": [last]})

    shape = "user_id long, n long, first_us long, last_us long"
    rows = events.select("user_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, shape, "n long, first_us long, last_us long", "update", GroupStateTimeout.NoTimeout)


def run_out(stream: DataFrame, mode: str, checkpoint: str, keep: Callable[[DataFrame, int], None]) -> None:
    """Work off what there is, from a checkpoint, batch by batch."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is and return its final rows from a table in the shared folder.

    With keys, later batches' rows replace earlier ones of the same key, as an upsert would.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run_out(stream, mode, f"{base}/state", keep)
    shape = T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])
    rows = spark.read.schema(shape).parquet(f"{base}/out/*")
    if keys:
        rows = newest(rows, keys, ["__batch"])
    return rows.drop("__batch")

