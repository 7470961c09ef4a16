"""Tables as streams that arrive slice by slice, each run starting again from its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.plans.lineage import shared_dir


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_time(rows: DataFrame, slices: int, column: str = "ts") -> list[DataFrame]:
    """Consecutive ranges of equal length in time, from the first row to the last; rows without a time come first."""
    low, high = rows.agg(F.min(F.unix_micros(column)), F.max(F.unix_micros(column))).first()
    if low is None:
        return [rows]
    step = (high - low) // slices + 1
    at = F.coalesce(F.least(((F.unix_micros(column) - low) / step).cast("int"), F.lit(slices - 1)), F.lit(0))
    return [rows.where(at == k) for k in range(slices)]


def replay(slices: Iterable[DataFrame], run: Callable[[DataFrame, str], object]) -> None:
    """Land each slice in a folder and let run(stream, checkpoint folder) work off what is new, from the same checkpoint each time."""
    base = None
    for rows in slices:
        spark = rows.sparkSession
        base = base or fresh_dir(spark, "replay")
        rows.write.mode("append").parquet(f"{base}/landed")
        run(spark.readStream.schema(rows.schema).parquet(f"{base}/landed"), f"{base}/checkpoint")


def batches(stream: DataFrame, checkpoint: str, keep: Callable[[DataFrame, int], None], tick: str | None = None) -> None:
    """Hand each micro-batch to keep(rows, batch number): all there is, or, with a tick, for ever at that interval.

    A batch that fails is handed over again, with its number, by the next run from the same checkpoint.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep)
    query = (writer.trigger(processingTime=tick) if tick else writer.trigger(availableNow=True)).start()
    query.awaitTermination()


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df in folders by the values of a column: one pass deals the rows, and a slice is read without the others."""
    path = fresh_dir(df.sparkSession, "slices")
    df.write.partitionBy(by).parquet(path)
    fields = [f for f in df.schema if f.name != by]
    return df.sparkSession.read.schema(T.StructType([*fields, df.schema[by]])).parquet(path)
