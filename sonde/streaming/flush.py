"""Buffered classification: messages are taken in batches, each reference once, and what fires is stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonde.plans.parts import Parts


class Flush:
    """A sink for batches of references.

    A batch is flushed when the source's limit of files is reached or at the tick, whichever comes first (options of the stream). Of
    repeated references one is fetched; `fetch` brings the bodies of a whole batch by one join, `classify` leaves rows that fired.
    What fired in an earlier batch is not stored again.
    """

    def __init__(self, spark: SparkSession, path: str, ref: str, fetch: Callable[[DataFrame], DataFrame], classify: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.parts, self.ref, self.fetch, self.classify = spark, Parts(spark, path), ref, fetch, classify

    def __call__(self, batch: DataFrame, number: int) -> None:
        """A batch of the stream; a repeated one, as after a crash, adds no row."""
        if self.parts.applied("flush", number):
            return
        refs = batch.select(self.ref).where(batch[self.ref].isNotNull()).distinct()
        stored = self.parts.manifest()["parts"].get("rows", [])
        if stored:
            refs = refs.join(self.spark.read.parquet(*stored).select(self.ref), self.ref, "left_anti")
        self.parts.insert(self.classify(self.fetch(refs)), "flush", number)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*self.parts.manifest()["parts"]["rows"])
