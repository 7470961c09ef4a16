"""Personas of linked actors with a log of decisions: merges and splits, each of which can be taken back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.plans.components import components
from sonde.plans.lineage import materialize
from sonde.plans.parts import Parts

LOG = "a long, b long, action string, step long"
MEMBERS = "actor long, persona long"


class Personas:
    """The newest decision on a pair holds: its actors are linked or not. A persona is named by its smallest actor."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.parts = spark, Parts(spark, path)

    def links(self) -> DataFrame:
        """Pairs (a < b) that are linked now."""
        last = self.parts.read(LOG, "log").groupBy("a", "b").agg(F.max_by("action", "step").alias("action"))
        return last.where("action = 'merge'").select("a", "b")

    def members(self) -> DataFrame:
        """(actor, persona) of every actor that was ever linked."""
        return self.parts.read(MEMBERS, "members")

    def decide(self, pairs: DataFrame, action: str) -> int:
        """Merge or split pairs (a, b); a number of touched actors is returned.

        Only personas that the pairs touch are worked out again: their members keep their other links, all other rows are carried over.
        """
        if action not in ("merge", "split"):
            raise ValueError(f"unknown action {action}")
        step = self.parts.manifest()["number"] + 1
        named = pairs.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
        log = self.parts.write(named.select("a", "b", F.lit(action).alias("action"), F.lit(step).cast("long").alias("step")))
        before, entries = self.members(), self.spark.read.schema(LOG).parquet(log)
        ends = entries.select(F.explode(F.array("a", "b")).alias("actor")).distinct()
        hit = before.join(ends, "actor", "left_semi").select("persona").distinct()
        touched = materialize(before.join(hit, "persona", "left_semi").select("actor").union(ends).distinct(), "touched")
        self.parts.commit({"log": [log]})
        inside = self.links().join(touched.withColumnRenamed("actor", "a"), "a", "left_semi")  # both ends of a link are touched or neither
        found = components(inside)
        again = touched.join(found, touched["actor"] == found["node"], "left").select("actor", F.coalesce("component", "actor").alias("persona"))
        rest = before.join(touched, "actor", "left_anti")
        members = self.parts.write(rest.unionByName(again))
        log_parts = self.parts.manifest()["parts"]["log"]
        self.parts.commit({"members": [members], "log": log_parts}, replace=True)
        return touched.count()
