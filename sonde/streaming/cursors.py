"""Per-key cursors: each key and primitive of a stream is read on from its own (time, id).

A primitive reads the rows that its condition names. Its cursor stands at the last row it has read, in the order of time and id; rows of
the cursor's time are read again and told apart by id, since equal times may arrive in different batches; rows before it count as late
and are not read. What a primitive has gathered (rows, the longest pause, the total) is stored beside its cursor and in the same
version, so a batch that is run again after a crash changes nothing, and a primitive added later starts from the first row it is given.

Only keys that a batch touches get a new row; reading takes the newest of each. A busy key is folded by day first, so no task sees
all of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.plans.parts import Parts

DAY = 86_400_000_000
ID = ["key", "primitive"]
MARKS = "key string, primitive string, us long, id long, n long, pause long, total double, late long, step long"
EDGES = "key string, primitive string, us long, id long"


class Cursors:
    def __init__(self, spark: SparkSession, path: str, primitives: dict[str, str], most_parts: int = 8) -> None:
        """primitives: name -> SQL condition over the rows."""
        self.parts, self.primitives, self.most_parts = Parts(spark, path), primitives, most_parts

    def read(self) -> DataFrame:
        """key, primitive, cursor (us, id), and what was gathered: n, pause, total; late rows."""
        rows = self.parts.read(MARKS, "marks")
        newest = rows.groupBy(*ID).agg(F.max_by(F.struct("us", "id", "n", "pause", "total", "late", "step"), "step").alias("m"))
        return newest.select(*ID, "m.*")

    def _new(self, rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows to read, each with its cursor, and the count of late ones."""
        wanted = F.filter(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in self.primitives.items()]), lambda p: p.isNotNull())
        fanned = rows.select("key", "us", "id", "value", F.explode(wanted).alias("primitive")).dropDuplicates([*ID, "us", "id"])
        unread = fanned.join(self.parts.read(EDGES, "edges"), [*ID, "us", "id"], "left_anti")
        placed = unread.join(known.select(*ID, F.col("us").alias("since")), ID, "left")
        late = placed.where("us < since").groupBy(*ID).agg(F.count("*").alias("new_late"))
        return placed.where("since IS NULL OR us >= since"), late

    def advance(self, rows: DataFrame, batch: int, source: str = "stream") -> bool:
        """Read a batch (key, us, id, value and what conditions name); False if it was read before."""
        if self.parts.applied(source, batch):
            return False
        known = self.read()
        new, late = self._new(rows, known)
        day = F.floor(F.col("us") / DAY)
        before = F.lag("us").over(W.partitionBy(*ID, "day").orderBy("us", "id"))
        days = (
            new.withColumn("day", day).withColumn("pause", F.col("us") - before).groupBy(*ID, "day")
            .agg(F.min("us").alias("first"), F.max(F.struct("us", "id")).alias("last"), F.count("*").alias("n"), F.max("pause").alias("pause"), F.sum("value").alias("total"), F.any_value("since").alias("since"))
        )
        between = F.col("first") - F.coalesce(F.lag("last.us").over(W.partitionBy(*ID).orderBy("day")), F.col("since"))
        read = days.withColumn("between", between).groupBy(*ID).agg(
            F.max("last").alias("last"), F.sum("n").alias("new_n"), F.max(F.greatest("pause", "between")).alias("new_pause"), F.sum("total").alias("new_total")
        )
        touched = read.join(late, ID, "full").join(known, ID, "left")
        zero = F.lit(0).cast("long")
        marks = touched.select(
            *ID,
            F.coalesce("last.us", "us").alias("us"),
            # rows of the cursor's time may come with smaller ids: the cursor stays at the largest
            F.when(F.col("last").isNull() | ((F.col("last.us") == F.col("us")) & (F.col("id") > F.col("last.id"))), F.col("id")).otherwise(F.col("last.id")).alias("id"),
            (F.coalesce("n", zero) + F.coalesce("new_n", zero)).alias("n"),
            F.greatest("pause", "new_pause").alias("pause"),
            (F.coalesce("total", F.lit(0.0)) + F.coalesce("new_total", F.lit(0.0))).alias("total"),
            (F.coalesce("late", zero) + F.coalesce("new_late", zero)).alias("late"),
            F.lit(self.parts.manifest()["number"] + 1).cast("long").alias("step"),
        )
        marks_part = self.parts.write(marks)
        last = self.parts.spark.read.schema(MARKS).parquet(marks_part).select(*ID, "us")
        edges = new.join(last, [*ID, "us"], "left_semi").select(*ID, "us", "id")
        self.parts.commit({"marks": [marks_part], "edges": [self.parts.write(edges)]}, source, batch)
        if len(self.parts.manifest()["parts"]["marks"]) > self.most_parts:
            self.compact()
        return True

    def compact(self) -> None:
        """One part of newest cursors, and of the rows at their times."""
        now = self.read()
        edges = self.parts.read(EDGES, "edges").join(now.select(*ID, "us"), [*ID, "us"], "left_semi")
        self.parts.commit({"marks": [self.parts.write(now)], "edges": [self.parts.write(edges)]}, replace=True)
