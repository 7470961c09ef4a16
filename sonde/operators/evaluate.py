"""Evaluation of scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.plans.lineage import materialize


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """(auc, n_pos, n_neg): P(positive > negative) + half of ties, from counts at each distinct score: no pairs are formed.

    Scores are partitioned by range; a running sum starts in each range from the sums of the ranges before it.
    """
    by = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    ranged = materialize(by.repartitionByRange("s").withColumn("range", F.spark_partition_id()), "ranges")
    # one row for each range
    sums = ranged.groupBy("range").agg(F.sum("n").alias("n"))
    before = sums.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = ranged.withColumn("inside", inside).join(F.broadcast(before), "range")
    won = won.withColumn("won", F.col("p") * (F.col("base") + F.col("inside") + F.col("n") / 2))
    out = won.agg(F.sum("won").alias("won"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return out.select(F.round(F.try_divide(F.col("won"), F.col("n_pos") * F.col("n_neg")), 6).alias("auc"), "n_pos", "n_neg")


def sweep(rows: DataFrame, score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """(t, tp, fp, tn, fn, precision, recall, f1) for `score >= t`: one conditional aggregate each, one pass over the rows."""
    counts = []
    for t in thresholds:
        hit = F.col(score) >= t
        counts.append(F.struct(F.lit(float(t)).alias("t"), F.count_if(hit & positive).alias("tp"), F.count_if(hit & ~positive).alias("fp"), F.count_if(~hit & ~positive).alias("tn"), F.count_if(~hit & positive).alias("fn")))
    table = rows.agg(F.array(*counts).alias("c")).select(F.inline("c"))
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return table.select("*", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def best_f1(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("f1"), "t").limit(1)


def precision_floor(table: DataFrame, floor: float) -> DataFrame:
    """The threshold of the highest recall at or above a precision; ties go to the lowest."""
    return table.where(F.col("precision") >= floor).orderBy(F.desc("recall"), "t").limit(1)


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def family_precision_recall(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(family, tp, fp, fn, precision, recall), three decimals, zero where undefined."""
    sides = F.array(
        F.struct(F.col(truth).alias("family"), F.lit("truth").alias("side")),
        F.struct(F.col(predicted).alias("family"), F.lit("guess").alias("side")),
    )
    same = F.col(truth).eqNullSafe(F.col(predicted))
    rows = rows.select(same.alias("same"), F.inline(sides)).where("family is not null")
    sums = rows.groupBy("family").agg(
        F.count_if(F.col("same") & (F.col("side") == "truth")).alias("tp"),
        F.count_if(~F.col("same") & (F.col("side") == "guess")).alias("fp"),
        F.count_if(~F.col("same") & (F.col("side") == "truth")).alias("fn"),
    )
    share = lambda other: F.round(F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(other)), F.lit(0.0)), 3)
    return sums.select("*", share("fp").alias("precision"), share("fn").alias("recall"))
