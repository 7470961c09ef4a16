"""Vocabulary measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonde.functions.text import tokens


def moving_ttr(docs: DataFrame, key: str, text: str, window: int = 50, least: int = 100, places: int = 6) -> DataFrame:
    """(key, mattr): the mean type-token ratio of all windows of `window` tokens, for texts of `least` tokens or more.

    A token counts in the windows in which it is the first of its kind: those that start after its previous occurrence.
    So one look back at each token replaces a scan of each window.
    """
    words = docs.select(key, tokens(F.col(text)).alias("w")).where(F.size("w") >= least)
    rows = words.select(key, F.size("w").alias("n"), F.posexplode("w").alias("i", "token"))
    before = F.coalesce(F.lag("i").over(W.partitionBy(key, "token").orderBy("i")), F.lit(-1))
    last = F.least(F.col("i"), F.col("n") - window)
    first = F.greatest(before + 1, F.col("i") - (window - 1), F.lit(0))
    counted = rows.withColumn("windows", F.greatest(last - first + 1, F.lit(0)))
    ratio = F.sum("windows") / (F.lit(float(window)) * (F.max("n") - (window - 1)))
    return counted.groupBy(key).agg(F.round(ratio, places).alias("mattr"))
