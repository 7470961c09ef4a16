"""Roll-ups over semi-structured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def secret_hashed(df: DataFrame, *columns: str) -> DataFrame:
    """Secret-valued columns leave as sha256 only."""
    return df.withColumns({c: F.sha2(F.col(c).cast("string"), 256) for c in columns})


def coverage(files: DataFrame, rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(group, files, parsed, percent): files that gave at least one row; 0 where there are none."""
    hit = rows.select(*keys).distinct().withColumn("__hit", F.lit(True))
    joined = files.select(group, *[k for k in keys if k != group]).distinct().join(hit, keys, "left")
    sums = joined.groupBy(group).agg(F.count("*").alias("files"), F.count_if(F.col("__hit").isNotNull()).alias("parsed"))
    return sums.withColumn("percent", F.round(F.coalesce(F.try_divide(100.0 * F.col("parsed"), F.col("files")), F.lit(0.0)), 1))


def first_of(value: Column, tie: Column) -> Column:
    """A defined stand-in for `any`: the value of the smallest tie."""
    return F.min_by(value, tie)


def capped_count(df: DataFrame, most: int = 10_000) -> DataFrame:
    """(total, capped): an exact count, reported at most as `most`."""
    return df.agg(F.least(F.count("*"), F.lit(most)).alias("total"), (F.count("*") > most).alias("capped"))


def newest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Upsert semantics on read: the row of the highest version of each key."""
    from pyspark.sql import Window as W

    order = W.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return df.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")
