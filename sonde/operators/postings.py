"""An inverted index for words of texts: positions of each word in each text, in buckets of words; queries read the buckets of their words only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands between words.
BETWEEN = r"[^\p{L}\p{N}_]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(r"\W+", text.lower()) if w]


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """word, key, positions (from 0, rising), by one pass over the texts; no text travels, only its words."""
    tokens = F.filter(F.split(F.lower(F.col(text)), BETWEEN), lambda w: w != "")
    rows = docs.select(F.col(key).alias("key"), F.posexplode(tokens).alias("at", "word"))
    # a text's rows leave its task together, so most of this is done before the shuffle
    return rows.groupBy("word", "key").agg(F.array_sort(F.collect_list("at")).alias("positions"))


class Index:
    """Postings stored by bucket of the word's hash, so that a query opens only the folders of its words."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def write(self, docs: DataFrame, key: str, text: str) -> None:
        rows = postings(docs, key, text).withColumn("bucket", self._bucket(F.col("word")))
        # a frequent word's postings may fill several files: it is dealt out by key too
        rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def read(self, wanted: list[str]) -> DataFrame:
        """Postings of some words: the buckets are known before the scan, and in them row groups are skipped by word."""
        spark = self.spark
        buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "word string").select(self._bucket(F.col("word"))).collect()]
        return spark.read.parquet(self.path).where(F.col("bucket").isin(buckets) & F.col("word").isin(wanted)).drop("bucket")

    def all_of(self, text: str) -> DataFrame:
        """Keys of texts that hold every word."""
        wanted = sorted(set(words(text)))
        return self.read(wanted).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("key")

    def any_of(self, text: str) -> DataFrame:
        return self.read(sorted(set(words(text)))).select("key").distinct()

    def phrase(self, text: str) -> DataFrame:
        """key, n: how often the words stand one after the other. Each word's positions are moved to where the phrase would begin, and a place that
        all words name is one; intersecting them in the row, no pair of positions is built."""
        said = words(text)
        rows = self.read(sorted(set(said)))

        def moved(k: int, word: str):
            return F.transform(F.filter("positions", lambda p: (F.col("word") == word) & (p >= k)), lambda p: p - k)

        begins = F.flatten(F.array(*[moved(k, w) for k, w in enumerate(said)]))
        per_word = rows.select("key", F.explode(begins).alias("begin"))
        return per_word.groupBy("key", "begin").count().where(F.col("count") == len(said)).groupBy("key").agg(F.count("*").alias("n"))
