"""Range sharding by sampled splitters, on DataFrame functions only.

Records are ordered by (key, doc_id), key being a hash of the text. A size-weighted sample of those pairs gives
quantile boundaries: many more ranges than shards, each with about the same bytes. Every record finds its range by
two look-ups in arrays of boundaries; ranges that still hold too much are subdivided by a hash of the record. Exact
sums of bytes over the ranges, and running sums within them, then place each record at its exact offset in the
global order, and the offset decides the shard. So sizes differ by one record at most, also where one text holds a
third of all rows, and no task handles more than one (sub)range of narrow rows.

Law `bytes`. Defined results: null text has size 8 and crc32 0; a null doc_id sorts first; repeated rows each get a
slot of their own; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonde.llm.common import texts
from sonde.plans.lineage import materialize

LAW = "bytes"


def _pick(bounds: str, key: Column) -> Column:
    """How many of the ascending boundaries are at or below key."""
    return F.size(F.filter(F.col(bounds), lambda b: b <= key))


def splitters(rows: DataFrame, ranges: int, per_range: int, total: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a size-weighted sample: `ranges * per_range` records expected, `ranges - 1` returned."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(ranges * per_range / max(total, 1)))
    uniform = F.pmod(F.xxhash64("key", "doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(uniform < chance).select("key", "doc_id", F.greatest(F.lit(1.0), F.col("size") / F.lit(total / (ranges * per_range))).alias("weight"))
    order = W.orderBy("key", "doc_id")
    ends = sample.withColumn("upto", F.sum("weight").over(order)).withColumn("all", F.sum("weight").over(W.partitionBy()))
    marks = ends.withColumn("range", F.floor(F.col("upto") / F.col("all") * ranges))
    first = marks.groupBy("range").agg(F.min(F.struct("key", "doc_id")).alias("at")).where("range between 1 and " + str(ranges - 1))
    return [(r["at"]["key"], r["at"]["doc_id"]) for r in first.orderBy("range").collect()]


def shard(docs: DataFrame, shards: int = 24, coarse: int = 32, per_range: int = 16, overfull: float = 4.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null under this law).

    coarse: the square of it is the number of ranges; with per_range it bounds the sample. overfull: a range of more
    than so many times its share of the bytes is subdivided.
    """
    spark = docs.sparkSession
    ranges = coarse * coarse
    rows = materialize(
        docs.select("doc_id", "text").select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"),
        ),
        "sizes",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bounds = splitters(rows, ranges, per_range, total)
    lead = bounds[::coarse]
    parts = [bounds[i : i + coarse] for i in range(0, len(bounds), coarse)]
    kind = "array<struct<key:long,doc_id:long>>"
    lookup = spark.createDataFrame([(lead, parts)], f"lead {kind}, parts array<{kind}>")
    at = F.struct("key", "doc_id")
    # one row of boundaries, at most `ranges` long, is attached to every record
    ranged = (
        rows.join(F.broadcast(lookup))
        .withColumn("block", _pick("lead", at))
        .withColumn("own", F.when(F.col("block") > 0, F.get("parts", F.col("block") - 1)))
        .withColumn("range", F.when(F.col("block") > 0, (F.col("block") - 1) * coarse + _pick("own", at)).otherwise(0))
        .drop("lead", "parts", "own", "block")
    )
    ranged = materialize(ranged, "ranged")
    full = ranged.groupBy("range").agg(F.sum("size").alias("range_bytes"))
    cuts = full.select("range", F.greatest(F.lit(1), F.ceil(F.col("range_bytes") * ranges / F.lit(max(total, 1) * overfull))).alias("cuts"))
    sub = ranged.join(F.broadcast(cuts), "range").withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit("cut")), "cuts")).drop("cuts")
    # exact offsets of the subranges, at most a few for each range
    sums = sub.groupBy("range", "sub").agg(F.sum("size").alias("bytes"))
    before = W.orderBy("range", "sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("range", "sub", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("range", "sub").orderBy("key", "doc_id", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    placed = sub.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(offsets), ["range", "sub"])
    placed = placed.withColumn("shard", F.expr(f"least({shards - 1}, ((base + within) * {shards}) div {max(total, 1)})").cast("int"))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "range", "sub", "within", "shard"), "placed")
    counts = placed.groupBy("shard", "range", "sub").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("shard").orderBy("range", "sub").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "range", "sub", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    nth = F.row_number().over(W.partitionBy("range", "sub", "shard").orderBy("within", "doc_id")) - 1
    return (
        placed.withColumn("nth", nth)
        .join(F.broadcast(starts), ["shard", "range", "sub"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("start") + F.col("nth")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
