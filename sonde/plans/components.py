"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.plans.lineage import materialize, packed, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    # the row with the minimum itself keeps a's own edge to it
    return down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component) for every node of an edge, the component being its smallest node.

    Each round sends every node's neighbours to the smallest one known; the number of rounds grows with the logarithm
    of the longest chain. Hubs are handled by minimum aggregates and joins, never by gathering their neighbours. A round
    takes no more tasks than its edges need.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    live = materialize(live.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, count = None, live.count()
    for _ in range(rounds):
        before, live = live, materialize(_small_star(_large_star(packed(live, count))).distinct(), "star")
        release(before)
        mark = live.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        count = mark[0]
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = [F.struct(F.col(c).alias("node"), F.col("b").alias("component")) for c in ("a", "b")]
    found = packed(live, count).select(F.inline(F.array(*own))).distinct()
    found._written_to = live._written_to  # release() of the result deletes the table it rests on
    return found
