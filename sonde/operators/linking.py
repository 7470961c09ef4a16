"""Pairs of entities: shared indicators, near signatures, nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonde.plans.lineage import materialize


def shared_pairs(held: DataFrame, actor: str, item: str, least_df: int = 2, most_df: int = 15, floor: float = 0.15) -> DataFrame:
    """(a, b, score, shared): pairs that share an item of document frequency 2 to 15, by IDF-weighted Jaccard similarity.

    Items above the limit are ambient by definition of the measure; leaving them out bounds the pairs an item can make.
    """
    own = held.select(F.col(actor).alias("a"), F.col(item).alias("item")).where("a is not null and item is not null").distinct()
    n = own.agg(F.countDistinct("a").alias("actors"))
    df = own.groupBy("item").agg(F.count("*").alias("df")).where(F.col("df").between(least_df, most_df))
    weight = F.log((F.col("actors") + 1) / (F.col("df") + 1)) + 1
    posted = own.join(df, "item").join(F.broadcast(n)).withColumn("w", weight).select("a", "item", "w")
    # pairs are many times the postings: totals come along from there, so that pairs are shuffled once
    posted = materialize(posted, "posted")
    posted = materialize(posted.join(posted.groupBy("a").agg(F.sum("w").alias("total")), "a"), "totals")
    other = posted.select(F.col("a").alias("b"), "item", F.col("total").alias("other"))
    sums = posted.join(other, "item").where("a < b").groupBy("a", "b").agg(F.sum("w").alias("both"), F.array_sort(F.collect_list("item")).alias("shared"), F.max("total").alias("total"), F.max("other").alias("other"))
    score = F.col("both") / (F.col("total") + F.col("other") - F.col("both"))
    return sums.withColumn("score", F.round(score, 4)).where(score >= floor).select("a", "b", "score", "shared")


def hamming_pairs(rows: DataFrame, key: str, signature: str, most: int, within: str | None = None) -> DataFrame:
    """(a, b, distance): pairs of classes of equal signatures at most `most` bits apart, each class named by its smallest key.

    Exact: the bits in which any signatures differ are dealt out to blocks, so many that a near pair agrees on `agree` of them;
    only the first agreeing set of blocks gives the pair, so none comes twice. Bits that are the same in all rows tell nothing
    and are left out. Members of a class come as pairs of its smallest key and theirs, at distance 0, so a class gives as many
    rows as it has members, not as many as it has pairs. `within`: only rows with equal values of this column (nulls equal each
    other) make classes and pairs, and it is returned too.
    """
    part = F.struct(F.col(within)) if within else F.struct(F.lit(0))
    rows = rows.select(F.col(key).alias("k"), F.col(signature).alias("s"), part.alias("part"))
    classes = materialize(rows.groupBy("part", "s").agg(F.min("k").alias("least")), "classes")
    n, some, every = classes.agg(F.count("s"), F.bit_or("s"), F.bit_and("s")).first()
    bits = [i for i in range(64) if n and (some ^ every) >> i & 1]
    blocks, sets = _agreeing(n, bits, most)
    values = F.array(*[F.struct(F.lit(sum(1 << b for b in held)).alias("set"), F.col("s").bitwiseAND(F.lit(_signed(sum(blocks[b] for b in held)))).alias("value")) for held in sets])
    keyed = classes.select("part", "s", "least", F.inline(values))
    other = keyed.select("part", F.col("s").alias("t"), F.col("least").alias("also"), "set", "value")
    apart = F.col("s").bitwiseXOR(F.col("t"))
    agreed = reduce(lambda x, y: x.bitwiseOR(y), [F.when(apart.bitwiseAND(F.lit(_signed(mask))) == 0, 1 << b).otherwise(0) for b, mask in enumerate(blocks)], F.lit(0))
    # the blocks that agree, up to the set's last one, are the set itself: it is the first
    upto = reduce(lambda x, held: F.when(F.col("set") == sum(1 << b for b in held), (2 << held[-1]) - 1 if held else 0).otherwise(x), sets, F.lit(0))
    # Spark takes copies of the classes for as small as the classes and would send them all through the driver: it must not
    near = keyed.join(other.hint("merge"), ["part", "set", "value"]).where((F.col("s") < F.col("t")) & (F.bit_count(apart) <= most)).where(agreed.bitwiseAND(upto) == F.col("set"))
    across = near.select("part", F.least("least", "also").alias("a"), F.greatest("least", "also").alias("b"), F.bit_count(apart).alias("distance"))
    named = rows.join(classes.hint("merge"), ["part", "s"]).where("k <> least").select("part", F.col("least").alias("a"), F.col("k").alias("b"), F.lit(0).alias("distance"))
    found = across.unionByName(named)
    return found.select("a", "b", "distance", *([F.col("part")[within].alias(within)] if within else []))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _agreeing(n: int, bits: list[int], most: int, row: int = 200, widest: int = 56) -> tuple[list[int], list[tuple[int, ...]]]:
    """(masks of blocks, sets of blocks) for n signatures that differ in `bits`: of most + agree blocks a near pair differs in `most` at most.

    More agreement makes more copies of a row and fewer candidates; a shuffled copy counts as much as `row` candidates.
    """
    best = None
    for agree in range(1, max(1, len(bits) - most) + 1):
        sets = list(combinations(range(most + agree), agree))
        if best and len(sets) > widest:
            break
        # bits are seldom independent: two thirds of them count
        alike = n / 2 ** (len(bits) * agree / (most + agree) * 2 / 3)
        cost = len(sets) * n * (row + alike)
        if best is None or cost < best[0]:
            best = cost, agree, sets
    _, agree, sets = best
    return [sum(1 << b for b in bits[i :: most + agree]) for i in range(most + agree)], sets


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _nearest(names: np.ndarray, vectors: np.ndarray, k: int, step: int = 1024):
    """Rows (key, vector) -> the k best rows of a task for each query of a block, by products of matrices."""

    def best(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["query", "cosine", "key"], ascending=[True, False, True])
        return held.groupby("query", sort=False).head(k)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"query": pd.Series(dtype="int64"), "key": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                own, m = part["key"].to_numpy(dtype=np.int64), np.stack(part["vector"].to_numpy()).astype(np.float64)
                cosine = np.round(vectors @ (m / np.linalg.norm(m, axis=1)[:, None]).T, 6)
                cosine[names[:, None] == own[None, :]] = -np.inf
                # all that tie with the k-th stay until keys decide
                at_k = min(k, len(own)) - 1
                floor = -np.partition(-cosine, at_k, axis=1)[:, at_k : at_k + 1]
                q, i = np.nonzero((cosine >= floor) & (cosine > -np.inf))
                held = best(pd.concat([held, pd.DataFrame({"query": names[q], "key": own[i], "cosine": cosine[q, i]})]))
        yield held

    return fold


def nearest_vectors(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block_bytes: int = 8 << 20) -> DataFrame:
    """(query, key, cosine, rank): the k rows nearest to each query, a stated set of rows.

    Queries go out in blocks of at most block_bytes. A task keeps the k best of its rows for each query of a block, so
    what is shuffled grows with the queries, not with the pairs.
    """
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("v")).where("query is not null and v is not null")
    count, width = q.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-count * width * 8 // block_bytes))
    found = None
    for n in range(blocks):
        some = q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).toPandas()
        if not len(some) and found is not None:
            continue
        m = np.stack(some["v"].to_numpy()).astype(np.float64) if len(some) else np.zeros((0, width))
        names = some["query"].to_numpy(dtype=np.int64)
        own = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where("key is not null and vector is not null")
        part = own.mapInPandas(_nearest(names, m / np.linalg.norm(m, axis=1)[:, None], k), "query long, key long, cosine double")
        found = part if found is None else found.unionAll(part)
    best = W.partitionBy("query").orderBy(F.desc("cosine"), "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", F.col("key").alias(key), "cosine", "rank")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with the newest value of right at or before its time, by one union and one window."""
    names = left.columns
    marked = left.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast(right.schema[value].dataType)})
    other = right.select(key, ts, F.col(value).alias("__value")).withColumn("__side", F.lit(0))
    both = marked.unionByName(other, allowMissingColumns=True)
    upto = W.partitionBy(key).orderBy(ts, "__side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__value", ignorenulls=True).over(upto)).where("__side = 1").select(*names, value)
