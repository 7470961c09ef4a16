"""Host names: their ASCII form, and the registrable domain by a list of public suffixes given as a table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.operators.extract import host_name


@F.pandas_udf(T.StringType())
def _idna(hosts: pd.Series) -> pd.Series:
    def one(host: str | None) -> str | None:
        try:
            return None if host is None else host.encode("idna").decode("ascii").lower() or None
        except UnicodeError:  # empty, too long or forbidden labels: no host
            return None

    return hosts.map(one)


def ascii_host(host: Column) -> Column:
    """The normalised host with labels of other scripts as Punycode (IDNA 2003); null if it cannot be one. Plain names stay in the JVM."""
    name = host_name(F.translate(host, "。．｡", "..."))
    other = F.regexp_like(name, F.lit(r"[^\x00-\x7F]"))
    return F.when(other, _idna(F.when(other, name))).otherwise(name)


def registrable(hosts: DataFrame, host: str, suffixes: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """(host, public_suffix, registrable) of the distinct hosts, by the rules of a public suffix list (column `rule`).

    A rule is a suffix, `*.suffix` (any one label more) or `!name` (an exception to that); exceptions come first, then the rule of
    most labels; without one the last label is the suffix. registrable has one label more, and is null for a suffix itself. Each
    host is joined by its own endings, so the list may be of any size; it is broadcast up to broadcast_rows.
    """
    named = hosts.select(F.col(host).alias("host")).where("host IS NOT NULL AND host <> ''").distinct().withColumn("labels", F.split("host", r"\."))
    ending = lambda k: F.array_join(F.slice("labels", -k, k), ".")
    of_length = lambda k: F.array(
        F.struct(ending(k).alias("rule"), k.alias("labels_in"), F.lit(0).alias("first")),
        F.struct(F.when(k > 1, F.concat(F.lit("*."), ending(k - 1))).alias("rule"), k.alias("labels_in"), F.lit(0).alias("first")),
        F.struct(F.concat(F.lit("!"), ending(k)).alias("rule"), (k - 1).alias("labels_in"), F.lit(1).alias("first")),
    )
    # F.slice needs a positive length, so the wildcard of a single label is never built from an empty ending
    tried = named.select("host", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.size("labels")), of_length)))).where("rule IS NOT NULL")
    rules = suffixes.select(F.lower("rule").alias("rule")).where("rule IS NOT NULL").distinct()
    if rules.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rules = F.broadcast(rules)
    best = tried.join(rules, "rule").groupBy("host").agg(F.max(F.struct("first", "labels_in")).alias("best"))
    n = F.coalesce(F.col("best.labels_in"), F.lit(1))
    found = named.join(best, "host", "left").withColumn("n", n)
    suffix = F.array_join(F.slice("labels", -F.col("n"), F.col("n")), ".")
    one_more = F.array_join(F.slice("labels", -(F.col("n") + 1), F.col("n") + 1), ".")
    return found.select("host", suffix.alias("public_suffix"), F.when(F.size("labels") > F.col("n"), one_more).alias("registrable"))
