"""Semi-structured records: maps, paths, JSON pivots, normalising verbs, identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(map_: str, key: str) -> Column:
    """A missing key is the empty string."""
    return F.coalesce(F.try_element_at(map_, F.lit(key)), F.lit(""))


def path_part(path: Column, n: int) -> Column:
    """The n-th part, from 1; a missing one is the empty string."""
    return F.coalesce(F.get(F.split(path, "/"), F.lit(n - 1)), F.lit(""))


def identity(map_: Column) -> Column:
    """A hash of a map that does not depend on the order of its entries."""
    return F.xxhash64(F.to_json(F.array_sort(F.map_entries(map_))))


def pivot_json(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, field, value): one row for each top-level entry; whole floats are shown as integers, non-finite ones dropped."""
    entries = F.explode(F.from_json(json, "map<string,string>")).alias("field", "value")
    out = rows.select(key, entries)
    return out.withColumn("value", F.regexp_replace("value", r"^(-?[0-9]+)\.0+$", "$1")).where(~F.lower("value").isin("nan", "infinity", "-infinity"))


def epoch(c: Column) -> Column:
    """Seconds since 1970 as text; what is not a number is 0."""
    return F.timestamp_seconds(F.coalesce(c.try_cast("bigint"), F.lit(0)))


#: The formats of the best-effort parser, in the order they are tried.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd MMM yyyy HH:mm:ss")


def parse_time(c: Column) -> Column:
    """The first format that fits, an epoch of ten digits included; else null."""
    seconds = F.when(c.rlike("^[0-9]{10}$"), F.timestamp_seconds(c.try_cast("bigint")))
    plain = F.regexp_replace(c, "^[A-Z][a-z]{2}, ", "")  # a weekday says nothing more
    return F.coalesce(seconds, *[F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS])


#: Verbs of the normaliser.
VERBS = {
    "strip": lambda c, *_: F.btrim(c),
    "lower": lambda c, *_: F.lower(c),
    "upper": lambda c, *_: F.upper(c),
    "truncate": lambda c, n: F.substring(c, 1, n),
    "int_from_string": lambda c, *_: F.regexp_extract(c, r"-?[0-9]+", 0),
    "replace": lambda c, pattern, to: F.regexp_replace(c, pattern, to),
}


def normalised(c: Column, *steps: tuple) -> Column:
    return reduce(lambda col, step: VERBS[step[0]](col, *step[1:]), steps, c)


def html_text(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, the commonest entities decoded, white space squeezed."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(?:script|style)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def sniffed(head: Column) -> Column:
    """A kind from the first bytes of a file."""
    marks = (("PK", "zip"), ("%PDF", "pdf"), ("{", "json"), ("[", "json"), ("<!DOCTYPE html", "html"), ("<html", "html"), ("<?xml", "xml"))
    out = F.lit("text")
    for mark, kind in reversed(marks):
        out = F.when(F.startswith(head, F.lit(mark)), kind).otherwise(out)
    return out
