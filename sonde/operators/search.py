"""Boolean conditions over search tables, as plain Columns, with clearance, facets and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class Wanted:
    """A condition that is made into a Column only when a query runs; joined by &, | and ~."""

    def __init__(self, build) -> None:
        self.build = build

    def __and__(self, other: Wanted) -> Wanted:
        return Wanted(lambda: self.build() & other.build())

    def __or__(self, other: Wanted) -> Wanted:
        return Wanted(lambda: self.build() | other.build())

    def __invert__(self) -> Wanted:
        return Wanted(lambda: ~self.build())


def term(text: str) -> Wanted:
    """Words, phrases and prefixes all mean: the folded haystack contains it."""
    return Wanted(lambda: F.contains("haystack", F.lit(text.lower())))


def field(name: str, value: str, scope: str | None = None, contains: bool = False) -> Wanted:
    """A field's value; scope limits it to one entity type."""

    def build() -> Column:
        hit = F.contains(F.lower(name), F.lit(value.lower())) if contains else F.col(name) == value
        return (F.col("entity_type") == scope) & hit if scope else hit

    return Wanted(build)


def condition(wanted: Wanted) -> Column:
    return wanted.build()


def cleared(rows: DataFrame, tier: int) -> DataFrame:
    """Rows at tiers the reader may see."""
    return rows.where(F.col("tier") <= tier)


def facets(rows: DataFrame, columns: dict[str, str], filters: dict[str, str]) -> DataFrame:
    """(facet, value, n): each facet counts under all filters but its own; the kind facet drops nulls."""
    out = None
    for name, column in columns.items():
        kept = rows
        for other, value in filters.items():
            if other != name:
                kept = kept.where(F.col(columns[other]) == value)
        if name == "kind":
            kept = kept.where(F.col(column).isNotNull())
        part = kept.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """Rows offset+1 .. offset+size+1 of a total order, numbered in pos. The sort keeps only so many rows in each task."""
    top = rows.orderBy(*order).limit(offset + size + 1)
    return top.withColumn("pos", F.row_number().over(W.orderBy(*order))).where(F.col("pos") > offset)


def sorted_by(rows: DataFrame, mode: str, modes: dict[str, Column], tie: str) -> DataFrame:
    return rows.orderBy(modes[mode], tie)
