"""Enrichments: named table functions with a typed output, run over the rows of the kinds they take."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Enrichment:
    """takes: kinds of subjects; gives: DDL of what a run adds to subject; rows: whether a subject may have none or several."""

    name: str
    takes: tuple[str, ...]
    gives: str
    build: Build
    rows: bool = False


class Registry:
    def __init__(self) -> None:
        self.known: dict[str, Enrichment] = {}

    def add(self, name: str, takes: tuple[str, ...], gives: str, rows: bool = False) -> Callable[[Build], Build]:
        """Register a function from (kind, subject) rows to rows with subject and the columns of `gives`."""

        def put(build: Build) -> Build:
            if name in self.known:
                raise ValueError(f"{name} is registered twice")
            self.known[name] = Enrichment(name, takes, gives, build, rows)
            return build

        return put

    def run(self, name: str, subjects: DataFrame) -> DataFrame:
        """subject and the typed output of one enrichment, for the subjects of its kinds; without `rows` every such subject has one row."""
        e = self.known[name]
        asked = subjects.where(F.col("kind").isin(*e.takes)).select("kind", "subject").distinct()
        wanted = T.StructType.fromDDL(e.gives)
        found = e.build(asked)
        missing = {"subject", *wanted.names} - set(found.columns)
        if missing:
            raise TypeError(f"{name} lacks {sorted(missing)}")
        typed = found.select("subject", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
        return typed if e.rows else asked.select("subject").distinct().join(typed, "subject", "left")

    def facts(self, subjects: DataFrame) -> DataFrame:
        """(enrichment, subject, name, value string) of all enrichments; nulls are no facts."""
        out = None
        for e in self.known.values():
            rows = self.run(e.name, subjects)
            fields = [F.struct(F.lit(f).alias("name"), F.col(f).cast("string").alias("value")) for f in T.StructType.fromDDL(e.gives).names]
            part = rows.select(F.lit(e.name).alias("enrichment"), "subject", F.inline(F.array(*fields))).where("value IS NOT NULL")
            out = part if out is None else out.unionByName(part)
        return out
