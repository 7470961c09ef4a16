"""Views kept up to date from inserts: stored aggregate states that merge, and versions that are switched whole.

An aggregate view stores, for each insert, one row of partial states a group, as a part of its own; nothing that was stored is
read or written again. Reading merges the parts. Exact distinct counts store identities, not counts: their merge is a union, so loads
may overlap, repeat and come in any order. Compaction folds the parts into one once there are many. A refreshable view is rebuilt
from its source and switched as one version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.plans.parts import Parts

#: Kind of a measure: its state from rows, and the merge of states. `any` is the first value met that is not null.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
    "any": (lambda c: F.any_value(c, ignoreNulls=True), lambda c: F.any_value(c, ignoreNulls=True)),
    "flag": (lambda c: F.max(F.coalesce(c, F.lit(False))), F.max),
}


class AggregateView:
    """Groups by keys; measures: name -> (kind, SQL expression over the rows); distinct: name -> (identity expressions, condition)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], measures: dict[str, tuple[str, str]], distinct: dict[str, tuple[list[str], str]] | None = None, most_parts: int = 8) -> None:
        self.spark, self.parts = spark, Parts(spark, path)
        self.keys, self.measures, self.distinct, self.most_parts = keys, measures, distinct or {}, most_parts

    def _state(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[KINDS[kind][0](F.expr(e)).alias(name) for name, (kind, e) in self.measures.items()])

    def _merged(self, states: DataFrame) -> DataFrame:
        """Merged states, of the types they were stored with: a sum of sums would widen with each merge."""
        types = {f.name: f.dataType for f in states.schema}
        return states.groupBy(*self.keys).agg(*[KINDS[kind][1](F.col(name)).cast(types[name]).alias(name) for name, (kind, _) in self.measures.items()])

    def _identities(self, rows: DataFrame, name: str) -> DataFrame:
        identity, condition = self.distinct[name]
        return rows.where(condition).select(*self.keys, F.struct(*[F.expr(e).alias(f"i{k}") for k, e in enumerate(identity)]).alias("identity")).distinct()

    def insert(self, rows: DataFrame, source: str, batch: int) -> bool:
        """Fold a batch into the view once; False if it was folded before."""
        if self.parts.applied(source, batch):
            return False
        found = {"states": [self.parts.write(self._state(rows))]}
        found |= {name: [self.parts.write(self._identities(rows, name))] for name in self.distinct}
        self.parts.commit(found, source, batch)
        if len(self.parts.manifest()["parts"]["states"]) > self.most_parts:
            self.compact()
        return True

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(*self.parts.manifest()["parts"][table])

    def compact(self) -> None:
        """All parts as one; readers of the version before keep their parts until vacuum()."""
        tables = {"states": self._merged(self._read("states"))} | {name: self._read(name).distinct() for name in self.distinct}
        self.parts.commit({table: [self.parts.write(df)] for table, df in tables.items()}, replace=True)

    def read(self) -> DataFrame:
        """One row a group: keys, measures, exact distinct counts (0 where none). The view must have had an insert."""
        out = self._merged(self._read("states"))
        for name in self.distinct:
            counts = self._read(name).distinct().groupBy(*self.keys).agg(F.count("*").alias(name))
            same = [out[k].eqNullSafe(counts[k]) for k in self.keys]
            on = same[0]
            for c in same[1:]:
                on = on & c
            out = out.join(counts, on, "left").select(*[out[c] for c in out.columns], F.coalesce(counts[name], F.lit(0)).alias(name))
        return out


class RefreshableView:
    """A table rebuilt from its source; each refresh is a version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.parts = spark, Parts(spark, path)

    def refresh(self, build: DataFrame, keep: int = 2) -> int:
        """Write a whole version, then switch to it; versions older than the last `keep` go. Its number."""
        number = self.parts.commit({"rows": [self.parts.write(build)]}, replace=True)
        self.parts.vacuum(keep)
        return number

    def read(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*self.parts.manifest(number)["parts"]["rows"])


class DistinctSets:
    """Stored identity sets of (group, identity): loads merge by union, in any order and as often as they come."""

    def __init__(self, spark: SparkSession, path: str, group: list[str], identity: list[str]) -> None:
        self.spark, self.group, self.identity = spark, group, identity
        self.parts = Parts(spark, path)

    def add(self, rows: DataFrame, load: str) -> bool:
        """Store a load's identities, without duplicates; False if a load of this name is stored already."""
        return self.parts.insert(rows.select(*self.group, *self.identity).distinct(), load, 0)

    def merge(self, other: DistinctSets) -> None:
        """Take over another store's sets; its source rows are not needed."""
        now = other.parts.manifest()
        self.parts.commit({"rows": now["parts"].get("rows", [])})

    def identities(self) -> DataFrame:
        return self.spark.read.parquet(*self.parts.manifest()["parts"]["rows"]).distinct()

    def counts(self) -> DataFrame:
        """group, n: exact distinct counts."""
        return self.identities().groupBy(*self.group).agg(F.count("*").alias("n"))
