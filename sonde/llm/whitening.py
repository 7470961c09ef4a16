"""Embedding whitening by a two-pass covariance.

The first pass adds up whole numbers (x = floor(scale * c) + shift), so the mean S / n is exact whatever the order. The second
centres every vector before it multiplies, in two parts that lose nothing (the whole part of the mean, then its fraction), and adds up
outer products, a matrix product for each Arrow batch. A tree of merges, whose fan does not grow with the number of tasks,
brings both to the driver: one d x d matrix, as large as the vectors are wide and no larger for more of them. LAPACK's symmetric
solver gives the components, the projection is broadcast, and a third pass measures the covariance of the whitened vectors.

Defined results: a null vector and one with a null, non-finite or huge entry (2**42 and more, whose x a double cannot hold) are dropped;
so is one whose length is not the table's commonest (ties: the longest), as one covariance needs one length. Repeated rows and null vec_ids
stay, row for row. Where a component has no variance (one vector, equal vectors, dependent dimensions) `whitened` is null, and
`explained` is null if nothing varies. An empty table, or empty vectors, give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
HUGE = 2.0**42
#: Whole parts and rests of this many bits are added up apart, so that no sum overflows in a batch.
HALF = 26
#: Merges that end in one place.
FAN = 8

Batches = Iterator[pa.RecordBatch]


def whole_vectors(batch: pa.RecordBatch, width: int, scale: int, shift: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows that stay, and their entries as whole numbers, one row per vector."""
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), width), False))
    entries = batch.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    keep = (np.abs(entries) < HUGE).all(axis=1)  # false for NaN, which nulls have become, too
    return batch.filter(pa.array(keep)), np.floor(entries[keep] * scale).astype(np.int64) + shift


def _merge(df: DataFrame, fold: Callable[[Batches], object], combine: Callable[[object, object], object]) -> object:
    """What `fold` makes of every task's batches, merged in a tree; None for a table without tasks."""

    def task(batches: Batches) -> Batches:
        yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(fold(batches))]})

    rdd = df.mapInArrow(task, "state binary").rdd.map(lambda row: pickle.loads(row.state))
    parts = rdd.getNumPartitions()
    if not parts:
        return None
    depth = max(2, math.ceil(math.log(parts, FAN)))

    def either(a: object, b: object) -> object:
        return b if a is None else a if b is None else combine(a, b)

    return rdd.treeAggregate(None, either, either, depth)


@dataclass(frozen=True)
class Whitening:
    """n, sums and the components of the fit list: columns of `vectors` by falling eigenvalue."""

    width: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int = SCALE
    shift: int = SHIFT

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n without cancellation: the mean's whole part first, then its fraction."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S) ** 2, exact."""
        far = max((abs(self.n * int(v) - s) for low, high, s in zip(x.min(axis=0), x.max(axis=0), self.sums, strict=True) for v in (low, high)), default=0) if len(x) else 0
        kind = pa.decimal128(38, 0)
        # Nothing below overflows if the largest sum fits, nor n * x if it stays below the sums it is compared with.
        if far * far * self.width < 2**63 and max(abs(s) for s in self.sums) + far < 2**63:
            y = self.n * x - np.array(self.sums, dtype=np.int64)
            return pa.array((y * y).sum(axis=1)).cast(kind)
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return pa.array([Decimal(v) if v < 10**38 else None for v in exact], kind)

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened values, one column per component; NaN where a component has no variance."""
        keep = self.varying(components)
        out = np.full((len(x), min(components, self.width)), np.nan)
        out[:, keep] = self.centred(x) @ (self.vectors[:, : len(keep)][:, keep] / np.sqrt(self.values[: len(keep)][keep]))
        return out

    def varying(self, components: int) -> np.ndarray:
        return self.values[:components] > self.trace * self.width * np.finfo(float).eps


def width_of(vectors: DataFrame) -> int:
    """The commonest length, ties to the longest; 0 if there is no vector."""
    sizes = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("width")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("width")).first()
    return first["width"] if first else 0


def fit(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The components of all vectors that stay; None if there are none."""
    width = width_of(vectors)
    if not width:
        return None
    vectors = vectors.select("embedding")

    def sums(batches: Batches) -> tuple[int, list[int]]:
        n, total = 0, [0] * width
        for batch in batches:
            _, x = whole_vectors(batch, width, scale, shift)
            n += len(x)
            high, low = (x >> HALF).sum(axis=0).tolist(), (x & ((1 << HALF) - 1)).sum(axis=0).tolist()
            total = [t + (a << HALF) + b for t, a, b in zip(total, high, low, strict=True)]
        return n, total

    found = _merge(vectors, sums, lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]))
    if not found or not found[0]:
        return None
    mean = Whitening(width, found[0], tuple(found[1]), np.zeros(0), np.zeros((0, 0)), 0.0, scale, shift)
    shared = vectors.sparkSession.sparkContext.broadcast(mean)

    def products(batches: Batches) -> np.ndarray:
        total = np.zeros((width, width))
        for batch in batches:
            y = shared.value.centred(whole_vectors(batch, width, scale, shift)[1])
            total += y.T @ y
        return total

    covariance = _merge(vectors, products, np.add) / mean.n
    values, components = np.linalg.eigh(covariance)
    return Whitening(width, mean.n, mean.sums, values[::-1].copy(), components[:, ::-1].copy(), float(np.trace(covariance)), scale, shift)


def identity_error(vectors: DataFrame, model: Whitening, components: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    keep = np.flatnonzero(model.varying(components))

    def combine(a: tuple, b: tuple) -> tuple:
        """Count, mean and centred products of two parts from those of each."""
        if not a[0] or not b[0]:
            return a if a[0] else b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def moments(batches: Batches) -> tuple:
        total = (0, np.zeros(len(keep)), np.zeros((len(keep), len(keep))))
        for batch in batches:
            m = shared.value
            z = m.project(whole_vectors(batch, m.width, m.scale, m.shift)[1], components)[:, keep]
            if len(z):
                centre = z.mean(axis=0)
                total = combine(total, (len(z), centre, (z - centre).T @ (z - centre)))
        return total

    n, _, products = _merge(vectors.select("embedding"), moments, combine)
    return float(np.abs(products / n - np.eye(len(keep))).max()) if len(keep) else 0.0


def transform(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """vec_id, deviation decimal(38, 0) (null if longer), whitened: one entry per component, null where it has no variance."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def fold(batches: Batches) -> Batches:
        m = shared.value
        for batch in batches:
            batch, x = whole_vectors(batch, m.width, m.scale, m.shift)
            z = m.project(x, components)
            flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), m.deviations(x), lists], ["vec_id", "deviation", "whitened"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(fold, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, components: int = 8, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    A deviation beyond a long is null here; transform() keeps it up to 38 digits.
    """
    model = fit(vectors, scale, shift)
    if model is None:
        kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], kinds)
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values[:components]]
    share = F.array(*[F.lit(s).cast("double") for s in shares])
    return transform(vectors, model, components).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS long)").alias("deviation"),
        "whitened",
        share[F.col("at")].alias("explained"),
        F.lit(identity_error(vectors, model, components)).alias("identity_error"),
    )
