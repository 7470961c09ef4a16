"""What the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.plans.lineage import materialize

#: ASCII white space of the contracts; words are the runs between.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Folds A-Z only, as the contracts ask; bytes.lower() does the same.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text with null as empty, and the named columns; other columns, whatever their names, go no further."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def id_hash(c: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")))


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df marked for broadcast if it has few rows; more rows are joined by shuffling."""
    return F.broadcast(df) if rows <= most else df


def one_of_each(docs: DataFrame, marks: DataFrame, text_key: Column, broadcast_rows: int) -> DataFrame:
    """docs without the rows that marks (id, h, kept) does not keep; of repeated rows that it keeps, the least one.

    A row is marked by its doc_id and by h, which text_key, an expression over docs, must equal. docs may have columns of
    any names: all others are taken from the frame they belong to.
    """
    marks = materialize(marks.select("id", "h", "kept"), "marks")
    repeats, count = marks.agg(F.count_if("kept"), F.count("*")).first()
    on = docs["doc_id"].eqNullSafe(marks["id"]) & (text_key == marks["h"])
    few = small(marks, count, broadcast_rows)
    if not repeats:
        return docs.join(few, on, "left_anti")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    named = docs.join(few, on, "left").select(row, *[marks[c].alias(c) for c in ("id", "h", "kept")])
    single = named.where(F.col("kept").isNull()).select("row")
    return single.unionAll(named.where("kept").groupBy("id", "h").agg(F.min("row").alias("row")).select("row")).select("row.*")


def tidy(fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """fold, after which the Python worker, which waits for other tasks, hands its free memory back."""

    @functools.wraps(fold)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from fold(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run
