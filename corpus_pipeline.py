"""A training corpus from raw documents: five stages, each an operator of sonde.llm.

1. quality rules: rejected documents go;
2. exact dedup: of equal texts the one with the smallest doc_id stays;
3. SimHash near-dedup: of each group of near copies (five-word shingles, similarity 0.8 or more) one stays;
4. suffix-array dedup: byte strings that repeat are cut out of the texts;
5. packing: what is left, as pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonde.llm import exact_dedup, packing, quality, simhash, suffix_dedup
from sonde.llm.queries import BPE
from sonde.plans.lineage import materialize
from sonde.plans.ship import ship
from sonde.sources.tables import load


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.deduplicated(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, *BPE)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("suffix-array dedup", repeats_stage),
    ("packing", packing_stage),
]

#: Near-dedup, suffix arrays and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
