"""What the operators leave on disk and hand over, besides their results."""

import os
from itertools import pairwise
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonde.llm import bpe, nbest, packing, queries, suffix_dedup
from sonde.plans.components import _large_star, _small_star, components
from sonde.plans.lineage import CLEANUP, materialize, packed


def shuffle_files(spark) -> set[str]:
    return {str(Path(at, f)) for at, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    made = materialize(spark.range(1000, numPartitions=4).groupBy((F.col("id") % 10).alias("k")).count(), "tens")
    assert made.count() == 10 and spark.conf.get(CLEANUP) == setting
    live = {f.rsplit("/", 1)[1] for f in shuffle_files(spark) - before}
    # count() above may leave its own single-partition shuffle, the write must not leave its four map outputs
    assert len(live) < 4


def test_surroundings_are_fetched_in_one_pass(spark, monkeypatch):
    asked, fetch = [], suffix_dedup._fetch
    monkeypatch.setattr(suffix_dedup, "_fetch", lambda *a: asked.append(a) or fetch(*a))
    shared = "the same words stand in all of these texts and in each of them "
    docs = [(i, f"{i} own head {i * 7919} " + shared + f"own tail {i * 104729}") for i in range(12)] + [(50 + i, f"{i}{i} " + "another passage that only two have, long enough " + str(i)) for i in range(2)]
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string"), length=40, gram=6, hot=3).collect()
    assert len(found) == 14 and all(r["n_removed"] >= 40 for r in found) and len(asked) == 1


def test_packing_without_ids(spark):
    docs = spark.createDataFrame([(1, "one two  three"), (2, None), (None, "x " * 3000)], "doc_id long, text string").coalesce(1)
    whole, less = packing.pack(docs, *queries.BPE), packing.pack(docs, *queries.BPE, ids=False)
    assert less.columns == whole.columns[:-1]
    assert sorted(map(str, less.collect())) == sorted(map(str, whole.drop("ids").collect()))


def test_ranks_give_the_tokenizers_ids():
    texts = ["plain words", "never-seen qzxvkj words, 123's", "a  b", "x<|endoftext|> y", "", "é中 \U0001f600 z"]
    assert packing.Tokens(*queries.BPE)(texts) == packing.Tokens(queries.BPE[0])(texts)


@pytest.mark.parametrize("words", [[" a", " abcabc", "abcabc", " éééé", "  ", " x\n", " xyzxyz.", " ", "aaaa", " aaa"], [" a"], []])
def test_new_cuts_are_those_of_the_ranks(words):
    model = bpe.Codec(*queries.MULTI)
    assert [np.frombuffer(x, dtype=np.int32).tolist() for x in model._new(words)] == [model.by_rank.encode_ordinary(w) for w in words]
    raw = [w.encode() for w in words]
    assert bpe.repeating(np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(r) for r in raw], dtype=np.int64)).tolist() == [bpe.repeats(r) for r in raw]


@pytest.mark.parametrize("lists", [[[1, 2], [], [3]], [[1], None, []], [[None, 3], [-1, 4, 10**6]], []])
def test_decoding_lists_at_once(lists):
    model, array = bpe.codec(*queries.MULTI), pa.array(lists, pa.list_(pa.int32()))
    assert model.decode_all(array) == [model.decode(i) for i in lists]
    for a, b in pairwise(range(len(lists) + 1)):
        assert model.decode_all(array.slice(a, b - a)) == [model.decode(lists[a])]


def test_a_round_of_components_over_few_edges_needs_no_shuffle(spark):
    """Each round over a handful of edges took seven times as many tasks as there are shuffle partitions."""
    pairs = [(i + 1, i) for i in range(40)] + [(101, 100), (109, 102), (109, 100)]
    edges = materialize(spark.createDataFrame(pairs, "a long, b long").repartition(8), "pairs")
    plan = _small_star(_large_star(packed(edges, len(pairs)))).distinct()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 109)}
    assert packed(edges, 500_000).rdd.getNumPartitions() == 3  # more rows than a task takes go to more tasks


def test_nbest_without_ids(spark):
    """op3_nbest dropped ids that had been built and handed over; unknown characters were spelled one unit at a time."""
    docs = spark.createDataFrame([(1, "one two  three"), (2, None), (None, "é☃ 漢字 𝄞y " * 30), (3, "☃" * 60)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path(queries.PIECES)
    whole, less = nbest.encode(docs, path), nbest.encode(docs, path, ids=False)
    assert less.columns == whole.columns[:-1] and less.collect() == whole.drop("ids").collect()
    assert {(r["doc_id"], r["texts"][0]) for r in nbest.decode(whole, path).collect()} == {(r["doc_id"], r["text"] or "") for r in docs.collect()}
