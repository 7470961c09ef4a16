"""Cursors, flushes, views and versions: crashes, restarts, repeated batches, and readers while a version is written."""

import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonde.operators.views import AggregateView, DistinctSets, RefreshableView
from sonde.plans.parts import Parts
from sonde.queries import load_all
from sonde.streaming.cursors import Cursors
from sonde.streaming.flush import Flush
from sonde.streaming.profiles import BLOCKS, ProfileVersions
from sonde.streaming.replay import dealt, batches, by_time, fresh_dir

ROWS = "key string, us long, id long, value double"


def landed(spark, rows, path, schema):
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain_cursors(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted({r[1:] for r in rows if r[0] == key})
        times = [r[0] for r in own]
        out[key] = (*max(r[:2] for r in own), len(own), max((b - a for a, b in itertools.pairwise(times)), default=None), sum(r[2] for r in own))
    return out


def test_cursors_survive_a_crash(spark):
    """The stream dies after its second batch was stored but before that was noted; the restarted one reads no row twice."""
    parts = [
        [("a", 10, 1, 1.0), ("a", 20, 3, 1.0), ("b", 5, 1, 2.0)],
        [("a", 20, 2, 1.0), ("a", 20, 4, 1.0), ("a", 20, 3, 1.0), ("b", 5, 1, 2.0)],  # equal times in two batches, and rows that come again
        [("a", 86_400_000_500, 5, 1.0), ("c", 1, 9, 0.5), ("c", 1, 8, 0.5)],
        [("c", 1, 8, 0.5), ("b", 7, 2, 2.0)],
    ]
    base = fresh_dir(spark, "t")
    stream = landed(spark, parts, f"{base}/in", ROWS)
    cursors = Cursors(spark, f"{base}/cursors", {"all": "true"})

    def dies(batch, number):
        cursors.advance(batch, number)
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        batches(stream, f"{base}/checkpoint", dies)
    assert cursors.parts.manifest()["applied"] == {"stream": 1}
    batches(stream, f"{base}/checkpoint", cursors.advance)
    found = {r["key"]: (r["us"], r["id"], r["n"], r["pause"], r["total"]) for r in cursors.read().collect()}
    assert found == plain_cursors([r for p in parts for r in p])
    assert {r["late"] for r in cursors.read().collect()} == {0}


def test_cursors_count_late_rows_and_new_primitives(spark):
    rows = lambda data: spark.createDataFrame(data, ROWS)
    path = fresh_dir(spark, "t")
    Cursors(spark, path, {"all": "true"}).advance(rows([("a", 10, 1, 1.0), ("a", 30, 2, 1.0)]), 0)
    more = Cursors(spark, path, {"all": "true", "big": "value > 5"}, most_parts=1)
    assert more.advance(rows([("a", 20, 3, 9.0), ("a", 40, 4, 9.0), (None, 1, 1, 1.0)]), 1)
    assert not more.advance(rows([("a", 99, 9, 9.0)]), 1)  # a batch that comes again
    found = {(r["key"], r["primitive"]): r for r in more.read().collect()}
    assert (found["a", "all"]["us"], found["a", "all"]["n"], found["a", "all"]["late"], found["a", "all"]["pause"]) == (40, 3, 1, 20)
    assert (found["a", "big"]["us"], found["a", "big"]["n"], found["a", "big"]["late"], found["a", "big"]["pause"]) == (40, 2, 0, 20)
    assert len(more.parts.manifest()["parts"]["marks"]) == 1  # compacted


def test_a_flushed_batch_counts_once(spark):
    base = fresh_dir(spark, "t")
    bodies = spark.createDataFrame([(i, f"body {i}") for i in range(6)], "ref long, body string")
    fetched = []

    def fetch(refs):
        fetched.append(sorted(r["ref"] for r in refs.collect()))
        return bodies.join(refs, "ref")

    flush = Flush(spark, f"{base}/flush", "ref", fetch, lambda rows: rows.where("ref % 2 = 0"))
    stream = landed(spark, [[(0,), (0,), (1,), (None,)], [(0,), (2,), (9,)], [(4,), (2,)]], f"{base}/in", "ref long")

    def dies(batch, number):
        flush(batch, number)
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        batches(stream, f"{base}/checkpoint", dies)
    batches(stream, f"{base}/checkpoint", flush)
    assert sorted(r["ref"] for r in flush.read().collect()) == [0, 2, 4]
    assert fetched == [[0, 1], [2, 9], [4]]


def inserts(view, spark, rows):
    for batch, part in enumerate(rows):
        assert view.insert(spark.createDataFrame(part, "k string, v long, who string"), "s", batch)


@pytest.mark.parametrize("most_parts", [2, 50])
def test_a_view_equals_a_rebuild(spark, most_parts):
    data = [[("a" if (i + b) % 3 else None, i * b % 7, None if i % 4 == 0 else f"w{(i * b) % 5}") for i in range(1 + b)] for b in range(10)]
    measures = {"n": ("count", "1"), "total": ("sum", "v"), "least": ("min", "v"), "most": ("max", "v"), "flag": ("flag", "v > 4")}
    view = AggregateView(spark, fresh_dir(spark, "t"), ["k"], measures, {"people": (["who"], "who is not null")}, most_parts)
    inserts(view, spark, data)
    assert not view.insert(spark.createDataFrame(data[3], "k string, v long, who string"), "s", 3)
    whole = pd.DataFrame([r for part in data for r in part], columns=["k", "v", "who"]).fillna({"k": "none"})
    found = {r["k"] or "none": (r["n"], r["total"], r["least"], r["most"], r["flag"], r["people"]) for r in view.read().collect()}
    assert found == {k: (len(g), g["v"].sum(), g["v"].min(), g["v"].max(), (g["v"] > 4).any(), g["who"].nunique()) for k, g in whole.groupby("k")}


def test_a_part_without_manifest_is_not_read(spark):
    parts = Parts(spark, fresh_dir(spark, "t"))
    one = spark.range(3)
    parts.insert(one, "s", 0)
    parts.write(spark.range(100))  # a writer that died before its manifest
    assert parts.read("id long").count() == 3
    assert parts.insert(one, "s", 1) and not parts.insert(one, "s", 1)
    assert parts.read("id long").count() == 6
    assert parts.vacuum(keep=1) == 1 and parts.read("id long").count() == 6


def test_two_writers_cannot_take_one_number(spark):
    parts = Parts(spark, fresh_dir(spark, "t"))
    parts._publish({"number": 1, "parts": {}, "applied": {}})
    with pytest.raises(Exception, match="exist"):
        parts._publish({"number": 1, "parts": {"rows": ["other"]}, "applied": {}})
    assert parts.manifest()["parts"] == {}


def test_readers_keep_their_version(spark):
    view = RefreshableView(spark, fresh_dir(spark, "t"))
    view.refresh(spark.range(2))
    before = view.read()
    view.refresh(spark.range(5))
    assert (before.count(), view.read().count(), view.read(1).count()) == (2, 5, 2)
    view.refresh(spark.range(7))
    assert view.read().count() == 7 and view.parts._numbers() == [2, 3]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_distinct_sets_merge_in_any_order(spark, order):
    loads = [[("a", 1), ("a", 2), ("a", 2)], [("a", 2), ("b", 1), ("b", None)], [("a", 3), ("b", 1)]]
    sets = DistinctSets(spark, fresh_dir(spark, "t"), ["g"], ["x"])
    for k in order:
        part = spark.createDataFrame(loads[k], "g string, x long")
        assert sets.add(part, f"load{k}") and not sets.add(part, f"load{k}")
    assert {r["g"]: r["n"] for r in sets.counts().collect()} == {"a": 3, "b": 2}


def test_profiles_emit_only_what_differs(spark):
    seen = "actor long, us long, id long, primitive string, value string, source string"
    profiles = ProfileVersions(spark, fresh_dir(spark, "t"), [("busy", {"message_count": 3})])
    count, words = "meta.total_messages", "stylometric.function_word_distribution_top50"
    fold = lambda rows, batch: profiles.fold(spark.createDataFrame(rows, seen), batch)
    assert fold([(1, 1, 1, count, "2", "s"), (1, 2, 2, count, "2", "s"), (1, 3, 3, words, "ff", "s#es"), (1, 4, 4, "meta.unknown", "x", "s"), (2, 1, 5, count, "", "s")], 0)
    assert fold([(1, 5, 6, count, "2", "s"), (1, 6, 7, count, "3", "s"), (1, 7, 8, words, "ff", "s#en"), (1, 8, 9, count, None, "s"), (2, 2, 10, count, None, "s")], 1)
    assert not fold([(1, 9, 11, count, "7", "s")], 1)
    found = [tuple(r) for r in profiles.versions().orderBy("actor", "version").select("actor", "version", "slot", "value", "language", "role").collect()]
    assert found == [
        (1, 1, "message_count", "2", None, None),
        (1, 2, "function_word_simhash", "ff", "es", None),
        (1, 3, "message_count", "3", None, "busy"),
        (1, 4, "message_count", None, None, None),
        (2, 1, "message_count", None, None, None),
    ]


def test_slots_are_named_once():
    names = [p for block in BLOCKS.values() for p in block]
    assert len(names) == len(set(names)) == 25


def test_slices_hold_every_row_once(spark):
    rows = spark.range(50).select("id", F.when(F.col("id") > 0, F.timestamp_micros(F.col("id") * 1000)).alias("ts"))
    parts = by_time(rows, 4)
    assert sum(p.count() for p in parts) == 50 and len(parts) == 4
    assert by_time(rows.where("id < 0"), 4)[0].count() == 0


def test_late_rows_are_dropped_and_early_ones_kept(spark):
    """Of the rows that come late, those of open windows count and those of closed ones do not."""
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    held = by_time(events, 3)[0].where("event_id % 10 = 3").count()
    kept = load_all()[0]["late_windows"](spark, sf).agg(F.sum("n")).first()[0]
    assert events.count() - held < kept < events.count()


def test_a_slice_is_read_without_the_others(spark):
    rows = spark.range(1000).selectExpr("id", "id % 10 AS batch", "IF(id % 7 = 0, NULL, 'x') AS s")
    found = dealt(rows, "batch")
    assert sorted(map(tuple, found.select("id", "batch", "s").collect())) == sorted(map(tuple, rows.collect()))
    part = found.where("batch = 3")
    assert part.count() == 100 and "PartitionFilters: [isnotnull(batch" in part._jdf.queryExecution().executedPlan().toString()
    assert dealt(rows.where("id < 0"), "batch").count() == 0
