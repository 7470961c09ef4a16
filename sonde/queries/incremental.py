"""Tables that arrive slice by slice: cursors, flushes, views, distinct sets, profile versions and late rows, each against the SQL of its final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.operators.views import AggregateView, DistinctSets, RefreshableView
from sonde.queries import query
from sonde.sources.tables import load, load_utc
from sonde.streaming import streams as st
from sonde.streaming.cursors import Cursors
from sonde.streaming.flush import Flush
from sonde.streaming.profiles import ProfileVersions
from sonde.streaming.replay import batches, by_time, dealt, fresh_dir, replay

#: What each primitive reads.
PRIMITIVES = {"all": "true", "purchases": "event_type = 'purchase'", "large": "value >= 100"}


@query(
    f"""
WITH r AS ({" UNION ALL ".join(f"SELECT user_id, '{name}' AS primitive, ts, event_id, value FROM events WHERE {condition}" for name, condition in PRIMITIVES.items())}),
p AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, primitive ORDER BY ts, event_id) AS pause FROM r)
SELECT user_id::VARCHAR AS key, primitive, max(epoch_us(ts)) AS us, arg_max(event_id, ts) AS id, count(*) AS n, max(pause) AS pause, round(sum(value), 2) AS total, 0::BIGINT AS late FROM p GROUP BY 1, 2
"""
)
def cursor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events read on by three primitives, each from its own cursor, over a stream that is started anew for each slice."""
    cursors = Cursors(spark, fresh_dir(spark, "cursors"), PRIMITIVES)

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"key": F.col("user_id").cast("string"), "us": F.unix_micros("ts"), "id": F.col("event_id")})
        cursors.advance(rows, number)

    replay(by_time(load_utc(spark, sf_dir, "events"), 4), lambda stream, checkpoint: batches(stream, checkpoint, keep))
    return cursors.read().withColumn("total", F.round("total", 2)).drop("step")


@query(
    """
SELECT event_id, user_id, list_filter([CASE WHEN event_type = 'error' THEN 'failure' END, CASE WHEN value >= 150 THEN 'large' END], lambda l: l IS NOT NULL) AS labels
FROM events WHERE event_type = 'error' OR value >= 150
"""
)
def flushed_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that arrive in slices, the last hours of each slice twice: bodies are fetched for a batch at once, what fires is stored once."""
    events = load_utc(spark, sf_dir, "events")
    labels = F.array_compact(F.array(F.when(F.col("event_type") == "error", F.lit("failure")), F.when(F.col("value") >= 150, F.lit("large"))))
    flush = Flush(
        spark,
        fresh_dir(spark, "flush"),
        "event_id",
        lambda refs: events.join(refs, "event_id"),
        lambda rows: rows.select("event_id", "user_id", labels.alias("labels")).where(F.size("labels") > 0),
    )
    parts = by_time(events, 3)
    again = [p.where(F.hour("ts") >= 20) for p in parts]
    arriving = [parts[0], parts[1].unionByName(again[0]), parts[2].unionByName(again[1])]
    replay([a.select("event_id") for a in arriving], lambda stream, checkpoint: batches(stream, checkpoint, flush))
    return flush.read()


MEASURES = {"n": ("count", "1"), "quantity": ("sum", "cast(l_quantity AS decimal(18,2))"), "first": ("min", "l_shipdate"), "last": ("max", "l_shipdate"), "returned": ("flag", "l_returnflag = 'R'")}


@query(
    """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_linestatus AS status, count(*) AS n, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS quantity, min(l_shipdate) AS first, max(l_shipdate) AS last, bool_or(l_returnflag = 'R') AS returned,
       count(DISTINCT (l_partkey, l_suppkey)) AS offers, count(DISTINCT l_orderkey) FILTER (WHERE l_discount > 0.05) AS cut_orders
FROM lineitem GROUP BY 1, 2
"""
)
def append_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of mergeable states after ten inserts, the third of which came twice."""
    rows = load(spark, sf_dir, "lineitem").withColumns({"day": F.date_format("l_shipdate", "yyyy-MM-dd"), "status": F.col("l_linestatus"), "batch": F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(10))})
    distinct = {"offers": (["l_partkey", "l_suppkey"], "true"), "cut_orders": (["l_orderkey"], "l_discount > 0.05")}
    view = AggregateView(spark, fresh_dir(spark, "view"), ["day", "status"], MEASURES, distinct, most_parts=4)
    arrived = dealt(rows.select("batch", "day", "status", "l_shipdate", "l_quantity", "l_returnflag", "l_partkey", "l_suppkey", "l_orderkey", "l_discount"), "batch")
    for batch in (0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9):
        view.insert(arrived.where(F.col("batch") == batch), "lineitem", batch)
    return view.read().withColumn("quantity", F.col("quantity").cast("double"))


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01') AS late FROM orders GROUP BY 1")
def refreshed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refreshable view after two refreshes, the first from what had come by then; readers see one whole version."""
    rows = load(spark, sf_dir, "orders")
    view = RefreshableView(spark, fresh_dir(spark, "refreshed"))
    build = lambda part: part.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.expr("o_orderdate >= timestamp_ntz '1997-01-01'")).alias("late"))
    view.refresh(build(rows.where("o_orderdate < timestamp_ntz '1996-01-01'")))
    view.refresh(build(rows))
    return view.read()


@query("SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS n FROM lineitem GROUP BY 1")
def merged_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts from stored sets of three loads that overlap, two of them merged from another store."""
    rows = load(spark, sf_dir, "lineitem")
    here, there = (DistinctSets(spark, fresh_dir(spark, name), ["l_returnflag"], ["l_partkey", "l_suppkey"]) for name in ("sets", "more-sets"))
    there.add(rows.where("l_linenumber >= 5"), "third")
    there.add(rows.where("l_linenumber BETWEEN 2 AND 5"), "second")
    here.merge(there)
    here.add(rows.where("l_linenumber <= 3"), "first")
    return here.counts()


#: Which primitive an event's type stands for, a fifth is mapped to no slot, and roles from slots.
OBSERVED = {"view": "meta.total_messages", "click": "stylometric.message_length_class", "purchase": "lexical.vocabulary_richness", "signup": "stylometric.pos_ngram_signature", "error": "meta.unknown"}
ROLES = [("both", {"message_count": 2, "mattr": 2}), ("reader", {"message_count": 2}), ("buyer", {"mattr": 1})]


@query(
    """
WITH o AS (
  SELECT user_id AS actor, epoch_us(ts) AS us, event_id AS id,
         CASE event_type WHEN 'view' THEN 'temporal_summary' WHEN 'purchase' THEN 'lexical_summary' ELSE 'stylometric_summary' END AS block,
         CASE event_type WHEN 'view' THEN 'message_count' WHEN 'click' THEN 'message_length_class' WHEN 'purchase' THEN 'mattr' ELSE 'pos_ngram_signature' END AS slot,
         CASE WHEN value >= 25 THEN floor(value / 25)::BIGINT::VARCHAR END AS value,
         CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' END END AS language
  FROM events WHERE event_type <> 'error'
), c AS (
  SELECT *, lag(value) OVER (PARTITION BY actor, slot ORDER BY us, id) AS earlier, row_number() OVER (PARTITION BY actor ORDER BY us, id) AS nth FROM o
), k AS (SELECT * FROM c WHERE nth = 1 OR value IS DISTINCT FROM earlier
), l AS (
  SELECT *, row_number() OVER w AS version, max(CASE WHEN slot = 'message_count' THEN id END) OVER w AS at_count, max(CASE WHEN slot = 'mattr' THEN id END) OVER w AS at_mattr
  FROM k WINDOW w AS (PARTITION BY actor ORDER BY us, id)
)
SELECT l.actor, l.version, l.block, l.slot, l.value, l.language, l.us, l.id,
       CASE WHEN a.value::INT >= 2 AND b.value::INT >= 2 THEN 'both' WHEN a.value::INT >= 2 THEN 'reader' WHEN b.value::INT >= 1 THEN 'buyer' END AS role
FROM l LEFT JOIN o a ON a.id = l.at_count LEFT JOIN o b ON b.id = l.at_mattr
"""
)
def profile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of every user's profile from observations that arrive in slices; one is emitted only where a slot's value differs."""
    profiles = ProfileVersions(spark, fresh_dir(spark, "profiles"), ROLES)
    kinds = F.create_map(*[F.lit(x) for pair in OBSERVED.items() for x in pair])

    def keep(batch: DataFrame, number: int) -> None:
        profiles.fold(
            batch.select(
                F.col("user_id").alias("actor"),
                F.unix_micros("ts").alias("us"),
                F.col("event_id").alias("id"),
                kinds[F.col("event_type")].alias("primitive"),
                F.when(F.col("value") >= 25, F.floor(F.col("value") / 25).cast("string")).otherwise("").alias("value"),
                F.concat(F.lit("sensor#"), F.element_at(F.array(*map(F.lit, ("en", "es", "xx"))), (F.col("event_id") % 3 + 1).cast("int"))).alias("source"),
            ),
            number,
        )

    replay(by_time(load_utc(spark, sf_dir, "events"), 3), lambda stream, checkpoint: batches(stream, checkpoint, keep))
    return profiles.versions()


#: Rows that arrive after the others: with the next slice, while their window is open, or with the last one, when it is closed.
LATE_SQL = """
WITH b AS (SELECT min(epoch_us(ts)) AS low, (max(epoch_us(ts)) - min(epoch_us(ts))) // 3 + 1 AS step FROM events),
e AS (SELECT ts, value, event_id, least((epoch_us(ts) - low) // step, 2) AS slice FROM events, b),
m AS (SELECT max(epoch_us(ts)) FILTER (WHERE slice = 0 AND event_id % 10 <> 3) AS first FROM e),
kept AS (SELECT e.* FROM e, m WHERE NOT (slice = 0 AND event_id % 10 = 3 AND epoch_us(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY) // 1000 <= first // 1000 - 86400000))
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM kept GROUP BY 1
"""


@query(LATE_SQL)
def late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows over a stream in which a tenth of the first slice's rows come with the second one: those of windows that the watermark, a day
    behind the latest row seen, has passed are dropped; those of open windows count."""
    first, *rest = by_time(load_utc(spark, sf_dir, "events"), 3)
    held = F.col("event_id") % 10 == 3
    slices = [first.where(~held), rest[0].unionByName(first.where(held)), rest[1]]
    base = fresh_dir(spark, "late")

    def run(stream: DataFrame, checkpoint: str) -> None:
        found = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
        keep = lambda batch, number: batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        st.run_out(found, "update", checkpoint, keep)

    replay(slices, run)
    rows = st.newest(spark.read.parquet(f"{base}/out/*"), ["w"], ["__batch"])
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")
