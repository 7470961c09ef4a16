"""Streams over events, drained, against the SQL of their final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.queries import query
from sonde.streaming import streams as st


def _start(c: str = "w"):
    return F.col(f"{c}.start").cast("timestamp_ntz").alias("start")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    rows = st.drained(st.tumbling(st.event_stream(spark, sf_dir)), "update", ["w", "event_type"])
    return rows.select(_start(), "event_type", "n", "total")


@query(
    """
SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1
"""
)
def stream_sliding(spark, sf_dir):
    return st.drained(st.sliding(st.event_stream(spark, sf_dir)), "update", ["w"]).select(_start(), "n")


@query(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
"""
)
def batch_sessions(spark, sf_dir):
    """Session windows; the streaming form appends a session only once the watermark has passed it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.sessions(events).select("user_id", _start(), "n")


@query("SELECT user_id, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1")
def stream_fold(spark, sf_dir):
    return st.drained(st.folded(st.event_stream(spark, sf_dir)), "update", ["user_id"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return st.drained(st.event_stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")
