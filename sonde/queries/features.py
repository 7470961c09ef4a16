"""Author features over events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonde.operators import features as ops
from sonde.queries import query
from sonde.sources.tables import load, load_utc

META = """
SELECT user_id AS actor, count(*) AS total_messages, min(ts) AS first_seen, max(ts) AS last_seen,
       count(DISTINCT ts::DATE) AS active_days, date_diff('microsecond', min(ts), max(ts)) / 86400e6 AS span FROM events GROUP BY 1
"""
STATS = f"""
SELECT actor, total_messages, first_seen, last_seen, active_days, round(span, 6) AS span_days,
       round(total_messages / nullif(span, 0), 6) AS per_day, CASE WHEN span > 0 THEN round(least(1.0, active_days / span), 6) END AS density,
       CASE WHEN total_messages >= 100 AND active_days >= 7 THEN 'high' WHEN total_messages >= 30 AND active_days >= 2 THEN 'medium' ELSE 'low' END AS confidence
FROM ({META})
"""
COUNTS = """
SELECT a.user_id AS actor, k.k::INTEGER AS k, count(e.ts) AS n FROM (SELECT DISTINCT user_id FROM events) a
CROSS JOIN (SELECT unnest(range(0, 24)) AS k) k LEFT JOIN events e ON e.user_id = a.user_id AND hour(e.ts) = k.k GROUP BY 1, 2
"""


@query(STATS)
def meta_stats(spark, sf_dir):
    seen = ops.meta_stats(load_utc(spark, sf_dir, "events"), "user_id", "ts")
    return seen.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


def _histogram(expr: str, bins: int) -> str:
    return f"""
WITH b AS (SELECT user_id AS actor, ({expr})::INTEGER AS bin, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT actor, sum(n) AS total FROM b GROUP BY 1)
SELECT t.actor, k.bin::INTEGER AS bin, round(coalesce(b.n, 0) / t.total, 6) AS share
FROM t CROSS JOIN (SELECT unnest(range(0, {bins})) AS bin) k LEFT JOIN b ON b.actor = t.actor AND b.bin = k.bin
"""


@query(_histogram("hour(ts)", 24))
def hour_histogram(spark, sf_dir):
    return ops.histogram(load_utc(spark, sf_dir, "events"), "user_id", F.hour("ts"), 24)


@query(_histogram("isodow(ts) - 1", 7))
def dow_histogram(spark, sf_dir):
    return ops.histogram(load_utc(spark, sf_dir, "events"), "user_id", F.weekday("ts"), 7)


@query(_histogram("(isodow(ts) - 1) * 24 + hour(ts)", 168))
def hour_dow_histogram(spark, sf_dir):
    return ops.histogram(load_utc(spark, sf_dir, "events"), "user_id", F.weekday("ts") * 24 + F.hour("ts"), 168)


QUIET = f"""
WITH c AS ({COUNTS}), q AS (SELECT *, n < 0.10 * max(n) OVER (PARTITION BY actor) AS quiet, first_value(k) OVER (PARTITION BY actor ORDER BY n, k) AS least FROM c),
f AS (SELECT actor, min(k) FILTER (NOT quiet) AS offs FROM q GROUP BY 1),
s AS (SELECT q.actor, q.k, q.least, (q.k - f.offs + 24) % 24 AS nth FROM q JOIN f USING (actor) JOIN q p ON p.actor = q.actor AND p.k = (q.k + 23) % 24 WHERE q.quiet AND NOT p.quiet),
l AS (SELECT s.*, (SELECT min((b.k - s.k + 24) % 24) FROM q b WHERE b.actor = s.actor AND NOT b.quiet) AS n FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY n DESC, (least - k + 24) % 24 < n DESC, nth) AS rn FROM l)
SELECT a.actor, r.k::INTEGER AS quiet_start, r.n::INTEGER AS quiet_hours FROM (SELECT DISTINCT actor FROM c) a LEFT JOIN r ON r.actor = a.actor AND rn = 1
"""
DENSITY = f"""
WITH c AS ({COUNTS}), w AS (SELECT a.actor, a.k AS start, sum(b.n)::BIGINT AS total FROM c a JOIN c b ON b.actor = a.actor AND (b.k - a.k + 24) % 24 < 7 GROUP BY 1, 2)
SELECT actor, start, total FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY total, start) AS rn FROM w) WHERE rn = 1
"""


@query(QUIET)
def quiet_span(spark, sf_dir):
    return ops.quiet_span(ops.hour_counts(load_utc(spark, sf_dir, "events"), "user_id", "ts"))


@query(DENSITY)
def min_density_window(spark, sf_dir):
    return ops.min_density_window(ops.hour_counts(load_utc(spark, sf_dir, "events"), "user_id", "ts"))


@query(
    f"""
WITH q AS ({QUIET}), d AS ({DENSITY}),
m AS (SELECT actor, quiet_start IS NOT NULL AS gated, round_even(3.5 - (coalesce(quiet_start, start) + coalesce(quiet_hours, 7) / 2.0) % 24, 0)::INTEGER AS raw FROM d LEFT JOIN q USING (actor))
SELECT actor, (CASE WHEN raw > 14 THEN raw - 24 WHEN raw < -12 THEN raw + 24 ELSE raw END)::INTEGER AS utc_offset, gated FROM m
"""
)
def utc_offset(spark, sf_dir):
    counts = ops.hour_counts(load_utc(spark, sf_dir, "events"), "user_id", "ts")
    return ops.utc_offset(ops.quiet_span(counts), ops.min_density_window(counts))


@query(
    """
WITH g AS (SELECT user_id AS actor, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 AS gap FROM events)
SELECT actor, count(*) AS n_gaps, round(median(gap), 4) AS gap_median, round(stddev_pop(gap) / avg(gap), 4) AS gap_cv FROM g WHERE gap > 0 GROUP BY 1
"""
)
def gap_stats(spark, sf_dir):
    return ops.gap_stats(load_utc(spark, sf_dir, "events"), "user_id", "ts", "event_id")


def _halves(second: str) -> str:
    return f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT user_id, ({second})::INTEGER AS half, count(*) AS n, round(sum(value), 4) AS total_value FROM n GROUP BY 1, 2
"""


def _half_sums(spark, sf_dir, interleaved):
    rows = ops.halves(load_utc(spark, sf_dir, "events"), "user_id", "ts", "event_id", interleaved)
    return rows.groupBy("user_id", "half").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total_value"))


@query(_halves("nth >= total // 2"))
def chronological_halves(spark, sf_dir):
    return _half_sums(spark, sf_dir, False)


@query(_halves("nth % 2 = 1"))
def interleaved_halves(spark, sf_dir):
    return _half_sums(spark, sf_dir, True)


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id >= 0 GROUP BY 1 HAVING count(*) >= 60")
def sender_floor(spark, sf_dir):
    senders = load(spark, sf_dir, "events").where("user_id >= 0").groupBy("user_id").agg(F.count("*").alias("n"))
    return senders.where("n >= 60")


@query(
    """
SELECT role AS actor, count(*) AS n, round(avg((turn = 0)::INTEGER), 6) AS initiation_rate FROM conversations GROUP BY 1 HAVING count(*) >= 10
"""
)
def initiation_rate(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    rate = F.round(F.avg((F.col("turn") == 0).cast("int")), 6)
    return turns.groupBy(F.col("role").alias("actor")).agg(F.count("*").alias("n"), rate.alias("initiation_rate")).where("n >= 10")


CLASSES = """
WITH w AS (SELECT source AS actor, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS n FROM documents),
a AS (SELECT actor, count(*) AS k, median(n) AS mid, avg(n) AS mean, stddev_samp(n) AS sd FROM w GROUP BY 1 HAVING count(*) >= 5)
SELECT actor, CASE WHEN mid <= 5 THEN 'short' WHEN mid <= 20 THEN 'medium' WHEN mid <= 50 THEN 'long' ELSE 'paragraph' END AS length_class,
       CASE WHEN mean = 0 OR sd / mean < 0.5 THEN 'tight' WHEN sd / mean < 1.5 THEN 'varied' ELSE 'bimodal' END AS variance_class FROM a
"""


@query(CLASSES)
def message_length_class(spark, sf_dir):
    return ops.length_classes(load(spark, sf_dir, "documents"), "source", "text")


@query(
    """
SELECT role AS actor, count(*) AS n, round(avg((turn > 0)::INTEGER), 6) AS reply_rate, round(avg(regexp_matches(text, '@[A-Za-z0-9_]')::INTEGER), 6) AS mention_rate,
       round(avg(length(text)), 4) AS mean_chars, round(median(length(text)), 4) AS median_chars, round(stddev_pop(length(text)) / avg(length(text)), 6) AS length_cv
FROM conversations GROUP BY 1
"""
)
def interaction_features(spark, sf_dir):
    size = F.length("text")
    return (
        load(spark, sf_dir, "conversations")
        .groupBy(F.col("role").alias("actor"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg((F.col("turn") > 0).cast("int")), 6).alias("reply_rate"),
            F.round(F.avg(F.regexp_like("text", F.lit("@[A-Za-z0-9_]")).cast("int")), 6).alias("mention_rate"),
            F.round(F.avg(size), 4).alias("mean_chars"),
            F.round(F.median(size), 4).alias("median_chars"),
            F.round(F.stddev_pop(size) / F.avg(size), 6).alias("length_cv"),
        )
    )


@query(
    f"""
WITH s AS ({STATS}), c AS (
  SELECT actor, CASE WHEN per_day <= 2.0 AND span_days >= 7.0 THEN round(least(1.0, total_messages / 20.0) * (1 - per_day / 2.0), 4) ELSE 0 END AS lurker,
         CASE WHEN total_messages >= 195 THEN round(least(1.0, total_messages / 20.0) * least(1.0, total_messages / 975.0), 4) ELSE 0 END AS chatty FROM s)
SELECT actor, CASE WHEN lurker >= chatty THEN 'lurker_or_observer' ELSE 'chatty_member' END AS role, greatest(lurker, chatty)::DOUBLE AS confidence FROM c WHERE greatest(lurker, chatty) > 0
"""
)
def roles(spark, sf_dir):
    return ops.roles(ops.meta_stats(load_utc(spark, sf_dir, "events"), "user_id", "ts"))


@query(
    f"WITH s AS ({STATS})"
    + """
SELECT actor, 'meta.total_messages' AS primitive, 'numeric' AS value_kind, total_messages::DOUBLE AS value_numeric, NULL::VARCHAR AS value_enum FROM s
UNION ALL SELECT actor, 'meta.corpus_span_days', 'numeric', span_days, NULL FROM s
UNION ALL SELECT actor, 'meta.active_days', 'numeric', active_days::DOUBLE, NULL FROM s
UNION ALL SELECT actor, 'meta.fingerprint_confidence', 'enum', CASE confidence WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 ELSE 0.3 END::DOUBLE, confidence FROM s
"""
)
def observations(spark, sf_dir):
    """Features as a union of typed values, one row for each."""
    stats = ops.meta_stats(load_utc(spark, sf_dir, "events"), "user_id", "ts")
    level = F.when(F.col("confidence") == "high", 0.9).when(F.col("confidence") == "medium", 0.6).otherwise(0.3)
    none = F.lit(None).cast("string")
    number = lambda name, c: F.struct(F.lit(name).alias("primitive"), F.lit("numeric").alias("value_kind"), c.cast("double").alias("value_numeric"), none.alias("value_enum"))
    values = F.array(
        number("meta.total_messages", F.col("total_messages")),
        number("meta.corpus_span_days", F.col("span_days")),
        number("meta.active_days", F.col("active_days")),
        F.struct(F.lit("meta.fingerprint_confidence").alias("primitive"), F.lit("enum").alias("value_kind"), level.alias("value_numeric"), F.col("confidence").alias("value_enum")),
    )
    return stats.select("actor", F.inline(values))


@query(
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3"
)
def latest_n(spark, sf_dir):
    newest = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return load(spark, sf_dir, "events").withColumn("rn", F.row_number().over(newest)).where("rn <= 3").select("user_id", "event_id", "value")


@query(
    """
WITH c AS (SELECT user_id, event_id, sha256(concat(event_id, ':', event_type, ':', props)) AS self_hash FROM events),
p AS (SELECT *, lag(self_hash) OVER (PARTITION BY user_id ORDER BY event_id) AS expected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM c),
b AS (SELECT *, CASE WHEN event_id % 97 = 5 THEN 'broken' ELSE expected END AS prev_hash FROM p)
SELECT user_id, min(CASE WHEN prev_hash IS DISTINCT FROM expected THEN seq END) AS first_bad, max_by(self_hash, seq) AS head FROM b GROUP BY 1
"""
)
def hash_chain(spark, sf_dir):
    """Verification of an append-only chain: the first entry whose predecessor's hash is wrong, and the head."""
    own = W.partitionBy("user_id").orderBy("event_id")
    chain = load(spark, sf_dir, "events").withColumn("self_hash", F.sha2(F.concat_ws(":", "event_id", "event_type", "props"), 256))
    linked = chain.withColumn("expected", F.lag("self_hash").over(own)).withColumn("seq", F.row_number().over(own).cast("long"))
    stored = linked.withColumn("prev_hash", F.when(F.col("event_id") % 97 == 5, "broken").otherwise(F.col("expected")))
    bad = F.when(~F.col("prev_hash").eqNullSafe(F.col("expected")), F.col("seq"))
    return stored.groupBy("user_id").agg(F.min(bad).alias("first_bad"), F.max_by("self_hash", "seq").alias("head"))
