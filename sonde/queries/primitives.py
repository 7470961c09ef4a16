"""All features of the documents' sources as typed observations, the documents taken as messages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sonde.operators import primitives as ops
from sonde.plans.lineage import materialize, shared_dir
from sonde.queries import query
from sonde.queries.features import QUIET
from sonde.sources.tables import load, spread

#: Markers of regions; a parameter of the operator, here words of the driver's texts.
REGIONS = {"coast": ["puerto", "agua", "barco", "playa"], "plain": ["campo", "ciudad", "casa"], "hills": ["camino", "piedra", "noche", "tierra", "monte"]}
START, STEP, TURN = 1_704_067_200_000_000, 48_271, 2_147_483_647


def _messages(spark, sf_dir):
    """Documents as messages of their sources, at times spread over some weeks by their ids; each third one opens a talk."""
    us = F.lit(START) + F.col("doc_id") * STEP % TURN * 1000
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select(F.col("source").alias("actor"), F.col("doc_id").alias("id"), us.alias("us"), "text", (F.col("doc_id") % 3 == 0).alias("opened"))


def _found(text: str, pattern: str) -> str:
    return f"regexp_extract_all(lower({text}), '{pattern.replace(chr(39), chr(39) * 2)}')"


def _words(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _plain(word: str) -> str:
    """One byte a letter, since DuckDB's levenshtein counts bytes."""
    marked = ops.LETTERS.removeprefix("a-z")
    return f"translate({word}, '{marked}', '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[: len(marked)]}')"


MARKERS = ", ".join(f"('{r}', '{w}')" for r, words in REGIONS.items() for w in words)
SURE = "CASE tier WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 ELSE 0.3 END"
NO_TEXT, NO_ID, NO_NUMBER = "NULL::VARCHAR", "NULL::BIGINT", "NULL::DOUBLE"


def _bins(name: str, expr: str, bins: int) -> str:
    return f"""
SELECT seen.actor, 'circadian.{name}', 'bins', {NO_NUMBER}, b.bins, {SURE}, {NO_ID} FROM seen JOIN (
  SELECT a.actor, string_agg(round(coalesce(n, 0) / total * 1e6)::BIGINT::VARCHAR, ',' ORDER BY k) AS bins FROM (SELECT actor, total, unnest(range(0, {bins})) AS k FROM seen) a
  LEFT JOIN (SELECT actor, {expr} AS k, count(*) AS n FROM m GROUP BY 1, 2) c USING (actor, k) GROUP BY 1) b USING (actor)"""


QUIET_OF_SOURCES = QUIET.replace("SELECT DISTINCT user_id FROM events", "SELECT DISTINCT actor AS user_id FROM m").replace("FROM events", "FROM m").replace("LEFT JOIN events e ON e.user_id", "LEFT JOIN m e ON e.actor")
NUMBERS = {
    "total_messages": "total", "corpus_span_days": "round(span, 6)", "msg_per_day": "round(total / nullif(span, 0), 6)", "active_days": "days",
    "activity_density": "CASE WHEN span > 0 THEN round(least(1.0, days / span), 6) END", "first_seen_ts": "first_us / 1e6", "last_seen_ts": "last_us / 1e6",
}

SQL = f"""
WITH u AS (SELECT source AS actor, doc_id AS id, {START} + doc_id * {STEP} % {TURN} * 1000 AS us, text, doc_id % 3 = 0 AS opened FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL),
m AS MATERIALIZED (SELECT *, make_timestamp(us) AS ts FROM u),
s AS (SELECT actor, count(*) AS total, count(text) AS bodies, count(*) FILTER (opened) AS opened, min(us) AS first_us, max(us) AS last_us, arg_max(id, (us, id)) AS last_id,
             count(DISTINCT ts::DATE) AS days, coalesce(sum(len({_found("text", ops.TOKEN)})), 0)::BIGINT AS tokens FROM m GROUP BY 1),
seen AS MATERIALIZED (SELECT *, (last_us - first_us) / 86400e6 AS span, CASE WHEN total >= 100 AND days >= 7 THEN 'high' WHEN total >= 30 AND days >= 2 THEN 'medium' ELSE 'low' END AS tier FROM s),
lens AS (SELECT actor, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w FROM m WHERE text IS NOT NULL),
spread AS (SELECT actor, median(w) AS mid, avg(w) AS mean, stddev_samp(w) AS sd FROM lens GROUP BY 1 HAVING count(*) >= 5),
wordy AS MATERIALIZED (SELECT actor, w, count(*) AS k FROM (SELECT actor, id, unnest(list_distinct({_found("text", ops.WORD)})) AS w FROM m) GROUP BY 1, 2 HAVING count(*) >= 3),
wide AS (SELECT actor FROM wordy GROUP BY 1 HAVING count(*) >= 20),
typo AS (SELECT a.actor, a.w FROM wordy a JOIN wordy b ON a.actor = b.actor AND b.k >= 5 * a.k AND abs(length(a.w) - length(b.w)) <= 1 AND levenshtein({_plain("a.w")}, {_plain("b.w")}) = 1 GROUP BY 1, 2),
typos AS (SELECT seen.actor, coalesce(string_agg(w, ',' ORDER BY w), '') AS t FROM seen JOIN wide USING (actor) LEFT JOIN typo USING (actor) WHERE bodies >= 15 GROUP BY 1),
used AS MATERIALIZED (SELECT DISTINCT actor, w FROM (SELECT actor, unnest({_found("text", ops.TOKEN)}) AS w FROM m)),
gate AS (SELECT actor, count(*) FILTER (w IN {_words(ops.FUNCTION_WORDS["es"][: ops.GATE])}) AS es, count(*) FILTER (w IN {_words(ops.FUNCTION_WORDS["en"][: ops.GATE])}) AS en FROM used GROUP BY 1),
hits AS (SELECT actor, region, count(*) AS hits FROM used JOIN (VALUES {MARKERS}) v(region, w) USING (w) GROUP BY 1, 2),
rank AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY hits DESC, region DESC) AS rn FROM hits),
dial AS (SELECT seen.*, a.region, a.hits AS top, b.hits AS second, coalesce(a.hits, 0) / tokens AS rate FROM seen JOIN gate USING (actor) LEFT JOIN rank a ON a.actor = seen.actor AND a.rn = 1
         LEFT JOIN rank b ON b.actor = seen.actor AND b.rn = 2 WHERE bodies >= 10 AND tokens > 0 AND es >= en),
tok AS (SELECT actor, us, id, i, w[i] AS t FROM (SELECT actor, us, id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT actor, us, id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM m))),
pos AS (SELECT actor, t, row_number() OVER (PARTITION BY actor ORDER BY us, id, i) - 1 AS p, count(*) OVER (PARTITION BY actor) AS n FROM tok),
prev AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY actor, t ORDER BY p), -1) AS q FROM pos WHERE n >= 100),
rich AS (SELECT actor, n, round(sum(greatest(least(p, n - 50) - greatest(q + 1, p - 49, 0) + 1, 0)) / (50.0 * (n - 49)), 6) AS v FROM prev GROUP BY 1, 2),
quiet AS ({QUIET_OF_SOURCES})
SELECT actor, primitive, value_kind, value_numeric, value_text, round(confidence, 6) AS confidence, evidence_id FROM (
{" UNION ALL ".join(f"SELECT actor, 'meta.{k}' AS primitive, 'numeric' AS value_kind, ({v})::DOUBLE AS value_numeric, {NO_TEXT} AS value_text, ({SURE})::DOUBLE AS confidence, {NO_ID} AS evidence_id FROM seen WHERE ({v}) IS NOT NULL" for k, v in NUMBERS.items())}
UNION ALL SELECT actor, 'meta.fingerprint_confidence', 'enum', {NO_NUMBER}, tier, {SURE}, {NO_ID} FROM seen
UNION ALL {" UNION ALL ".join(_bins(*b) for b in (("hour_histogram", "hour(ts)", 24), ("dow_histogram", "isodow(ts) - 1", 7), ("hour_dow_histogram", "(isodow(ts) - 1) * 24 + hour(ts)", 168)))}
UNION ALL SELECT actor, 'circadian.quiet_span_utc', 'span', {NO_NUMBER}, concat(quiet_start, ',', (quiet_start + quiet_hours) % 24), {SURE}, {NO_ID} FROM seen JOIN quiet USING (actor) WHERE quiet_start IS NOT NULL
UNION ALL SELECT actor, 'interaction.conversation_initiation_rate', 'numeric', round(opened / total, 6), {NO_TEXT}, least(1.0, total / 50), last_id FROM seen WHERE total >= 10
UNION ALL SELECT actor, 'stylometric.message_length_class', 'enum', {NO_NUMBER}, CASE WHEN mid <= 5 THEN 'short' WHEN mid <= 20 THEN 'medium' WHEN mid <= 50 THEN 'long' ELSE 'paragraph' END, least(1.0, total / 50), last_id FROM seen JOIN spread USING (actor)
UNION ALL SELECT actor, 'stylometric.message_length_variance_class', 'enum', {NO_NUMBER}, CASE WHEN mean = 0 OR sd / mean < 0.5 THEN 'tight' WHEN sd / mean < 1.5 THEN 'varied' ELSE 'bimodal' END, least(1.0, total / 50), last_id FROM seen JOIN spread USING (actor)
UNION ALL SELECT actor, 'stylometric.typo_signature', 'signature', {NO_NUMBER}, sha256(t)[1:16], least(1.0, bodies / 100), last_id FROM seen JOIN typos USING (actor)
UNION ALL SELECT actor, 'lexical.dialect_region', 'enum', {NO_NUMBER}, CASE WHEN rate < 0.001 OR top / second < 1.8 THEN 'unknown' ELSE region END,
                 CASE WHEN rate < 0.001 THEN 0 WHEN top / second < 1.8 THEN top / (top + second) ELSE least(1.0, rate * 500) END, last_id FROM dial
UNION ALL SELECT actor, 'lexical.vocabulary_richness', 'numeric', v, {NO_TEXT}, least(1.0, n / 1000), last_id FROM seen JOIN rich USING (actor))
"""


@query(SQL)
def primitive_observations(spark, sf_dir):
    """Every observation whose value SQL can express."""
    messages = _messages(spark, sf_dir)
    state = materialize(ops.states(messages), "counts")
    return ops.observations(state, REGIONS, ("rhythm", "lengths", "typos", "dialect")).unionByName(ops.richness(messages))


@query()
def folded_signatures(spark, sf_dir):
    """The signatures of sources, from counts that were stored in four slices."""
    stored, messages = ops.Folded(spark, f"{shared_dir(spark).rstrip('/')}/counts-{uuid.uuid4().hex}"), _messages(spark, sf_dir)
    for batch in range(4):
        stored.fold(messages.where(F.col("id") % 4 == batch), batch)
    state = materialize(stored.state(), "counts")
    return ops.observations(state, REGIONS, ("signatures",))
