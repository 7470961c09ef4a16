"""Semi-structured records over events, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import records as ops
from sonde.queries import query
from sonde.sources.tables import load


@query("SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events")
def json_pivot(spark, sf_dir):
    return ops.pivot_json(load(spark, sf_dir, "events"), "event_id", "props")


@query("SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS kinds, count(*) FILTER (coalesce(json_extract_string(props, '$.missing'), '') = '') AS missing FROM events GROUP BY 1")
def map_lookup(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("fields", F.from_json("props", "map<string,string>"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(ops.lookup("fields", "k")).alias("kinds"), F.count_if(ops.lookup("fields", "missing") == "").alias("missing"))


@query("SELECT page_id, coalesce(string_split(url, '/')[3], '') AS host_part, coalesce(string_split(url, '/')[4], '') AS second, coalesce(string_split(url, '/')[9], '') AS ninth FROM pages")
def path_parts(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", *[ops.path_part(F.col("url"), n).alias(a) for n, a in ((3, "host_part"), (4, "second"), (9, "ninth"))])


@query("SELECT count(DISTINCT (o_orderstatus, o_orderpriority)) AS identities FROM orders")
def record_identity(spark, sf_dir):
    """Identity hashes of maps whose entries come in either order."""
    a, b = ("s", F.col("o_orderstatus")), ("p", F.col("o_orderpriority"))
    pair = lambda x, y: F.create_map(F.lit(x[0]), x[1], F.lit(y[0]), y[1])
    fields = F.when(F.col("o_orderkey") % 2 == 0, pair(a, b)).otherwise(pair(b, a))
    return load(spark, sf_dir, "orders").select(ops.identity(fields).alias("id")).agg(F.countDistinct("id").alias("identities"))


@query(
    """
SELECT o_orderkey, epoch_ms((CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey * 1000 END) * 1000) AS at, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate END AS parsed FROM orders
"""
)
def time_parsing(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 10 == 0, "none").otherwise((F.col("o_orderkey") * 1000).cast("string"))
    day = F.to_timestamp(F.col("o_orderdate"))
    kind = F.col("o_orderkey") % 4
    written = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 1, F.date_format(day, "dd.MM.yyyy")).when(kind == 2, F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss")).otherwise("soon")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", ops.epoch(text).cast("timestamp_ntz").alias("at"), ops.parse_time(written).cast("timestamp_ntz").alias("parsed"))
    return rows


@query("SELECT p_partkey, upper(substr(replace(trim(p_name), ' ', '-'), 1, 8)) AS name, regexp_extract(p_brand, '-?[0-9]+') AS brand FROM part")
def normalise_verbs(spark, sf_dir):
    name = ops.normalised(F.col("p_name"), ("strip",), ("replace", " ", "-"), ("truncate", 8), ("upper",))
    return load(spark, sf_dir, "part").select("p_partkey", name.alias("name"), ops.normalised(F.col("p_brand"), ("int_from_string",)).alias("brand"))


@query(
    r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages
"""
)
def html_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", ops.html_text(F.col("html")).alias("text"))


@query("SELECT CASE WHEN starts_with(html, '<!DOCTYPE html') OR starts_with(html, '<html') THEN 'html' WHEN starts_with(html, '{') THEN 'json' ELSE 'text' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def sniffed_kinds(spark, sf_dir):
    return load(spark, sf_dir, "pages").groupBy(ops.sniffed(F.col("html")).alias("kind")).agg(F.count("*").alias("n"))
