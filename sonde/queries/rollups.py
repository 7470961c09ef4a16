"""Roll-ups: exact, conditional and approximate distinct counts, coverage, picks, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonde.functions import text as tx
from sonde.operators import rollup as ops
from sonde.queries import query
from sonde.queries.joins import URL_HOST
from sonde.sources.tables import load, partitions_for


@query("SELECT count(*) AS total, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) AS identities FROM lineitem")
def distinct_tuples(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("total"),
        F.countDistinct("l_orderkey").alias("orders"),
        F.countDistinct("l_partkey").alias("parts"),
        F.countDistinct(F.struct("l_orderkey", "l_partkey", "l_suppkey")).alias("identities"),
    )


@query()
def approx_distinct(spark, sf_dir):
    """Mergeable sketches, daily ones united; within a few per cent of the exact counts."""
    daily = load(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.hll_sketch_agg("l_orderkey").alias("sketch"))
    return daily.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("orders"))


@query(
    f"""
SELECT tld, count(*) AS n, count(DISTINCT host) AS hosts FROM (SELECT h AS host, string_split(h, '.')[-1] AS tld FROM (SELECT {URL_HOST} AS h FROM pages)) GROUP BY 1 ORDER BY n DESC, tld LIMIT 10
"""
)
def corpus_stats(spark, sf_dir):
    hosts = load(spark, sf_dir, "pages").select(tx.url_host(F.col("url")).alias("host"))
    by = hosts.groupBy(F.element_at(F.split("host", r"\."), -1).alias("tld")).agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))
    return by.orderBy(F.desc("n"), "tld").limit(10)


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned, count(*) FILTER (l_tax > 0.05) AS taxed FROM lineitem GROUP BY 1")
def conditional_distinct(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.countDistinct("l_partkey").alias("parts"),
        F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned"),
        F.count_if(F.col("l_tax") > 0.05).alias("taxed"),
    )


@query(
    """
WITH r AS (SELECT l_suppkey, l_partkey, round(sum(l_discount) / sum(l_quantity), 9) AS ratio FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey AS best_part, ratio AS best_ratio FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY ratio DESC, l_partkey) AS rn FROM r) WHERE rn = 1
"""
)
def best_ratio(spark, sf_dir):
    ratio = F.round(F.sum("l_discount") / F.sum("l_quantity"), 9)
    rows = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(ratio.alias("ratio"))
    best = rows.groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("ratio", (-F.col("l_partkey")).alias("tie"))).alias("best_part"), F.max("ratio").alias("best_ratio"))
    return best


@query(
    """
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS usual FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM n) WHERE rn = 1
"""
)
def mode_pick(spark, sf_dir):
    """The mode with a defined tie: `mode()` would leave it open."""
    counts = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.min_by("event_type", F.struct((-F.col("n")).alias("n"), "event_type")).alias("usual"))


@query("SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_partkey))[1:10], ',') AS parts FROM lineitem GROUP BY 1")
def bounded_set(spark, sf_dir):
    """The ten smallest of each group's distinct values, kept by rank, so that no group is gathered whole."""
    own = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    first = own.withColumn("rn", F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_partkey"))).where("rn <= 10")
    return first.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list("l_partkey")), ",").alias("parts"))


@query(
    """
SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::INTEGER AS has_urgent, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS top_final, coalesce(min(CASE WHEN o_totalprice > 450000 THEN o_orderkey END), -1) AS first_large,
       count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS open_kinds, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY 1
"""
)
def flag_rollup(spark, sf_dir):
    """A profile of each customer: flags, picks and conditional distinct counts in one aggregate."""
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("has_urgent"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("top_final"),
        F.coalesce(F.min(F.when(F.col("o_totalprice") > 450000, F.col("o_orderkey"))), F.lit(-1)).alias("first_large"),
        F.countDistinct(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("open_kinds"),
        F.min("o_orderdate").alias("first_at"),
        F.max("o_orderdate").alias("last_at"),
    )


@query(
    """
SELECT l_suppkey, count(*) AS records, count(DISTINCT l_orderkey) AS owners, count(*) FILTER (l_shipdate > TIMESTAMP '1999-01-01') AS live, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1
"""
)
def domain_rollup(spark, sf_dir):
    """Live against all by a cut-off that is a parameter, never the clock."""
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("records"),
        F.countDistinct("l_orderkey").alias("owners"),
        F.count_if(F.col("l_shipdate") > F.lit("1999-01-01").cast("timestamp_ntz")).alias("live"),
        F.min("l_shipdate").alias("first_at"),
        F.max("l_shipdate").alias("last_at"),
    )


@query(
    """
SELECT l_suppkey, o_custkey, count(*) AS records, min(c_mktsegment) AS segment FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
"""
)
def domain_owner_rollup(spark, sf_dir):
    lines, orders, customer = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    rows = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("records"), F.min("c_mktsegment").alias("segment"))


@query(
    """
WITH f AS (SELECT d.source, d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
SELECT source, count(*) AS files, count(*) FILTER (hit) AS parsed, round(100.0 * count(*) FILTER (hit) / count(*), 1) AS percent FROM f GROUP BY 1
"""
)
def coverage(spark, sf_dir):
    return ops.coverage(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ["doc_id"], "source").select("source", "files", "parsed", "percent")


@query(
    f"""
WITH h AS (SELECT page_id, {URL_HOST} AS host FROM pages), r AS (SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM h), n AS (SELECT domain, host, count(*) AS n FROM r GROUP BY 1, 2)
SELECT domain, host, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, host) AS rn FROM n) WHERE rn <= 5
"""
)
def subdomains(spark, sf_dir):
    hosts = load(spark, sf_dir, "pages").select(tx.url_host(F.col("url")).alias("host"))
    counts = hosts.groupBy(tx.registrable(F.col("host")).alias("domain"), "host").agg(F.count("*").alias("n"))
    best = W.partitionBy("domain").orderBy(F.desc("n"), "host")
    return counts.withColumn("rn", F.row_number().over(best)).where("rn <= 5").drop("rn")


@query("SELECT event_type AS rule, count(*) AS hits, count(DISTINCT user_id) AS actors, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def rule_hits(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("rule")).agg(
        F.count("*").alias("hits"), F.countDistinct("user_id").alias("actors"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    """
WITH v AS (SELECT user_id, event_type, max(value) > 95 AS high FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS actors, count(*) FILTER (high) AS high, count(*) FILTER (NOT high) AS low FROM v GROUP BY 1
"""
)
def two_level(spark, sf_dir):
    """First per actor, then per product."""
    per = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.max("value") > 95).alias("high"))
    return per.groupBy("event_type").agg(F.count("*").alias("actors"), F.count_if("high").alias("high"), F.count_if(~F.col("high")).alias("low"))


@query("SELECT least(count(*), 10000) AS total, count(*) > 10000 AS capped FROM lineitem")
def count_cap(spark, sf_dir):
    return ops.capped_count(load(spark, sf_dir, "lineitem"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_final FROM customer")
def scalar_counts(spark, sf_dir):
    sums = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    rows = load(spark, sf_dir, "customer").join(sums, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("f", F.lit(0)).alias("n_final"))


@query("SELECT coalesce(max(n), 0) AS most_orders, coalesce(max(k), 0) AS most_kinds FROM (SELECT count(*) AS n, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY o_custkey)")
def max_bounds(spark, sf_dir):
    sums = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("k"))
    return sums.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_orders"), F.coalesce(F.max("k"), F.lit(0)).alias("most_kinds"))


@query("SELECT l_partkey AS candidate, round(least(1.0, 0.3 * count(DISTINCT l_suppkey) + 0.2 * count(DISTINCT l_returnflag)), 4)::DOUBLE AS score, min(l_linenumber) AS depth FROM lineitem GROUP BY 1")
def candidate_scores(spark, sf_dir):
    score = F.least(F.lit(1.0), 0.3 * F.countDistinct("l_suppkey") + 0.2 * F.countDistinct("l_returnflag"))
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("candidate")).agg(F.round(score, 4).alias("score"), F.min("l_linenumber").alias("depth"))


@query(
    """
SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1
"""
)
def bridge_summary(spark, sf_dir):
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    wide = load(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", list(names)).count().na.fill(0)
    return wide.select("o_orderstatus", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


@query(
    """
SELECT 'node' AS kind, 'customer' AS type, count(*) AS n FROM customer UNION ALL SELECT 'node', 'order', count(*) FROM orders UNION ALL SELECT 'edge', 'placed', count(*) FROM orders UNION ALL SELECT 'edge', 'contains', count(*) FROM lineitem
"""
)
def graph_stats(spark, sf_dir):
    count = lambda t, kind, type_: load(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(type_).alias("type"), "n")
    parts = [count("customer", "node", "customer"), count("orders", "node", "order"), count("orders", "edge", "placed"), count("lineitem", "edge", "contains")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    """
SELECT p_partkey, count(l.l_partkey) AS mentions, count(DISTINCT l.l_orderkey) AS orders, count(DISTINCT o.o_custkey) AS actors, min(l.l_shipdate) AS first_at, max(l.l_shipdate) AS last_at
FROM part LEFT JOIN lineitem l ON l.l_partkey = p_partkey LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1
"""
)
def artifact_browse(spark, sf_dir):
    """Distinct orders and actors by two groupings, of (part, order) and of (part, actor): two distinct counts in one aggregate would spell every line out three times."""
    part, lines, orders = (load(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    n = partitions_for(lines)
    # an order's key may come more than once: how often with an actor, and one actor that stands for the order
    held = orders.select("o_orderkey", "o_custkey").where("o_orderkey is not null").repartition(n, "o_orderkey").groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("times"))
    held = held.withColumn("one", (F.row_number().over(W.partitionBy("o_orderkey").orderBy("o_custkey")) == 1).cast("int"))
    of_order = lines.select("l_partkey", "l_orderkey", "l_shipdate").where("l_partkey is not null").repartition(n, "l_orderkey").groupBy("l_partkey", "l_orderkey")
    rows = of_order.agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at")).join(held, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    dates = [F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")]
    known = F.when(F.col("l_orderkey").isNotNull(), F.coalesce("one", F.lit(1))).otherwise(0)
    of_actor = rows.repartition(n, "l_partkey", "o_custkey").groupBy("l_partkey", "o_custkey").agg(F.sum(F.col("n") * F.coalesce("times", F.lit(1))).alias("mentions"), F.sum(known).alias("orders"), *dates)
    sums = of_actor.groupBy("l_partkey").agg(F.sum("mentions").alias("mentions"), F.sum("orders").alias("orders"), F.count("o_custkey").alias("actors"), *dates)
    parts = part.groupBy("p_partkey").agg(F.count("*").alias("rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counts = [zero(F.col("mentions") * F.col("rows")).alias("mentions"), zero("orders").alias("orders"), zero("actors").alias("actors")]
    return parts.join(sums, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", *counts, "first_at", "last_at")


@query(
    """
WITH m AS (SELECT doc_id, 'model' AS by, CASE WHEN n_chars > 3000 THEN 1 ELSE 0 END AS label FROM documents), o AS (SELECT doc_id, quality AS label FROM labels)
SELECT m.doc_id, coalesce(o.label, m.label)::INTEGER AS label, CASE WHEN o.label IS NULL THEN 'model' ELSE 'operator' END AS by FROM m LEFT JOIN o USING (doc_id)
"""
)
def latest_with_override(spark, sf_dir):
    """An operator's label beats the computed one."""
    model = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 3000).cast("int").alias("computed"))
    rows = model.join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", "computed").alias("label"), F.when(F.col("quality").isNull(), "model").otherwise("operator").alias("by"))


@query(
    """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
"""
)
def upsert_newest(spark, sf_dir):
    return ops.newest(load(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf_dir):
    return load(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT l_partkey FROM lineitem EXCEPT SELECT s_suppkey FROM supplier")
def set_algebra(spark, sf_dir):
    keys = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return keys.intersect(load(spark, sf_dir, "lineitem").select("l_partkey")).exceptAll(load(spark, sf_dir, "supplier").select("s_suppkey"))


@query("SELECT doc_id FROM documents WHERE n_chars > 8000 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def union_distinct(spark, sf_dir):
    large = load(spark, sf_dir, "documents").where("n_chars > 8000").select("doc_id")
    return large.union(load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")).distinct()


SECRET = r'(?:token|password|api_key)\s*=\s*"?([A-Za-z0-9]+)'


@query(
    rf"""
WITH s AS (SELECT source, sha256(regexp_extract(text, '{SECRET}', 1)) AS h FROM documents WHERE regexp_extract(text, '{SECRET}', 1) <> '')
SELECT source, count(DISTINCT h) AS secrets, count(*) AS n, min(h) AS least FROM s GROUP BY 1
"""
)
def secrets_hashed(spark, sf_dir):
    """Distinct counts over hashed secrets; the values themselves leave nowhere."""
    rows = load(spark, sf_dir, "documents").select("source", F.regexp_extract("text", SECRET, 1).alias("secret")).where("secret <> ''")
    hashed = ops.secret_hashed(rows, "secret")
    return hashed.groupBy("source").agg(F.countDistinct("secret").alias("secrets"), F.count("*").alias("n"), F.min("secret").alias("least"))
