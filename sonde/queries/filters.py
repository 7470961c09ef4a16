"""Filters, joins and counts over artifacts, linkages, incidents and audit rows, cast on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.functions import text as tx
from sonde.queries import query
from sonde.sources.tables import load, spread


@query("SELECT p_partkey, p_name FROM part WHERE p_type IN ('STANDARD', 'ECONOMY', 'PROMO') AND (starts_with(lower(p_name), 'sm') OR contains(lower(p_name), 'ring')) AND (p_size % 3 = 0) = TRUE")
def artifact_filter(spark, sf_dir):
    """By kind, prefix or part of the value, and whether it is resolved."""
    value, resolved = F.lower("p_name"), F.col("p_size") % 3 == 0
    rows = load(spark, sf_dir, "part").where(F.col("p_type").isin("STANDARD", "ECONOMY", "PROMO") & resolved)
    return rows.where(F.startswith(value, F.lit("sm")) | F.contains(value, F.lit("ring"))).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount >= 0.05 AND (l_partkey = 17 OR l_suppkey = 17)")
def linkage_filter(spark, sf_dir):
    """By state, method, least score, and an actor on either side."""
    rows = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F' and l_discount >= 0.05")
    return rows.where((F.col("l_partkey") == 17) | (F.col("l_suppkey") == 17)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT event_id, user_id FROM events WHERE event_type IN (SELECT min(event_type) FROM events) AND user_id % 4 = 1 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def audit_filter(spark, sf_dir):
    """By event, subject and a time range; the range reaches the scan."""
    rows = load(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-20' and user_id % 4 = 1")
    first = load(spark, sf_dir, "events").agg(F.min("event_type").alias("event_type"))
    return rows.join(F.broadcast(first), "event_type", "left_semi").select("event_id", "user_id")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def outer_promoted(spark, sf_dir):
    """A filter on the side that may be missing turns the outer join into an inner one."""
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.where("o_orderpriority = '1-URGENT'").select("c_custkey", "o_orderkey")


@query(
    """
WITH pool AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45),
facts AS (SELECT l_partkey, l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, n, total FROM pool JOIN facts USING (l_partkey, l_suppkey)
"""
)
def pool_join(spark, sf_dir):
    """Facts by a composite key for the members of a pool only: the pool cuts the rows before they are summed."""
    rows = load(spark, sf_dir, "lineitem")
    pool = rows.where("l_quantity > 45").select("l_partkey", "l_suppkey").distinct()
    members = rows.join(pool, ["l_partkey", "l_suppkey"], "left_semi")
    return members.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT p_brand AS family, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY 1")
def family_counts(spark, sf_dir):
    """Verdicts by family, the commonest first, ties by name."""
    counts = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("family")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "family")).cast("long"))


@query(
    """
WITH i AS (SELECT o_orderkey, n_name AS country, o_orderpriority AS label, o_orderstatus AS source FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 100000)
SELECT 'country' AS facet, country AS value, count(*) AS n FROM i GROUP BY 2 UNION ALL SELECT 'label', label, count(*) FROM i GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM i GROUP BY 2
"""
)
def incident_counts(spark, sf_dir):
    """Counts by country, label and source in one pass."""
    rows = load(spark, sf_dir, "orders").where("o_totalprice > 100000").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    names = {"country": "n_name", "label": "o_orderpriority", "source": "o_orderstatus"}
    facets = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in names.items()])
    return rows.select(F.inline(facets)).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')")
def replaced_relations(spark, sf_dir):
    """Full replace: an actor that the new rows name has these only; the others keep their old ones."""
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    new = rows.where("o_orderdate >= timestamp_ntz '1997-01-01'")
    return new.unionByName(rows.join(new, "o_custkey", "left_anti")).select("o_custkey", "o_orderkey")


#: The namespace of node ids; a parameter.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@query(
    f"""
WITH h AS (SELECT c_custkey, sha1(unhex('{NAMESPACE.hex}') || encode('actor:' || c_name)) AS h FROM customer),
v AS (SELECT c_custkey, substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', ('0x' || substr(h, 17, 1))::INTEGER % 4 + 1, 1) || substr(h, 18, 15) AS h FROM h)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS node FROM v
"""
)
def node_ids(spark, sf_dir):
    """Name-based ids (version 5) of graph nodes."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(F.concat(F.lit("actor:"), "c_name"), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return load(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("-", *parts).alias("node"))


#: Markers of regions; a parameter of the operator, here words of the driver's texts.
REGIONS = {"north": ("der", "und", "ein"), "south": ("que", "les", "pour"), "west": ("the", "and", "ing")}
MARKERS = ", ".join(f"('{r}', '{w}')" for r, words in REGIONS.items() for w in words)
TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿ]+'), lambda w: w <> '')"


@query(
    f"""
WITH k AS (SELECT * FROM (VALUES {MARKERS}) v(region, word)), t AS (SELECT source, doc_id, {TOKENS} AS w FROM documents), n AS (SELECT source, sum(len(w)) AS tokens, count(*) AS messages FROM t GROUP BY 1),
hit AS (SELECT DISTINCT source, word FROM (SELECT source, unnest(w) AS word FROM t)), s AS (SELECT source, region, count(*) AS hits FROM hit JOIN k USING (word) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits DESC, region) AS rn FROM s)
SELECT n.source, CASE WHEN a.hits IS NULL OR a.hits::DOUBLE / tokens < 0.0001 OR a.hits < 1.8 * coalesce(b.hits, 0) THEN 'unknown' ELSE a.region END AS region, tokens::BIGINT AS tokens
FROM n LEFT JOIN r a ON a.source = n.source AND a.rn = 1 LEFT JOIN r b ON b.source = n.source AND b.rn = 2 WHERE messages >= 5
"""
)
def dialect_regions(spark, sf_dir):
    """The region whose markers an author uses: distinct hits over tokens, a least rate, and a margin over the second."""
    words = spread(load(spark, sf_dir, "documents").select("source", "text")).select("source", tx.tokens(F.col("text")).alias("w"))
    markers = spark.createDataFrame([(r, w) for r, ws in REGIONS.items() for w in ws], "region string, word string")
    known = F.array(*[F.lit(w) for ws in REGIONS.values() for w in ws])
    # a text gives at most the markers it holds, and Spark combines them before the shuffle
    per = words.select("source", F.size("w").alias("n"), F.array_intersect("w", known).alias("hits"))
    size = per.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("messages")).where("messages >= 5")
    hits = per.select("source", F.explode("hits").alias("word")).distinct().join(F.broadcast(markers), "word").groupBy("source", "region").agg(F.count("*").alias("hits"))
    order = W.partitionBy("source").orderBy(F.desc("hits"), "region")
    first = hits.withColumn("next", F.lead("hits", 1, 0).over(order)).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    firm = (F.col("hits") / F.col("tokens") >= 0.0001) & (F.col("hits") >= 1.8 * F.col("next"))
    return size.join(first, "source", "left").select("source", F.coalesce(F.when(firm, F.col("region")), F.lit("unknown")).alias("region"), "tokens")


@query(
    """
WITH w AS (SELECT p_brand, unnest(string_split(p_name, ' ')) || p_size % 7 AS word FROM part), n AS (SELECT p_brand, word, count(*) AS n FROM w GROUP BY 1, 2),
p AS (SELECT a.p_brand, a.word || '>' || b.word AS pair FROM n a JOIN n b ON a.p_brand = b.p_brand AND abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) = 1 WHERE a.n >= 2 AND b.n >= 1.5 * a.n)
SELECT p_brand, count(*) AS pairs, substr(sha256(string_agg(pair, '|' ORDER BY pair)), 1, 16) AS signature FROM p GROUP BY 1
"""
)
def typo_signatures(spark, sf_dir):
    """Per author the sorted pairs of a variant and the dominant spelling one edit away, hashed."""
    words = load(spark, sf_dir, "part").select("p_brand", "p_size", F.explode(F.split("p_name", " ")).alias("name"))
    counts = words.groupBy("p_brand", F.concat("name", (F.col("p_size") % 7).cast("string")).alias("word")).agg(F.count("*").alias("n"))
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    keyed = counts.select("p_brand", "word", "n", F.explode(F.array_distinct(F.array_append(cut, F.col("word")))).alias("key"))
    a, b = keyed.where("n >= 2").alias("a"), keyed.alias("b")
    near = a.join(b, ["p_brand", "key"]).where("b.n >= 1.5 * a.n and levenshtein(a.word, b.word) = 1")
    pairs = near.select("p_brand", F.concat_ws(">", "a.word", "b.word").alias("pair")).distinct()
    return pairs.groupBy("p_brand").agg(F.count("*").alias("pairs"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("pair")), "|"), 256), 1, 16).alias("signature"))


#: Comparators by name: weight, and the threshold by language.
COMPARATORS = {"price": (0.5, {"A": 0.3, "N": 0.2, "R": 0.25}), "quantity": (0.3, {"A": 0.5, "N": 0.5, "R": 0.4}), "discount": (0.2, {"A": 0.5, "N": 0.6, "R": 0.5})}


@query(
    """
WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag AS lang, least(1.0, l_extendedprice / 100000) AS price, least(1.0, l_quantity / 50) AS quantity, least(1.0, l_discount * 10) AS discount FROM lineitem),
g AS (SELECT *, CASE WHEN price >= CASE lang WHEN 'A' THEN 0.3 WHEN 'N' THEN 0.2 ELSE 0.25 END THEN 0.5 ELSE 0 END AS wp, CASE WHEN quantity >= CASE lang WHEN 'R' THEN 0.4 ELSE 0.5 END THEN 0.3 ELSE 0 END AS wq,
  CASE WHEN discount >= CASE lang WHEN 'N' THEN 0.6 ELSE 0.5 END THEN 0.2 ELSE 0 END AS wd FROM s)
SELECT l_orderkey, l_linenumber, round(CASE WHEN wp + wq + wd = 0 THEN 0 ELSE (wp * price + wq * quantity + wd * discount) / (wp + wq + wd) END, 3)::DOUBLE AS score, (wp > 0)::INTEGER + (wq > 0)::INTEGER + (wd > 0)::INTEGER AS agreeing FROM g
"""
)
def composite_scores(spark, sf_dir):
    """A verdict from several comparators: each counts, by its weight, where it reaches the threshold of the language."""
    rows = load(spark, sf_dir, "lineitem")
    one = F.lit(1.0)
    values = {"price": F.least(one, F.col("l_extendedprice") / 100000), "quantity": F.least(one, F.col("l_quantity") / 50), "discount": F.least(one, F.col("l_discount") * 10)}
    weights = {}
    for name, (weight, limits) in COMPARATORS.items():
        limit = F.coalesce(*[F.when(F.col("l_returnflag") == lang, F.lit(t)) for lang, t in limits.items()])
        weights[name] = F.when(values[name] >= limit, F.lit(weight)).otherwise(F.lit(0.0))
    total = sum(weights.values(), F.lit(0.0))
    score = sum((weights[n] * values[n] for n in values), F.lit(0.0)) / total
    agreeing = sum(((w > 0).cast("int") for w in weights.values()), F.lit(0))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.when(total > 0, score).otherwise(0.0), 3).alias("score"), agreeing.alias("agreeing"))


@query(
    """
SELECT user_id, count(*) AS volume, round(max(value), 6) AS best, min(ts) AS first, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1
"""
)
def profile_fold(spark, sf_dir):
    """Profiles folded from observations day by day, then day states merged: the same as over all rows at once."""
    events = load(spark, sf_dir, "events")
    day = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("volume"), F.max("value").alias("best"), F.min("ts").alias("first"), F.collect_set("event_type").alias("kinds")
    )
    merged = day.groupBy("user_id").agg(
        F.sum("volume").alias("volume"), F.round(F.max("best"), 6).alias("best"), F.min("first").alias("first"), F.flatten(F.collect_list("kinds")).alias("kinds")
    )
    return merged.withColumn("kinds", F.array_join(F.array_sort(F.array_distinct("kinds")), ","))


@query("SELECT event_id, claims FROM (SELECT event_id, props AS claims FROM events)")
def token_claims(spark, sf_dir):
    """Claims read from tokens that are built of each event's properties."""
    from sonde.functions import vectorised as vx

    part = lambda c: F.regexp_replace(F.translate(F.base64(F.encode(c, "UTF-8")), "+/", "-_"), r"=|\s", "")
    token = F.concat_ws(".", part(F.lit('{"alg":"none"}')), part(F.col("props")), F.lit("x"))
    return load(spark, sf_dir, "events").select("event_id", vx.jwt_claims(token).alias("claims"))


def _nfc():
    import unicodedata

    @F.pandas_udf(T.StringType())
    def nfc(texts):
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return nfc


@query("SELECT c_custkey, nfc_normalize(replace(replace(c_name, 'u', 'u' || chr(776)), 'e', 'e' || chr(769))) AS name FROM customer")
def composed_names(spark, sf_dir):
    """Texts brought to one form of composition; Spark has no expression for it."""
    apart = F.replace(F.replace("c_name", F.lit("u"), F.lit("u\u0308")), F.lit("e"), F.lit("e\u0301"))
    return load(spark, sf_dir, "customer").select("c_custkey", _nfc()(apart).alias("name"))
