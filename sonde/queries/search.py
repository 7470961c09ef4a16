"""Filters, boolean search, facets, ordering and paging over a unified search table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonde.functions import text as tx
from sonde.operators import search as ops
from sonde.queries import query
from sonde.sources.tables import load

UNIFIED = """
WITH s AS (SELECT 'document' AS entity_type, doc_id AS entity_id, source, lang AS kind, (doc_id % 3)::INTEGER AS tier, lower(text) AS haystack, n_chars AS weight FROM documents
UNION ALL SELECT 'part', p_partkey, p_brand, p_type, 0, lower(p_name || ' ' || p_brand), p_size FROM part
UNION ALL SELECT 'customer', c_custkey, NULL, c_mktsegment, 1, lower(c_name), c_nationkey FROM customer)
"""


def unified(spark, sf_dir):
    docs, part, customer = (load(spark, sf_dir, t) for t in ("documents", "part", "customer"))
    row = lambda df, type_, id_, source, kind, tier, hay, weight: df.select(F.lit(type_).alias("entity_type"), F.col(id_).alias("entity_id"), source.alias("source"), F.col(kind).alias("kind"), tier.cast("int").alias("tier"), F.lower(hay).alias("haystack"), F.col(weight).cast("long").alias("weight"))
    rows = row(docs, "document", "doc_id", F.col("source"), "lang", F.col("doc_id") % 3, F.col("text"), "n_chars")
    rows = rows.unionByName(row(part, "part", "p_partkey", F.col("p_brand"), "p_type", F.lit(0), F.concat_ws(" ", "p_name", "p_brand"), "p_size"))
    return rows.unionByName(row(customer, "customer", "c_custkey", F.lit(None).cast("string"), "c_mktsegment", F.lit(1), F.col("c_name"), "c_nationkey"))


WANTED = (ops.term("ring") | ops.term("the")) & ~ops.term("stupid") & ~ops.field("kind", "de")
WANTED_SQL = "(contains(haystack, 'ring') OR contains(haystack, 'the')) AND NOT contains(haystack, 'stupid') AND NOT (kind = 'de')"


@query(UNIFIED + f"SELECT entity_type, entity_id FROM s WHERE {WANTED_SQL}")
def boolean_search(spark, sf_dir):
    return unified(spark, sf_dir).where(ops.condition(WANTED)).select("entity_type", "entity_id")


@query(UNIFIED + "SELECT entity_type, entity_id FROM s WHERE entity_type = 'part' AND source = 'Brand#2' AND contains(haystack, 'small')")
def field_search(spark, sf_dir):
    return unified(spark, sf_dir).where(ops.condition(ops.field("source", "Brand#2", scope="part") & ops.term("Small"))).select("entity_type", "entity_id")


@query(
    UNIFIED
    + f"""
SELECT entity_type, entity_id, weight, pos FROM (SELECT *, row_number() OVER (ORDER BY CASE entity_type WHEN 'customer' THEN 0 WHEN 'document' THEN 1 ELSE 2 END, weight DESC, entity_id)::INTEGER AS pos FROM s WHERE tier <= 1 AND {WANTED_SQL}) WHERE pos BETWEEN 101 AND 151
"""
)
def ranked_page(spark, sf_dir):
    """Offset paging with one row more than the page, which tells whether another follows."""
    rows = ops.cleared(unified(spark, sf_dir), 1).where(ops.condition(WANTED))
    rank = F.when(F.col("entity_type") == "customer", 0).when(F.col("entity_type") == "document", 1).otherwise(2)
    return ops.page(rows.withColumn("rank", rank), ["rank", F.desc("weight"), "entity_id"], 100, 50).select("entity_type", "entity_id", "weight", "pos")


@query(
    UNIFIED
    + """, v AS (SELECT * FROM s WHERE tier <= 1 AND contains(haystack, 'the'))
SELECT 'type' AS facet, entity_type AS value, count(*) AS n FROM v WHERE source IS NOT DISTINCT FROM 'src1' GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM v WHERE entity_type = 'document' GROUP BY ALL
UNION ALL SELECT 'kind', kind, count(*) FROM v WHERE entity_type = 'document' AND source IS NOT DISTINCT FROM 'src1' AND kind IS NOT NULL GROUP BY ALL
"""
)
def facets(spark, sf_dir):
    """Each facet ignores its own filter; clearance always applies."""
    rows = ops.cleared(unified(spark, sf_dir), 1).where(ops.condition(ops.term("the")))
    return ops.facets(rows, {"type": "entity_type", "source": "source", "kind": "kind"}, {"type": "document", "source": "src1"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 200")
def keyset_page(spark, sf_dir):
    return load(spark, sf_dir, "orders").where("o_orderkey > 5000").orderBy("o_orderkey").limit(200).select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem ORDER BY l_suppkey, l_returnflag LIMIT 100")
def distinct_page(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct().orderBy("l_suppkey", "l_returnflag").limit(100)


@query(
    """
SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT starts_with(c_name, '-') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) BETWEEN 5 AND 12
"""
)
def actor_filter(spark, sf_dir):
    counts = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n between 5 and 12")
    actors = load(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & ~F.startswith("c_name", F.lit("-")))
    return actors.join(counts, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000001') OR contains(lower(c_mktsegment), 'mach')")
def actor_search(spark, sf_dir):
    rows = load(spark, sf_dir, "customer")
    return rows.where(F.contains(F.lower("c_name"), F.lit("#00000001")) | F.contains(F.lower("c_mktsegment"), F.lit("mach"))).select("c_custkey", "c_name")


@query(
    """
WITH c AS (SELECT l.doc_id, l.quality, CASE WHEN l.toxic = 1 THEN d.lang END AS note, d.source FROM labels l JOIN documents d USING (doc_id))
SELECT doc_id FROM c WHERE quality IN (0, 1) AND (note LIKE '%n%' OR source LIKE '%7%')
"""
)
def candidate_filter(spark, sf_dir):
    """Three-valued logic: LIKE on null is no match."""
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id").withColumn("note", F.when(F.col("toxic") == 1, F.col("lang")))
    return rows.where(F.col("quality").isin(0, 1) & (F.contains("note", F.lit("n")) | F.contains("source", F.lit("7")))).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def case_filter(spark, sf_dir):
    rich = load(spark, sf_dir, "customer").where("c_acctbal > 5000")
    rows = load(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderdate >= timestamp_ntz '1997-01-01' and o_orderdate < timestamp_ntz '1998-01-01'")
    return rows.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query(
    """
WITH i AS (SELECT doc_id, text, list_filter([CASE WHEN contains(text, 'http') THEN 'link' END, CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN contains(text, 'password') THEN 'secret' END], lambda x: x IS NOT NULL) AS labels FROM documents)
SELECT doc_id, array_to_string(labels, ',') AS labels FROM i WHERE list_has_any(labels, ['contact', 'secret']) AND length(trim(text)) > 0
"""
)
def incident_filter(spark, sf_dir):
    marks = {"link": "http", "contact": "@", "secret": "password"}
    labels = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(v)), k) for k, v in marks.items()]))
    rows = load(spark, sf_dir, "documents").withColumn("labels", labels)
    rows = rows.where(F.arrays_overlap("labels", F.array(F.lit("contact"), F.lit("secret"))) & (F.length(F.trim("text")) > 0))
    return rows.select("doc_id", F.array_join("labels", ",").alias("labels"))


@query(r"SELECT page_id, regexp_matches(path, '^/(?:en|fr)/[^/]*$') AS one_level, regexp_matches(path, '^/en/.*$') AS any_level FROM (SELECT page_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS path FROM pages)")
def glob_match(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*([^?#]*)", 1).alias("path"))
    like = lambda g: F.regexp_like("path", F.lit(tx.glob_pattern(g)))
    return rows.select("page_id", (like("/en/*") | like("/fr/*")).alias("one_level"), like("/en/**").alias("any_level"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_modes(spark, sf_dir):
    return ops.sorted_by(load(spark, sf_dir, "orders"), "price", {"price": F.desc("o_totalprice"), "recent": F.desc("o_orderdate")}, "o_orderkey").limit(25).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1")
def latest_anchor(spark, sf_dir):
    newest = W.partitionBy("source").orderBy(F.desc("doc_id"))
    return load(spark, sf_dir, "documents").withColumn("rn", F.row_number().over(newest)).where("rn = 1").select("source", "doc_id")
