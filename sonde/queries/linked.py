"""Hosts by a list of suffixes, an inverted index, personas with a log, and enrichments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.functions.text import url_host
from sonde.operators import hosts as ho
from sonde.operators.enrich import Registry
from sonde.operators.personas import Personas
from sonde.operators.postings import Index
from sonde.queries import query
from sonde.sources.tables import load, spread
from sonde.streaming.replay import fresh_dir

#: A few rules of each kind; the whole public list is a parameter of the operator.
RULES = ("com", "org", "net", "uk", "co.uk", "*.ck", "!www.ck", "example.org", "*.sch.uk")
HOSTS = "CASE page_id % 6 WHEN 0 THEN replace(h, '.com', '.co.uk') WHEN 1 THEN h || '.ck' WHEN 2 THEN 'www.ck' WHEN 3 THEN h || '.town.sch.uk' WHEN 4 THEN h || '.unlisted' ELSE h END"


@query(
    rf"""
WITH h AS (SELECT DISTINCT {HOSTS} AS host FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages)),
k AS (SELECT host, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM h),
c AS (SELECT host, k, array_to_string(l[len(l) - k + 1:], '.') AS whole, '*.' || array_to_string(l[len(l) - k + 2:], '.') AS wild FROM k),
r AS (SELECT unnest({list(RULES)}) AS rule),
m AS (SELECT host, k, 0 AS first FROM c WHERE whole IN (FROM r) OR (k > 1 AND wild IN (FROM r)) UNION ALL SELECT host, k - 1, 1 FROM c WHERE '!' || whole IN (FROM r)),
b AS (SELECT host, arg_max(k, first * 100 + k) AS n FROM m GROUP BY 1)
SELECT host, array_to_string(l[len(l) - n + 1:], '.') AS public_suffix, CASE WHEN len(l) > n THEN array_to_string(l[len(l) - n:], '.') END AS registrable
FROM (SELECT host, string_split(host, '.') AS l, coalesce(n, 1) AS n FROM h LEFT JOIN b USING (host))
"""
)
def registrable_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domains of every page's host, and of such with other endings, by exact, wildcard and exception rules."""
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    pages = load(spark, sf_dir, "pages").withColumn("h", url_host(F.col("url"))).select(F.expr(HOSTS).alias("host"))
    return ho.registrable(pages.select(ho.ascii_host(F.col("host")).alias("host")), "host", rules)


WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
PHRASE, ALL = ("de", "la"), ("the", "de", "und")


@query(
    rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id AS key, len(list_filter(range(1, len(w)), lambda i: w[i] = '{PHRASE[0]}' AND w[i + 1] = '{PHRASE[1]}')) AS n FROM w)
SELECT 'phrase' AS asked, key, n FROM p WHERE n > 0 UNION ALL SELECT 'all', doc_id, 1 FROM w WHERE {" AND ".join(f"list_contains(w, '{x}')" for x in ALL)}
"""
)
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase and a conjunction, answered from the postings of their words alone."""
    index = Index(spark, fresh_dir(spark, "index"))
    index.write(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
    found = index.phrase(" ".join(PHRASE)).select(F.lit("phrase").alias("asked"), "key", "n")
    return found.unionByName(index.all_of(" ".join(ALL)).select(F.lit("all").alias("asked"), "key", F.lit(1).cast("long").alias("n")))


@query(
    """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey - o_custkey % 7 AS b FROM orders WHERE o_custkey % 7 > 0), k AS (SELECT a, b FROM e WHERE a % 7 <> 3),
s AS (SELECT a, b FROM k UNION SELECT b, a FROM k), reach(node, seen) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.node, s.b FROM reach r JOIN s ON s.a = r.seen),
m AS (SELECT node, min(seen) AS persona FROM reach GROUP BY 1)
SELECT actor, coalesce(persona, actor) AS persona FROM (SELECT a AS actor FROM e UNION SELECT b FROM e) LEFT JOIN m ON m.node = actor
"""
)
def split_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personas after all links were merged in two steps and some of them split again."""
    links = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") - F.col("o_custkey") % 7).alias("b")).where("a <> b").distinct()
    personas = Personas(spark, fresh_dir(spark, "personas"))
    personas.decide(links.where("a % 2 = 0"), "merge")
    personas.decide(links.where("a % 2 = 1"), "merge")
    personas.decide(links.where("a % 7 = 3"), "split")
    return personas.members()


@query(
    """
SELECT 'standing' AS enrichment, 'customer:' || c_custkey AS subject, f.name, f.value FROM customer, LATERAL (
  SELECT unnest([{'name': 'segment', 'value': c_mktsegment}, {'name': 'debt', 'value': CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END}]) AS f)
UNION ALL SELECT 'offers', 'part:' || l_partkey, 'supplier', l_suppkey::VARCHAR FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
"""
)
def enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of two enrichments: one row for each customer, and as many for a part as it has suppliers."""
    registry = Registry()
    ident = F.substring_index("subject", ":", -1).cast("long")

    @registry.add("standing", ("customer",), "segment string, debt boolean")
    def standing(asked: DataFrame) -> DataFrame:
        rows = load(spark, sf_dir, "customer")
        return asked.withColumn("c_custkey", ident).join(rows, "c_custkey").select("subject", F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") < 0).alias("debt"))

    @registry.add("offers", ("part",), "supplier long", rows=True)
    def offers(asked: DataFrame) -> DataFrame:
        rows = load(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("supplier")).distinct()
        return asked.withColumn("l_partkey", ident).join(rows, "l_partkey").select("subject", "supplier")

    subject = lambda table, kind, key: load(spark, sf_dir, table).select(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), key).alias("subject"))
    return registry.facts(subject("customer", "customer", "c_custkey").unionAll(subject("part", "part", "p_partkey")))
