"""All typed expansions over a graph made of orders, lines and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import expand
from sonde.queries import query
from sonde.sources.tables import load


def _tables(spark, sf_dir):
    """Orders are messages of customers, their parts artifacts, suppliers attachments, returned lines incidents, nations personas."""
    orders, lines, customer, part = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "part"))
    year = F.year("o_orderdate").cast("string")
    kind = F.when(F.col("p_size") % 5 == 0, "wallet").otherwise("domain")
    return {
        "messages": orders.select(F.col("o_orderkey").alias("message"), F.col("o_custkey").alias("actor"), F.concat_ws("/", "o_orderpriority", year).alias("thread"), F.col("o_orderpriority").alias("container"), F.col("o_orderstatus").alias("source"), (F.col("o_orderkey") % 4 == 0).alias("opens")),
        "mentions": lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("message"), F.col("l_partkey").alias("artifact"), kind.alias("artifact_kind")),
        "attachments": lines.select(F.col("l_orderkey").alias("message"), F.col("l_suppkey").alias("attachment")),
        "incidents": lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("message"), F.col("l_linenumber").alias("incident")),
        "members": customer.select(F.col("c_nationkey").alias("persona"), F.col("c_custkey").alias("actor")),
        "links": orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1500).alias("b"), F.when(F.col("o_orderstatus") == "F", "linked").otherwise("related").alias("kind")),
        "domains": part.select(F.col("p_partkey").alias("artifact"), F.col("p_brand").alias("domain")),
        "contents": lines.select(F.concat("l_returnflag", "l_linestatus").alias("document"), F.col("l_partkey").alias("artifact")),
    }


def _one(p: expand.Pivot) -> str:
    where = f" AND ({p.where})" if p.where else ""
    return f"SELECT '{p.src_kind}' AS src_kind, {p.src}::VARCHAR AS src, '{p.name}' AS name, '{p.dst_kind}' AS dst_kind, {p.dst}::VARCHAR AS dst, '{p.edge}' AS edge FROM {p.view} WHERE {p.src} IS NOT NULL AND {p.dst} IS NOT NULL{where}"


EDGES = f"""
WITH messages AS (SELECT o_orderkey AS message, o_custkey AS actor, o_orderpriority || '/' || year(o_orderdate) AS thread, o_orderpriority AS container, o_orderstatus AS source, o_orderkey % 4 = 0 AS opens FROM orders),
lines AS (SELECT messages.*, l_partkey AS artifact, CASE WHEN p_size % 5 = 0 THEN 'wallet' ELSE 'domain' END AS artifact_kind, l_suppkey AS attachment, l_linenumber AS incident, l_returnflag
          FROM lineitem JOIN messages ON l_orderkey = message JOIN part ON p_partkey = l_partkey),
uses AS (SELECT * FROM lines), flagged AS (SELECT * FROM lines WHERE l_returnflag = 'R'), attached AS (SELECT messages.*, l_suppkey AS attachment FROM lineitem JOIN messages ON l_orderkey = message),
members AS (SELECT c_nationkey AS persona, c_custkey AS actor FROM customer), own AS (SELECT * FROM messages JOIN members USING (actor)), own_uses AS (SELECT * FROM lines JOIN members USING (actor)),
pairs AS (SELECT o_custkey AS a, o_orderkey % 1500 AS b, CASE WHEN o_orderstatus = 'F' THEN 'linked' ELSE 'related' END AS kind FROM orders), links AS (SELECT * FROM pairs UNION ALL SELECT b, a, kind FROM pairs),
domains AS (SELECT p_partkey::VARCHAR AS artifact, p_brand AS domain FROM part), contents AS (SELECT l_returnflag || l_linestatus AS document, l_partkey AS artifact FROM lineitem),
edges AS ({" UNION ".join(_one(p) for p in expand.PIVOTS)})
"""


@query(EDGES + "SELECT src_kind, src, name, count(*) AS n FROM edges GROUP BY ALL")
def expansion_counts(spark, sf_dir):
    """How many neighbours every node has by every expansion."""
    return expand.all_counts(_tables(spark, sf_dir))


@query(EDGES + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_kind, src, name ORDER BY dst)::INTEGER AS place FROM edges) WHERE place BETWEEN 4 AND 6")
def expansion_pages(spark, sf_dir):
    """The second page of three of every expansion."""
    return expand.all_pages(_tables(spark, sf_dir), 3, 1)
