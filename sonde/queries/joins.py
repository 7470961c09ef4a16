"""Joins, linking, graph expansions and components."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonde.functions import text as tx
from sonde.operators import linking as ops
from sonde.plans.components import components
from sonde.plans.lineage import materialize
from sonde.queries import query
from sonde.sources.tables import load

URL_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1))"


@query(
    """
SELECT n_name, r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2
"""
)
def join_chain(spark, sf_dir):
    orders, customer, nation, region = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = orders.join(customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    """
SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders, last_order FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey
"""
)
def left_summary(spark, sf_dir):
    summary = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"))
    rows = load(spark, sf_dir, "customer").join(summary, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    large = load(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return load(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(spark, sf_dir):
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


WATCH = ("example.com", "ththth.example.net", "co.uk", "example.org")


@query(
    f"""
WITH h AS (SELECT page_id, {URL_HOST} AS host FROM pages), w AS (SELECT unnest({list(WATCH)}) AS pattern)
SELECT pattern, count(DISTINCT host) AS hosts, count(*) AS n, count(*) FILTER (host = pattern) AS exact FROM h JOIN w ON host = pattern OR ends_with(host, '.' || pattern) GROUP BY 1
"""
)
def watch_list(spark, sf_dir):
    """Exact and suffix matches as one equi join on exploded parent domains, instead of a nested loop."""
    hosts = load(spark, sf_dir, "pages").select("page_id", tx.url_host(F.col("url")).alias("host"))
    keyed = hosts.select("host", F.explode(tx.host_suffixes(F.col("host"))).alias("pattern"))
    watched = spark.createDataFrame([(p,) for p in WATCH], "pattern string")
    found = keyed.join(F.broadcast(watched), "pattern")
    return found.groupBy("pattern").agg(F.countDistinct("host").alias("hosts"), F.count("*").alias("n"), F.count_if(F.col("host") == F.col("pattern")).alias("exact"))


PATTERNS = [("S1", "exact", "ththth.example.net", 1), ("S2", "suffix", "example.com", 2), ("S3", "wild", "example.com", 3), ("S4", "suffix", "example.net", 4)]
RANK = {"exact": 0, "wild": 1, "suffix": 2}


@query(
    f"""
WITH h AS (SELECT DISTINCT {URL_HOST} AS host FROM pages),
p AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{k}', '{d}', {c}, {RANK[k]})" for s, k, d, c in PATTERNS)}) v(source, kind, pattern, created, rank)),
m AS (SELECT host, source, row_number() OVER (PARTITION BY host ORDER BY rank, created) AS rn, count(DISTINCT source) OVER (PARTITION BY host) AS n
      FROM h JOIN p ON (kind = 'exact' AND host = pattern) OR (kind = 'suffix' AND (host = pattern OR ends_with(host, '.' || pattern))) OR (kind = 'wild' AND ends_with(host, '.' || pattern)))
SELECT h.host, m.source, CASE WHEN m.n IS NULL THEN 'unresolved' WHEN m.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM h LEFT JOIN m ON m.host = h.host AND rn = 1
"""
)
def host_resolution(spark, sf_dir):
    """The most specific active pattern of each host, the oldest among equals, and whether sources compete."""
    hosts = load(spark, sf_dir, "pages").select(tx.url_host(F.col("url")).alias("host")).distinct()
    rows = [(s, k, d, c, RANK[k]) for s, k, d, c in PATTERNS]
    patterns = spark.createDataFrame(rows, "source string, kind string, pattern string, created int, rank int")
    keyed = hosts.select("host", F.explode(tx.host_suffixes(F.col("host"))).alias("pattern"))
    own = F.col("host") == F.col("pattern")
    hit = keyed.join(F.broadcast(patterns), "pattern").where((F.col("kind") == "suffix") | ((F.col("kind") == "exact") & own) | ((F.col("kind") == "wild") & ~own))
    best = hit.groupBy("host").agg(F.min_by("source", F.struct("rank", "created")).alias("source"), F.countDistinct("source").alias("n"))
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return hosts.join(best, "host", "left").select("host", "source", state.alias("state"))


@query("SELECT conv_id, role, text, (SELECT count(*) FROM conversations d WHERE d.conv_id = c.conv_id) AS n_turns FROM conversations c WHERE turn = (SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id)")
def opening_post(spark, sf_dir):
    first = F.min_by(F.struct("role", "text"), "turn").alias("op")
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(first, F.count("*").alias("n_turns")).select("conv_id", "op.*", "n_turns")


@query(
    """
WITH op AS (SELECT user_id, event_type, min_by(event_id, event_id) AS op FROM events GROUP BY 1, 2), s AS (SELECT event_type, min_by(user_id, event_id) AS op_actor FROM events GROUP BY 1)
SELECT DISTINCT e.user_id, s.op_actor, e.event_type FROM events e JOIN s USING (event_type) WHERE s.op_actor <> e.user_id AND e.value > 95
"""
)
def replied_in(spark, sf_dir):
    """Who acted in threads that others opened."""
    events = load(spark, sf_dir, "events")
    opened = events.groupBy("event_type").agg(F.min_by("user_id", "event_id").alias("op_actor"))
    rows = events.where("value > 95").join(opened, "event_type").where("op_actor <> user_id")
    return rows.select("user_id", "op_actor", "event_type").distinct()


PAIRS = """
WITH own AS (SELECT DISTINCT l_orderkey AS a, l_partkey * 5 + l_quantity::BIGINT % 5 AS item FROM lineitem), n AS (SELECT count(DISTINCT a) AS actors FROM own),
df AS (SELECT item, count(*) AS df FROM own GROUP BY 1 HAVING count(*) BETWEEN 2 AND 15), p AS (SELECT a, item, ln((actors + 1) / (df + 1)) + 1 AS w FROM own JOIN df USING (item), n),
t AS (SELECT a, sum(w) AS total FROM p GROUP BY 1), b AS (SELECT x.a, y.a AS b, sum(x.w) AS both_w, list_sort(list(x.item)) AS shared FROM p x JOIN p y ON x.item = y.item AND x.a < y.a GROUP BY 1, 2),
s AS (SELECT b.a, b.b, both_w / (ta.total + tb.total - both_w) AS raw, shared FROM b JOIN t ta ON ta.a = b.a JOIN t tb ON tb.a = b.b)
"""


def _shared(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumn("item", F.col("l_partkey") * 5 + F.col("l_quantity").cast("long") % 5)
    return ops.shared_pairs(rows, "l_orderkey", "item")


@query(PAIRS + "SELECT a, b, round(raw, 4) AS score, len(shared) AS n_shared, shared[1] AS first_shared FROM s WHERE raw >= 0.15")
def weighted_jaccard_pairs(spark, sf_dir):
    return _shared(spark, sf_dir).select("a", "b", "score", F.size("shared").cast("long").alias("n_shared"), F.get("shared", F.lit(0)).alias("first_shared"))


CREWS = (
    PAIRS.replace("WITH own", "WITH RECURSIVE own")
    + """, e AS (SELECT a, b, round(raw, 4) AS score, shared FROM s WHERE raw >= 0.4), both_e AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, seen) AS (SELECT DISTINCT a, a FROM both_e UNION SELECT r.node, x.b FROM reach r JOIN both_e x ON x.a = r.seen),
c AS (SELECT node, min(seen) AS crew FROM reach GROUP BY 1)
"""
)


def _crews(spark, sf_dir):
    edges = materialize(_shared(spark, sf_dir).where("score >= 0.4"), "crew-edges")
    return edges, components(edges, "a", "b")


@query(CREWS + "SELECT crew, count(*) AS members FROM c GROUP BY 1")
def crews(spark, sf_dir):
    """Connected components over shared indicators."""
    return _crews(spark, sf_dir)[1].groupBy(F.col("component").alias("crew")).agg(F.count("*").alias("members"))


@query(
    CREWS
    + """, f AS (SELECT c.crew, e.* FROM e JOIN c ON c.node = e.a), k AS (SELECT crew, item, count(*) AS n FROM (SELECT crew, unnest(shared) AS item FROM f) GROUP BY 1, 2),
top AS (SELECT crew, item FROM (SELECT *, row_number() OVER (PARTITION BY crew ORDER BY n DESC, item) AS rn FROM k) WHERE rn = 1),
m AS (SELECT crew, (sum(('0x' || substr(md5(node::VARCHAR), 1, 8))::BIGINT)::BIGINT || '-' || sum(('0x' || substr(md5(node::VARCHAR), 9, 8))::BIGINT)::BIGINT) AS members_key, count(*) AS members FROM c GROUP BY 1)
SELECT m.crew, m.members, (SELECT count(*) FROM f WHERE f.crew = m.crew) AS edges, (SELECT max(score) FROM f WHERE f.crew = m.crew) AS best, top.item AS top_item, members_key,
       m.members >= 8 AND (SELECT max(score) FROM f WHERE f.crew = m.crew) >= 0.8 AS opens_case FROM m JOIN top USING (crew)
"""
)
def crew_profiles(spark, sf_dir):
    """Members, edges, best score, most shared item, key and gate of each component."""
    edges, found = _crews(spark, sf_dir)
    by_node = found.select(F.col("node").alias("a"), F.col("component").alias("crew"))
    inside = edges.join(by_node, "a")
    sums = inside.groupBy("crew").agg(F.count("*").alias("edges"), F.max("score").alias("best"))
    items = inside.select("crew", F.explode("shared").alias("item")).groupBy("crew", "item").agg(F.count("*").alias("n"))
    top = items.groupBy("crew").agg(F.min_by("item", F.struct((-F.col("n")).alias("n"), "item")).alias("top_item"))
    # a key of the members in any order, from sums, so that no component is gathered
    part = lambda i: F.sum(F.conv(F.substring(F.md5(F.col("a").cast("string")), i, 8), 16, 10).cast("long"))
    key = F.concat_ws("-", part(1), part(9))
    members = by_node.groupBy("crew").agg(F.count("*").alias("members"), key.alias("members_key"))
    rows = members.join(sums, "crew").join(top, "crew")
    return rows.withColumn("opens_case", (F.col("members") >= 8) & (F.col("best") >= 0.8)).select("crew", "members", "edges", "best", "top_item", "members_key", "opens_case")


SIGNATURE_SQL = """
WITH s AS (SELECT c_custkey AS k, (c_custkey * 40503 % 65536) * 65536 + c_nationkey * 2049 AS sig FROM customer), c AS (SELECT sig, min(k) AS k FROM s GROUP BY 1)
SELECT a.k AS a, b.k AS b, bit_count(xor(a.sig, b.sig))::INTEGER AS distance FROM c a JOIN c b ON a.k < b.k WHERE bit_count(xor(a.sig, b.sig)) <= 3
UNION ALL SELECT c.k, s.k, 0 FROM s JOIN c USING (sig) WHERE s.k <> c.k
"""


@query(SIGNATURE_SQL)
def hamming_pairs(spark, sf_dir):
    sig = (F.col("c_custkey") * 40503 % 65536) * 65536 + F.col("c_nationkey") * 2049
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), sig.alias("sig"))
    return ops.hamming_pairs(rows, "k", "sig", 3)


@query(
    """
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS cosine
      FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT query, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10
"""
)
def cosine_top_k(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    return ops.nearest_vectors(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)


@query(
    """
WITH names AS (SELECT c_name AS handle, c_custkey AS actor, 0 AS rank FROM customer UNION ALL SELECT 'Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0'), c_custkey, 1 FROM customer)
SELECT handle, actor FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY rank, actor) AS rn FROM names) WHERE rn = 1
"""
)
def handle_lookup(spark, sf_dir):
    """Current handles win over former ones."""
    customer = load(spark, sf_dir, "customer")
    now = customer.select(F.col("c_name").alias("handle"), F.col("c_custkey").alias("actor"), F.lit(0).alias("rank"))
    former = F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0"))
    past = customer.select(former.alias("handle"), F.col("c_custkey").alias("actor"), F.lit(1).alias("rank"))
    return now.unionByName(past).groupBy("handle").agg(F.min_by("actor", F.struct("rank", "actor")).alias("actor"))


@query(
    """
WITH nodes AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5), e AS (SELECT DISTINCT least(o_custkey, o_orderkey % 1500) AS a, greatest(o_custkey, o_orderkey % 1500) AS b FROM orders)
SELECT a, b, 'linked' AS kind FROM e WHERE a <> b AND a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes)
"""
)
def induced_edges(spark, sf_dir):
    """Edges with both ends in a set of nodes."""
    nodes = load(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    other = F.col("o_orderkey") % 1500
    edges = load(spark, sf_dir, "orders").select(F.least("o_custkey", other).alias("a"), F.greatest("o_custkey", other).alias("b")).where("a <> b").distinct()
    inside = edges.join(nodes, F.col("a") == F.col("id"), "left_semi").join(nodes, F.col("b") == F.col("id"), "left_semi")
    return inside.withColumn("kind", F.lit("linked"))


@query("SELECT CASE WHEN o_custkey = 7 THEN o_orderkey % 100 ELSE o_custkey END AS other, count(*) AS n FROM orders WHERE o_custkey = 7 OR o_orderkey % 100 = 7 GROUP BY 1")
def other_endpoint(spark, sf_dir):
    a, b = F.col("o_custkey"), F.col("o_orderkey") % 100
    rows = load(spark, sf_dir, "orders").where((a == 7) | (b == 7))
    return rows.groupBy(F.when(a == 7, b).otherwise(a).alias("other")).agg(F.count("*").alias("n"))


@query(
    """
SELECT 'customer' AS src_kind, o_custkey AS src, 'order' AS dst_kind, o_orderkey AS dst, 'placed' AS edge FROM orders
UNION ALL SELECT DISTINCT 'order', l_orderkey, 'part', l_partkey, 'contains' FROM lineitem
UNION ALL SELECT DISTINCT 'supplier', l_suppkey, 'part', l_partkey, 'supplies' FROM lineitem
UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey, 'lives_in' FROM customer
"""
)
def expansions(spark, sf_dir):
    """Typed one-hop neighbours."""
    orders, lines, customer = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    edge = lambda df, s, a, d, b, kind: df.select(F.lit(s).alias("src_kind"), F.col(a).cast("long").alias("src"), F.lit(d).alias("dst_kind"), F.col(b).cast("long").alias("dst"), F.lit(kind).alias("edge"))
    placed = edge(orders, "customer", "o_custkey", "order", "o_orderkey", "placed")
    contains = edge(lines, "order", "l_orderkey", "part", "l_partkey", "contains").distinct()
    supplies = edge(lines, "supplier", "l_suppkey", "part", "l_partkey", "supplies").distinct()
    return placed.unionByName(contains).unionByName(supplies).unionByName(edge(customer, "customer", "c_custkey", "nation", "c_nationkey", "lives_in"))


@query(
    """
WITH RECURSIVE e AS (SELECT DISTINCT c_custkey % 40 AS a, c_nationkey AS b FROM customer WHERE c_mktsegment = 'BUILDING'  AND c_custkey % 40 <> c_nationkey),
w(node, depth) AS (SELECT 0, 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 4)
SELECT node::BIGINT AS node, min(depth)::INTEGER AS depth FROM w GROUP BY 1
"""
)
def lineage_depth(spark, sf_dir):
    """Least depth of each node below a seed, at most four hops."""
    edges = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_custkey % 40 <> c_nationkey")
    edges = edges.select((F.col("c_custkey") % 40).alias("a"), F.col("c_nationkey").cast("long").alias("b")).distinct()
    known = spark.createDataFrame([(0, 0)], "node long, depth int")
    reached = known
    for depth in range(1, 5):
        reached = reached.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(depth).alias("depth")).distinct()
        known = known.unionByName(reached)
    return known.groupBy("node").agg(F.min("depth").alias("depth"))


@query(
    """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey - o_custkey % 7 AS b FROM orders WHERE o_orderpriority = '1-URGENT'), s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(node, seen) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.node, s.b FROM reach r JOIN s ON s.a = r.seen)
SELECT persona, count(*) AS actors FROM (SELECT node, min(seen) AS persona FROM reach GROUP BY 1) GROUP BY 1
"""
)
def personas(spark, sf_dir):
    """Merging along confirmed links, the smallest id naming the persona."""
    links = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") - F.col("o_custkey") % 7).alias("b"))
    return components(links.distinct(), "a", "b").groupBy(F.col("component").alias("persona")).agg(F.count("*").alias("actors"))


@query(
    """
SELECT e.event_id, e.user_id, e.value, (SELECT p.value FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts ORDER BY p.ts DESC LIMIT 1) AS last_purchase
FROM events e WHERE e.event_type = 'error'
"""
)
def as_of_join(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts", "value")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return ops.as_of(errors, bought, "user_id", "ts", "last_purchase").select("event_id", "user_id", "value", "last_purchase")


@query(
    """
SELECT o_custkey, n, round(total, 2) AS total, rank FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, row_number() OVER (ORDER BY count(*) DESC, o_custkey)::INTEGER AS rank FROM orders GROUP BY 1) WHERE rank <= 50
"""
)
def relations_by_count(spark, sf_dir):
    counts = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    top = counts.orderBy(F.desc("n"), "o_custkey").limit(50)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "o_custkey")))
