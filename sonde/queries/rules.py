"""Rule evaluation over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.functions import text as tx
from sonde.functions import vectorised as vx
from sonde.operators import rules as ops
from sonde.queries import query
from sonde.sources.tables import load, spread


#: Texts are composed, then look-alike letters folded, before signals are looked for.
FOLD = f"translate(nfc_normalize(text), '{tx.LOOK_ALIKE}', '{tx.FOLDED}')"


def _fires(signals, text=FOLD) -> str:
    quoted = lambda p: p.replace("'", "''")
    return " + ".join(f"CASE WHEN regexp_matches({text}, '{quoted(p)}') THEN {w} ELSE 0 END" for _, w, p in signals)


@query(f"SELECT doc_id, ({_fires(ops.SIGNALS)})::INTEGER AS score, ({_fires(ops.SIGNALS)}) >= {ops.ADJUDICATE} AS adjudicate FROM documents")
def prefilter_scores(spark, sf_dir):
    score, _ = ops.weighted(F.col("text"))
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", tx.fold_look_alikes(vx.composed(F.col("text"))))
    return docs.select("doc_id", score.alias("score")).withColumn("adjudicate", F.col("score") >= ops.ADJUDICATE)


NAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({FOLD}, '" + p.replace("'", "''") + f"') THEN '{n}' END" for n, _, p in ops.SIGNALS) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT s.signals, count(*) AS n FROM (SELECT {NAMES} AS signals FROM documents) s GROUP BY 1")
def prefilter_signals(spark, sf_dir):
    _, names = ops.weighted(F.col("text"))
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", tx.fold_look_alikes(vx.composed(F.col("text"))))
    return docs.select(F.array_join(names, ",").alias("signals")).groupBy("signals").agg(F.count("*").alias("n"))


#: Operator rules of this engine's own tests: label and pattern.
OPERATOR_RULES = (("contact", r"(?i)[a-z0-9._]+@[a-z0-9.]+"), ("licence", r"(?i)\blicen[cs]e\b"), ("insult", r"(?i)\b(?:stupid|disgusting|worthless)\b"))


@query("SELECT label, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS label FROM documents WHERE regexp_matches(text, '{p}')" for n, p in OPERATOR_RULES) + ") GROUP BY 1")
def operator_rules(spark, sf_dir):
    labels = F.array_compact(F.array(*[F.when(F.regexp_like("text", F.lit(p)), n) for n, p in OPERATOR_RULES]))
    return load(spark, sf_dir, "documents").select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT doc_id, round(1 / (1 + exp(-(ln(n_chars + 1) * 0.8 - 6.0))), 6) AS probability, 1 / (1 + exp(-(ln(n_chars + 1) * 0.8 - 6.0))) >= 0.5 AS label FROM documents")
def platt_labels(spark, sf_dir):
    p = ops.platt(F.log(F.col("n_chars") + 1), 0.8, -6.0)
    return load(spark, sf_dir, "documents").select("doc_id", F.round(p, 6).alias("probability"), (p >= 0.5).alias("label"))


#: Rules of the document tiers: name, rank, pattern.
TIER_RULES = [("email", 2, r"[a-z0-9._-]+@[a-z0-9.-]+\.[a-z]+"), ("secret", 3, r"(?:password|api_key|token)=[A-Za-z0-9]+"), ("shouting", 1, r"[A-ZÄÖÜ]{6,}"), ("digits", 1, r"[0-9]{6,}")]
FOUND = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, {r} AS rank, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for n, r, p in TIER_RULES)


@query(f"SELECT doc_id, rule, rank, n::INTEGER AS n FROM ({FOUND}) WHERE n > 0")
def document_findings(spark, sf_dir):
    return ops.findings(load(spark, sf_dir, "documents"), "doc_id", "text", TIER_RULES)


@query(
    f"""
WITH f AS (SELECT doc_id, max(rank) AS tier FROM ({FOUND}) WHERE n > 0 GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.lang IS NULL THEN 3 ELSE greatest(coalesce(f.tier, 0), CASE WHEN l.toxic = 1 THEN 2 ELSE 0 END) END::INTEGER AS tier, coalesce(f.tier, 0) >= 2 AND coalesce(l.quality, 0) = 1 AS review
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN labels l USING (doc_id)
"""
)
def document_tiers(spark, sf_dir):
    """The highest of all floors; a document that could not be judged gets the top tier; counter-signals ask for review."""
    docs = load(spark, sf_dir, "documents")
    floors = ops.floors(ops.findings(docs, "doc_id", "text", TIER_RULES), "doc_id")
    rows = docs.select("doc_id", "lang").join(floors, "doc_id", "left").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    known = F.greatest(F.coalesce("tier", F.lit(0)), F.when(F.col("toxic") == 1, 2).otherwise(0))
    review = (F.coalesce("tier", F.lit(0)) >= 2) & (F.coalesce("quality", F.lit(0)) == 1)
    return rows.select("doc_id", F.when(F.col("lang").isNull(), 3).otherwise(known).alias("tier"), review.alias("review"))


@query(
    """
WITH s AS (SELECT o_custkey, n_name AS iso, o_orderpriority AS kind, round(o_totalprice / 100000, 4) AS weight, o_orderkey FROM orders JOIN nation ON n_nationkey = o_orderkey % 5),
c AS (SELECT o_custkey, iso, sum(weight) AS points FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, iso, kind ORDER BY weight DESC) AS rn FROM s) WHERE rn <= 3 GROUP BY 1, 2),
l AS (SELECT o_custkey, sum(points) AS every, max(points) AS most, first(iso ORDER BY points DESC, iso) AS leader FROM c GROUP BY 1)
SELECT o_custkey, CASE WHEN most >= 10 AND most >= 0.6 * every THEN leader END AS country, CASE WHEN most >= 10 AND most >= 0.6 * every THEN 'resolved' WHEN most >= 10 THEN 'mixed' ELSE 'unknown' END AS verdict FROM l
"""
)
def country_verdicts(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    rows = load(spark, sf_dir, "orders").join(F.broadcast(nation), F.col("n_nationkey") == F.col("o_orderkey") % 5)
    signals = rows.select("o_custkey", F.col("n_name").alias("iso"), F.col("o_orderpriority").alias("kind"), F.round(F.col("o_totalprice") / 100000, 4).alias("weight"))
    return ops.country_verdict(signals, "o_custkey")


@query(
    """
SELECT o_orderkey, (o_orderkey * 1000000 + 131400 + 98 - (o_orderkey * 1000000 + 131400) % 97) % 97 = 1 AS iban_ok,
       (CASE 11 - r % 11 WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE (11 - r % 11)::VARCHAR END) AS rut FROM
(SELECT o_orderkey, (SELECT sum(substr(reverse(o_orderkey::VARCHAR), i::INTEGER, 1)::INTEGER * ((i - 1) % 6 + 2)) FROM range(1, length(o_orderkey::VARCHAR) + 1) t(i)) AS r FROM orders)
"""
)
def national_numbers(spark, sf_dir):
    """Account numbers built with right check digits, tested digit by digit, and mod-11 check characters."""
    digits = F.concat(F.col("o_orderkey").cast("string"), F.lit("131400"))
    check = F.lpad((98 - ops.mod97(digits)).cast("string"), 2, "0")
    iban = F.concat(F.lit("DE"), check, F.lpad(F.col("o_orderkey").cast("string"), 18, "0"))
    return load(spark, sf_dir, "orders").select("o_orderkey", ops.iban_ok(iban).alias("iban_ok"), ops.rut_check(F.col("o_orderkey")).alias("rut"))


TREE = ("and", ("at_least", 2, ("glob", "A/*"), ("glob", "R/*"), ("path", "N/O")), ("not", ("path", "R/7")), ("xor", ("glob", "**/F"), ("path", "A/1")))


@query(
    """
WITH p AS (SELECT l_orderkey, list(DISTINCT l_returnflag || '/' || CASE WHEN l_linenumber > 4 THEN l_linestatus ELSE l_linenumber::VARCHAR END) AS f FROM lineitem GROUP BY 1)
SELECT l_orderkey, (len(list_filter(f, lambda x: starts_with(x, 'A/'))) > 0)::INTEGER + (len(list_filter(f, lambda x: starts_with(x, 'R/'))) > 0)::INTEGER + list_contains(f, 'N/O')::INTEGER >= 2
  AND NOT list_contains(f, 'R/7') AND ((len(list_filter(f, lambda x: ends_with(x, '/F'))) > 0)::INTEGER + list_contains(f, 'A/1')::INTEGER) % 2 = 1 AS matches FROM p
"""
)
def folder_predicates(spark, sf_dir):
    leaf = F.when(F.col("l_linenumber") > 4, F.col("l_linestatus")).otherwise(F.col("l_linenumber").cast("string"))
    paths = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat_ws("/", "l_returnflag", leaf)).alias("paths"))
    return paths.select("l_orderkey", ops.folder(F.col("paths"), TREE).alias("matches"))


SIGNALS = [("alpha", "1-URGENT", 2.0), ("alpha", "2-HIGH", 1.0), ("alpha", "5-LOW", -1.0), ("beta", "5-LOW", 2.0), ("beta", "3-MEDIUM", 2.0), ("gamma", "4-NOT SPECIFIED", 1.0)]


@query(
    f"""
WITH s AS (SELECT * FROM (VALUES {", ".join(str(s) for s in SIGNALS)}) v(family, feature, weight)), m AS (SELECT family, sum(weight) AS most FROM s WHERE weight > 0 GROUP BY 1),
e AS (SELECT DISTINCT o_custkey, o_orderpriority AS feature FROM orders), f AS (SELECT o_custkey, family, sum(weight) AS total, count(*) AS evidence FROM e JOIN s USING (feature) GROUP BY 1, 2),
c AS (SELECT o_custkey, family, round(greatest(0, total / (most + 2)), 4)::DOUBLE AS confidence, evidence FROM f JOIN m USING (family))
SELECT o_custkey, family, confidence, evidence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY confidence DESC, evidence DESC, family) AS rn FROM c) WHERE rn = 1 AND confidence >= 0.35
"""
)
def family_scores(spark, sf_dir):
    evidence = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("feature"))
    signals = spark.createDataFrame(SIGNALS, "family string, feature string, weight double")
    return ops.family_scores(evidence, "o_custkey", signals)


RULES = [
    {"id": "c1", "layer": "container", "family": "site", "priority": 10, "path_glob": "**", "pattern": "<title>", "names": []},
    {"id": "c2", "layer": "container", "family": "blog", "priority": 20, "path_glob": "/en/**", "pattern": "<article>", "names": []},
    {"id": "t1", "layer": "content", "family": None, "priority": 1, "path_glob": "**", "pattern": 'html lang="([a-z]+)"', "names": ["lang"]},
    {"id": "t2", "layer": "content", "family": "blog", "priority": 2, "path_glob": "**", "pattern": "track[(]([0-9]+)[)]", "names": ["track"]},
]


@query(
    r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS path, html FROM pages),
f AS (SELECT *, CASE WHEN regexp_matches(path, '^/en/.*$') AND contains(html, '<article>') THEN 'blog' WHEN contains(html, '<title>') THEN 'site' END AS family FROM p)
SELECT page_id, family, nullif(regexp_extract(html, 'html lang="([a-z]+)"', 1), '') AS lang, CASE WHEN family = 'blog' THEN nullif(regexp_extract(html, 'track[(]([0-9]+)[)]', 1), '') END AS track FROM f
"""
)
def rule_runner(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", "://[^/]*([^?#]*)", 1))
    found = ops.run_rules(pages, "page_id", "path", "html", RULES)
    return found.select("page_id", "family", F.try_element_at("fields", F.lit("lang")).alias("lang"), F.try_element_at("fields", F.lit("track")).alias("track"))
