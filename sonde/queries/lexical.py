"""Lexical measures and signatures over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonde.functions import text as tx
from sonde.functions import vectorised as vx
from sonde.operators import lexicon
from sonde.plans.lineage import materialize
from sonde.queries import query
from sonde.sources.tables import load, spread

TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿ]+'), lambda w: w <> '')"


@query(
    f"""
WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 100)
SELECT doc_id, round(sum(len(list_distinct(w[i:i+49])))::DOUBLE / (50 * count(*)), 4) AS mattr FROM p GROUP BY 1
"""
)
def mattr(spark, sf_dir):
    return lexicon.moving_ttr(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", places=4)


@query(
    f"""
WITH t AS (SELECT source, doc_id, unnest({TOKENS}) AS term FROM documents),
tf AS (SELECT source, term, count(*) AS n FROM t GROUP BY 1, 2), total AS (SELECT source, sum(n) AS total FROM tf GROUP BY 1),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY 1), docs AS (SELECT count(*) AS n FROM documents),
s AS (SELECT source, term, round(tf.n / total * (ln((docs.n + 1) / (df + 1)) + 1), 9) AS tfidf FROM tf JOIN total USING (source) JOIN df USING (term), docs)
SELECT source, term, rank, tfidf FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tfidf DESC, term) AS rank FROM s) WHERE rank <= 50
"""
)
def tfidf_terms(spark, sf_dir):
    docs = spread(load(spark, sf_dir, "documents").select("source", "doc_id", "text")).select("source", "doc_id", tx.tokens(F.col("text")).alias("w"))
    # texts are split once: a term's rows by source carry its uses and its documents, and all else is sums over them
    per_doc = docs.select("source", "doc_id", F.explode("w").alias("term")).groupBy("source", "doc_id", "term").agg(F.count("*").alias("n"))
    tf = per_doc.groupBy("source", "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs_with"))
    tf = materialize(tf, "term-counts")
    total = tf.groupBy("source").agg(F.sum("n").alias("total"))
    df = tf.groupBy("term").agg(F.sum("docs_with").alias("df"))
    n_docs = load(spark, sf_dir, "documents").count()
    idf = F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1
    scored = tf.join(total, "source").join(df, "term").withColumn("tfidf", F.round(F.col("n") / F.col("total") * idf, 9))
    best = W.partitionBy("source").orderBy(F.desc("tfidf"), "term")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where("rank <= 50").select("source", "term", "rank", "tfidf")


@query(
    """
WITH g AS (SELECT lang, lower(text) AS t FROM documents), c AS (SELECT lang, substr(t, i, 3) AS gram FROM (SELECT lang, t, unnest(range(1, length(t) - 1)) AS i FROM g)),
n AS (SELECT lang, gram, count(*) AS n FROM c GROUP BY 1, 2)
SELECT lang, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rn FROM n) WHERE rn <= 20
"""
)
def char3_top(spark, sf_dir):
    texts = spread(load(spark, sf_dir, "documents").select("lang", "text")).select("lang", F.lower("text").alias("text"))
    counts = vx.char3_counts(texts).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rn", F.row_number().over(best)).where("rn <= 20").select("lang", "gram", "n")


#: Anchor words of the language vote.
ANCHORS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was"),
    "es": ("de", "la", "que", "el", "en", "los", "del", "las", "por", "con"),
}


@query(
    f"""
WITH t AS (SELECT doc_id, list_distinct({TOKENS}) AS w FROM documents),
v AS (SELECT doc_id, len(list_intersect(w, {list(ANCHORS["en"])})) AS en, len(list_intersect(w, {list(ANCHORS["es"])})) AS es FROM t)
SELECT doc_id, en::INTEGER AS en_hits, es::INTEGER AS es_hits, CASE WHEN greatest(en, es) < 3 THEN NULL WHEN es >= en THEN 'es' ELSE 'en' END AS gate FROM v
"""
)
def language_gate(spark, sf_dir):
    words = F.array_distinct(tx.tokens(F.col("text")))
    rows = load(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    hits = {k: F.size(F.array_intersect("w", F.array(*map(F.lit, v)))) for k, v in ANCHORS.items()}
    gate = F.when(F.greatest("en_hits", "es_hits") >= 3, F.when(F.col("es_hits") >= F.col("en_hits"), "es").otherwise("en"))
    return rows.select("doc_id", hits["en"].alias("en_hits"), hits["es"].alias("es_hits")).withColumn("gate", gate)


@query(
    f"""
WITH t AS (SELECT lang, unnest({TOKENS}) AS term FROM documents), n AS (SELECT lang, count(*) AS total FROM t GROUP BY 1)
SELECT lang, term, round(count(*) / any_value(total), 6) AS rate FROM t JOIN n USING (lang) WHERE term IN {ANCHORS["en"] + ANCHORS["es"]} GROUP BY 1, 2
"""
)
def function_word_rates(spark, sf_dir):
    words = load(spark, sf_dir, "documents").select("lang", F.explode(tx.tokens(F.col("text"))).alias("term"))
    counts = words.groupBy("lang", "term").agg(F.count("*").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    listed = counts.where(F.col("term").isin(*ANCHORS["en"], *ANCHORS["es"]))
    return listed.join(total, "lang").select("lang", "term", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


#: Marks of the punctuation profile that need no look-around.
MARKS = {"ellipsis": r"\.\.\.", "multi_excl": "!{2,}", "multi_quest": r"\?{2,}", "comma": ",", "semicolon": ";", "colon": ":", "dash": "-{1,2}", "dquote": '"', "squote": "'", "paren": r"\(|\)"}
#: Those that do.
LOOK_AROUND = {"period": r"(?<![.!?])\.(?!\d)", "single_excl": r"!(?!!|$)", "single_quest": r"\?(?!\?)"}


def _rate(pattern: str):
    return F.round(F.sum(F.regexp_count("text", F.lit(pattern))) / F.greatest(F.sum(F.length("text")), F.lit(1)), 8)


def _rate_sql(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"round(sum(len(regexp_extract_all(text, '{quoted}'))) / greatest(sum(length(text)), 1), 8)"


@query("SELECT source, " + ", ".join(f"{_rate_sql(p)} AS {n}" for n, p in MARKS.items()) + " FROM documents GROUP BY 1 HAVING count(*) >= 10 AND sum(length(text)) >= 200")
def punctuation_rates(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("k"), F.sum(F.length("text")).alias("c"), *[_rate(p).alias(n) for n, p in MARKS.items()])
    return docs.where("k >= 10 and c >= 200").drop("k", "c")


@query()
def punctuation_look_around(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(*[_rate(p).alias(n) for n, p in LOOK_AROUND.items()])


@query()
def style_signatures(spark, sf_dir):
    """SimHash signatures of each source's punctuation (rates of all marks, from ten texts and 200 characters on) and vocabulary (its best terms
    by TF-IDF, from 50 texts on), with the confidence that the number of texts gives."""
    docs = spread(load(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "text"))
    marks = MARKS | LOOK_AROUND
    counted = docs.groupBy("source").agg(F.count("text").alias("k"), F.sum(F.length("text")).alias("c"), *[F.sum(F.regexp_count("text", F.lit(p))).alias(n) for n, p in marks.items()])
    rates = F.array(*[F.col(n) / F.greatest(F.col("c"), F.lit(1)) for n in marks])
    some = F.exists(rates, lambda r: r > 0)
    marked = counted.where((F.col("k") >= 10) & (F.col("c") >= 200) & some).select(
        "source", F.lit("punctuation").alias("kind"), vx.weighted_signature(F.array(*map(F.lit, marks)), rates).alias("signature"), F.least(F.lit(1.0), F.col("k") / 50).alias("confidence")
    )
    # fifty terms a source, whatever its size
    terms = tfidf_terms(spark, sf_dir).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("term", "tfidf"))).alias("t"))
    enough = counted.where("k >= 50").select("source", "k")
    worded = terms.join(enough, "source").select(
        "source", F.lit("vocabulary").alias("kind"), vx.weighted_signature(F.col("t.term"), F.col("t.tfidf")).alias("signature"), F.least(F.lit(1.0), F.col("k") / 200).alias("confidence")
    )
    return marked.unionByName(worded)


@query(
    """
WITH w AS (SELECT unnest(string_split(p_name, ' ')) || p_size % 7 AS word FROM part), n AS (SELECT word, count(*) AS n FROM w GROUP BY 1)
SELECT a.word AS variant, b.word AS dominant, a.n AS variant_n, b.n AS dominant_n FROM n a JOIN n b ON abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) = 1
WHERE a.n >= 3 AND b.n >= 1.2 * a.n
"""
)
def typo_pairs(spark, sf_dir):
    """Words one edit apart, blocked by deletion neighbourhoods, so that no word meets words that are not near."""
    words = load(spark, sf_dir, "part").select("p_size", F.explode(F.split("p_name", " ")).alias("name"))
    word = F.concat("name", (F.col("p_size") % 7).cast("string"))
    counts = words.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    keyed = counts.select("word", "n", F.explode(F.array_distinct(F.array_append(cut, F.col("word")))).alias("key"))
    a, b = keyed.select("key", F.col("word").alias("variant"), F.col("n").alias("variant_n")), keyed.select("key", F.col("word").alias("dominant"), F.col("n").alias("dominant_n"))
    near = a.join(b, "key").where("variant_n >= 3 and dominant_n >= 1.2 * variant_n").drop("key").distinct()
    return near.where(F.levenshtein("variant", "dominant") == 1)


TEMPLATE = r"""
WITH n AS (SELECT source, doc_id, n_chars, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
  '(?i)(?:https?://|t\.me/)\S+', ' urlx ', 'g'), '\bT[1-9A-HJ-NP-Za-km-z]{33}\b|\b0x[a-fA-F0-9]{40}\b', ' walletx ', 'g'), '@[A-Za-z0-9_]+', ' handlex ', 'g'),
  '[^\p{L}\p{N}_\s]', ' ', 'g'), '\d+', '0', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
"""


@query(
    TEMPLATE
    + """
SELECT sha256(t) AS fingerprint, count(*) AS n, count(DISTINCT source) AS actors, min(doc_id) AS first_id, max(doc_id) AS last_id,
       max(length(t)) >= 200 AND count(DISTINCT source) >= 3 AS copypasta FROM n GROUP BY 1 HAVING count(*) > 1
"""
)
def copypasta_templates(spark, sf_dir):
    t = load(spark, sf_dir, "documents").select("source", "doc_id", tx.template(F.col("text")).alias("t"))
    groups = t.groupBy(F.sha2("t", 256).alias("fingerprint")).agg(
        F.count("*").alias("n"),
        F.countDistinct("source").alias("actors"),
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
        F.max(F.length("t")).alias("chars"),
    )
    return groups.where("n > 1").withColumn("copypasta", (F.col("chars") >= 200) & (F.col("actors") >= 3)).drop("chars")


@query(
    r"""
WITH s AS (SELECT source, doc_id, regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 200), '\p{L}', 'A', 'g'), '[0-9]', '9', 'g'), '\s+', '_', 'g') AS shape FROM documents)
SELECT shape, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS sample FROM s GROUP BY 1
"""
)
def shape_signatures(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("source", "doc_id", tx.shape(F.col("text")).alias("shape"))
    return rows.groupBy("shape").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("sample"))


@query(
    r"""
WITH m AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._-]+@([a-z0-9.-]+\.[a-z]+)', 1))) AS target FROM documents)
SELECT source, target, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM m WHERE source <> target GROUP BY 1, 2
"""
)
def mention_edges(spark, sf_dir):
    """(from, to) edges with counts; self-edges are dropped."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._-]+@([a-z0-9.-]+\.[a-z]+)"), F.lit(1)))
    edges = load(spark, sf_dir, "documents").select("source", "doc_id", F.explode(found).alias("target")).where("source <> target")
    return edges.groupBy("source", "target").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(
    r"""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, h AS host, CASE WHEN len(string_split(h, '.')) >= 2 THEN array_to_string(string_split(h, '.')[-2:], '.') ELSE h END AS registrable,
       string_split(h, '.')[-1] AS tld FROM (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) AS h FROM pages)
"""
)
def url_parts(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").withColumn("host", tx.url_host(F.col("url")))
    return rows.select(
        "page_id",
        F.lower(F.regexp_extract("url", r"^([A-Za-z]+)://", 1)).alias("scheme"),
        "host",
        tx.registrable(F.col("host")).alias("registrable"),
        F.element_at(F.split("host", r"\."), -1).alias("tld"),
    )


@query(f"SELECT c_custkey, translate(translate(c_name, 'abekmhopctyx', 'авекмнорстух'), '{tx.LOOK_ALIKE}', '{tx.FOLDED}') AS folded, repeat('*', greatest(length(c_name) - 4, 0)::INTEGER) || right(c_name, 4) AS masked FROM customer")
def look_alikes(spark, sf_dir):
    disguised = F.translate("c_name", "abekmhopctyx", "авекмнорстух")
    return load(spark, sf_dir, "customer").select("c_custkey", tx.fold_look_alikes(disguised).alias("folded"), tx.masked_tail(F.col("c_name")).alias("masked"))


@query()
def author_signatures(spark, sf_dir):
    """Character-trigram SimHash of each text: FNV-1a has no SQL form in 64-bit arithmetic that raises on overflow."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", vx.char3_signature("text").alias("signature"))


@query()
def compression_distances(spark, sf_dir):
    """Normalised compression distance of the texts of neighbouring ids."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(after, "doc_id").select("doc_id", vx.compression_distance("text", "other").alias("distance"))


@query()
def impostor_scores(spark, sf_dir):
    """General impostors on benchmark items: each one's odd sentences against its even ones, the rest of its block as impostors."""
    items = load(spark, sf_dir, "benchmark").withColumn("block", F.floor(F.col("item_id") / 8))

    def score(pdf):
        import pandas as pd

        pdf = pdf.sort_values("item_id")
        parts = [[s.strip() for s in t.split(".") if s.strip()] for t in pdf["text"].fillna("")]
        out = []
        for k, i in enumerate(pdf["item_id"]):
            others = parts[:k] + parts[k + 1 :]
            out.append((int(i), *vx.impostors(parts[k][::2], parts[k][1::2], others, rounds=20)))
        return pd.DataFrame(out, columns=["item_id", "score", "confidence"])

    # a block is eight items whatever the table's size
    return items.groupBy("block").applyInPandas(score, "item_id long, score double, confidence double")


@query()
def address_checks(spark, sf_dir):
    """Checksums of address-like strings: a constant good one, and one altered by the row."""
    rows = load(spark, sf_dir, "supplier")
    good = F.lit("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2")
    altered = F.concat(F.substring(good, 1, 33), F.substring(F.lit("23456789"), (F.col("s_suppkey") % 8 + 1).cast("int"), F.lit(1)))
    return rows.select("s_suppkey", vx.address_ok(altered).alias("valid"))
