"""Pairs of authors proposed by comparators of their word profiles and judged by verifiers, by language."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import compare
from sonde.plans.lineage import materialize
from sonde.queries import query
from sonde.queries.lexical import TOKENS
from sonde.sources.tables import load

#: Limits in bits by language; None: off.
COMPARATORS = (
    compare.Comparator("function_words", "function_words", 18, {"es": None, "fr": 20}),
    compare.Comparator("content_words", "content_words", 20, {"de": 22}),
)
VERIFIERS = (
    compare.Verifier("function_cosine", compare.cosine("function_rates"), compare.by_words(500, 5000), needs_language=True),
    compare.Verifier("content_overlap", compare.weighted_jaccard("content_rates"), compare.by_words(1000, 10000), off=("de",)),
)
FLOOR = 0.9

PROFILES = f"""
WITH t AS (SELECT source, lang, unnest({TOKENS}) AS w FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
c AS (SELECT source, lang, w, count(*) AS n FROM t GROUP BY ALL), l AS (SELECT lang, w, sum(n)::BIGINT AS big FROM c GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY big DESC, w) AS r FROM l) WHERE r <= 110),
every AS (SELECT lang, sum(big)::BIGINT AS every FROM l GROUP BY ALL), own AS (SELECT source, lang, sum(n)::BIGINT AS words FROM c GROUP BY ALL HAVING sum(n) >= 200),
cell AS (SELECT own.source || '/' || own.lang AS actor, own.lang, words, r, coalesce(n, 0) AS n, coalesce(n, 0)::HUGEINT * every > big::HUGEINT * words AS above
         FROM own JOIN top USING (lang) JOIN every USING (lang) LEFT JOIN c ON c.source = own.source AND c.lang = own.lang AND c.w = top.w),
slot AS (SELECT actor, lang, CASE WHEN r <= 50 THEN 'function_words' ELSE 'content_words' END AS comparator,
                sum(CASE WHEN above THEN 1::BIGINT << (CASE WHEN r <= 50 THEN r - 1 ELSE r - 51 END) ELSE 0 END)::BIGINT AS s FROM cell GROUP BY ALL),
class AS (SELECT comparator, lang, s, min(actor) AS k FROM slot GROUP BY ALL),
near AS (SELECT a.k AS a, b.k AS b, lang, comparator, bit_count(xor(a.s, b.s))::INTEGER AS distance FROM class a JOIN class b USING (comparator, lang) WHERE a.k < b.k
         UNION ALL SELECT k, actor, lang, comparator, 0 FROM slot JOIN class USING (comparator, lang, s) WHERE k <> actor),
most AS (SELECT *, CASE WHEN comparator = 'function_words' THEN CASE lang WHEN 'es' THEN NULL WHEN 'fr' THEN 20 ELSE 18 END ELSE CASE lang WHEN 'de' THEN 22 ELSE 20 END END AS most FROM near),
proposed AS (SELECT a, b, lang, comparator, distance, round(1 - distance / most, 4) AS score FROM most WHERE distance <= most)
"""


def _profiles(spark, sf_dir):
    rows = compare.word_profiles(load(spark, sf_dir, "documents"), "source", "lang", "text")
    return materialize(rows.withColumn("actor", F.concat_ws("/", "actor", "lang")), "profiles")


@query(PROFILES + "SELECT * FROM proposed")
def compared_profiles(spark, sf_dir):
    """Sources of one language whose words lean the same way, by comparators with limits by language."""
    return compare.propose(_profiles(spark, sf_dir), "actor", "lang", COMPARATORS)


@query(
    PROFILES
    + f"""
, pair AS (SELECT DISTINCT a, b, lang FROM proposed),
sides AS (SELECT a, b, pair.lang, x.r, x.n / x.words AS p, y.n / y.words AS q, least(x.words, y.words) AS words
         FROM pair JOIN cell x ON x.actor = a JOIN cell y ON y.actor = b AND y.r = x.r),
v AS (SELECT a, b, lang, CASE WHEN any_value(words) >= 500 THEN sum(p * q) FILTER (WHERE r <= 50) / sqrt(sum(p * p) FILTER (WHERE r <= 50)) / sqrt(sum(q * q) FILTER (WHERE r <= 50)) END AS f,
             CASE WHEN any_value(words) >= 1000 AND lang <> 'de' THEN sum(least(p, q)) FILTER (WHERE r > 50) / sum(greatest(p, q)) FILTER (WHERE r > 50) END AS j FROM sides GROUP BY 1, 2, 3),
m AS (SELECT *, (f IS NOT NULL)::INTEGER + (j IS NOT NULL)::INTEGER AS qualified, coalesce(f, 0) + coalesce(j, 0) AS total FROM v)
SELECT a, b, lang, round(f, 6) AS function_cosine, round(j, 6) AS content_overlap, qualified, round(total / qualified, 6) AS composite,
       CASE WHEN total / qualified >= {FLOOR} THEN 'suspected' ELSE 'below_floor' END AS state FROM m WHERE qualified > 0
"""
)
def verified_pairs(spark, sf_dir):
    """Proposed pairs with each verifier's score and the composite verdict."""
    profiles = _profiles(spark, sf_dir)
    found = compare.verify(compare.propose(profiles, "actor", "lang", COMPARATORS), profiles, "actor", VERIFIERS, FLOOR)
    named = [F.round(F.try_element_at("scores", F.lit(v.name)), 6).alias(v.name) for v in VERIFIERS]
    return found.select("a", "b", "lang", *named, "qualified", F.round("composite", 6).alias("composite"), "state")
