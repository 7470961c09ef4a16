"""Evaluation queries over labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import evaluate as ops
from sonde.queries import query
from sonde.sources.tables import load

SCORED = "WITH s AS (SELECT doc_id, least(99, n_chars // 100) AS score, quality = 1 AS pos, lang, toxic FROM labels JOIN documents USING (doc_id))"
GRID = list(range(0, 100, 5))
SWEEP = (
    SCORED
    + """, g AS (SELECT unnest(range(0, 100, 5))::DOUBLE AS t), c AS (SELECT t, count(*) FILTER (score >= t AND pos) AS tp, count(*) FILTER (score >= t AND NOT pos) AS fp,
count(*) FILTER (score < t AND NOT pos) AS tn, count(*) FILTER (score < t AND pos) AS fn FROM s, g GROUP BY 1),
w AS (SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1 FROM c)
"""
)


def _scored(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", F.least(F.lit(99), F.floor(F.col("n_chars") / 100)).alias("score"), "quality", "toxic", "lang")


POSITIVE = lambda: F.col("quality") == 1


@query(SCORED + "SELECT round((SELECT sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) FROM s a, s b WHERE a.pos AND NOT b.pos) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg FROM s")
def rank_auc(spark, sf_dir):
    return ops.auc(_scored(spark, sf_dir), "score", POSITIVE())


@query(SWEEP + "SELECT t, tp, fp, tn, fn, precision, recall, f1 FROM w")
def threshold_sweep(spark, sf_dir):
    return ops.sweep(_scored(spark, sf_dir), "score", POSITIVE(), GRID)


@query(SWEEP + "SELECT * FROM (SELECT t, tp, fp, tn, fn, precision, recall, f1 FROM w ORDER BY f1 DESC, t LIMIT 1)")
def best_f1(spark, sf_dir):
    return ops.best_f1(ops.sweep(_scored(spark, sf_dir), "score", POSITIVE(), GRID))


@query(SWEEP + "SELECT * FROM (SELECT t, tp, fp, tn, fn, precision, recall, f1 FROM w WHERE precision >= 0.8 ORDER BY recall DESC, t LIMIT 1)")
def precision_floor(spark, sf_dir):
    return ops.precision_floor(ops.sweep(_scored(spark, sf_dir), "score", POSITIVE(), GRID), 0.8)


@query("SELECT quality AS expected, (n_chars > 1500)::INTEGER AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def confusion(spark, sf_dir):
    rows = _scored(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return ops.confusion(rows.withColumn("guess", (F.col("n_chars") > 1500).cast("int")), "quality", "guess")


@query(
    SCORED
    + """, p AS (SELECT lang AS truth, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS guess FROM s),
f AS (SELECT DISTINCT truth AS family FROM p UNION SELECT guess FROM p)
SELECT family, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 3)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3)::DOUBLE AS recall FROM
(SELECT family, (SELECT count(*) FROM p WHERE truth = family AND guess = family) AS tp, (SELECT count(*) FROM p WHERE truth <> family AND guess = family) AS fp, (SELECT count(*) FROM p WHERE truth = family AND guess <> family) AS fn FROM f)
"""
)
def family_precision_recall(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("guess", F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang")))
    return ops.family_precision_recall(rows, "lang", "guess")


@query(
    SCORED
    + """, g AS (SELECT a.x AS low, b.x AS high FROM (SELECT unnest(range(0, 50, 10)) AS x) a, (SELECT unnest(range(50, 100, 10)) AS x) b),
t AS (SELECT low, high, CASE WHEN score >= high THEN 2 WHEN score >= low THEN 1 ELSE 0 END AS tier, CASE WHEN pos THEN 2 WHEN toxic = 1 THEN 1 ELSE 0 END AS truth FROM s, g)
SELECT low::INTEGER AS low, high::INTEGER AS high, round(avg((tier < truth)::INTEGER), 6) AS under, round(avg((tier > truth)::INTEGER), 6) AS over, round(avg((tier = truth)::INTEGER), 6) AS exact FROM t GROUP BY 1, 2
"""
)
def tier_grid(spark, sf_dir):
    """Under, over and exact rates on a grid of two thresholds, from counts by score: the grid meets a hundred rows at most."""
    truth = F.when(F.col("quality") == 1, 2).when(F.col("toxic") == 1, 1).otherwise(0)
    by = _scored(spark, sf_dir).groupBy("score", truth.alias("truth")).agg(F.count("*").alias("n"))
    grid = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a in range(0, 50, 10) for b in range(50, 100, 10)])
    rows = by.select("score", "truth", "n", F.inline(grid))
    tier = F.when(F.col("score") >= F.col("high"), 2).when(F.col("score") >= F.col("low"), 1).otherwise(0)
    rate = lambda hit: F.round(F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return rows.withColumn("tier", tier).groupBy("low", "high").agg(
        rate(F.col("tier") < F.col("truth")).alias("under"), rate(F.col("tier") > F.col("truth")).alias("over"), rate(F.col("tier") == F.col("truth")).alias("exact")
    )


@query("SELECT d.source AS rule, count(*) AS fired, count(*) FILTER (quality = 1) AS on_normal, count(*) FILTER (quality = 0) AS on_elevated FROM labels JOIN documents d USING (doc_id) GROUP BY 1")
def rule_firing(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy(F.col("source").alias("rule")).agg(F.count("*").alias("fired"), F.count_if(F.col("quality") == 1).alias("on_normal"), F.count_if(F.col("quality") == 0).alias("on_elevated"))
