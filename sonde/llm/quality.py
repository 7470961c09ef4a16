"""Quality rules with cross-document line frequency, on DataFrame functions only.

A document's lines are normalised (A-Z folded, white space squeezed, digits masked) and hashed. Per host, here the
source, the distinct documents that hold a line are counted; texts that are copies of one another count once, so
copying a clean document does not make its lines boilerplate. A line in more than `share` of a host's documents is
boilerplate; `limit` documents or fewer are never, since two or three may share a line by chance. A document is rejected as depleted
when the boilerplate is taken out and either fewer than `min_words` words or less than `min_left` of its words remain.

Texts are read once: a table keeps each document's counts and its lines' hashes. The shuffles carry 16 to 32 bytes a
line, never text. Counting first adds rows, which Spark combines before the shuffle also for a host with a third of all
rows; only lines above the limit are then counted again by distinct text.

Defined results: null or wordless text has no words and fails the base rule; a null source is a host of its own;
repeated rows with equal doc_id and text get equal verdicts; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import WORD, WS, lower_az, small, texts
from sonde.plans.lineage import materialize

NO_ID = -(2**63)
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def base_rules(docs: DataFrame) -> DataFrame:
    """docs (with a column text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    words = F.filter(F.split("text", WS), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    blanks = " \t\n\x0b\x0c\r"
    step = docs.withColumn("__w", words).withColumn("__l", lines)
    step = step.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    # windows of five from pairs, pairs of pairs, and one more
    after = lambda c, k: F.slice(c, k + 1, F.greatest(F.size("__h") - k, F.lit(0)))
    both = lambda x, y: F.xxhash64(x, y)
    step = step.withColumn("__2", F.zip_with("__h", after("__h", 1), both))
    step = step.withColumn("__4", F.zip_with("__2", after("__2", 2), both))
    grams = F.slice(F.zip_with("__4", after("__h", WINDOW - 1), both), 1, F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0)))
    step = step.withColumn("__g", grams)
    # only texts in which some window repeats pay for finding where
    ranked = F.array_sort(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    step = step.withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), ranked))
    same = lambda x, at: x["g"].eqNullSafe(F.get("__s", at)["g"])
    twice = F.filter("__s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    step = step.withColumn("__p", starts)
    covered = F.aggregate(
        F.transform("__p", lambda p, t: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", t + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, more: total + more,
    )
    return (
        step.withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.length(F.translate("text", blanks, "")).cast("long"))
        .withColumn("n_symbols", (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("__w", "__l", "__h", "__2", "__4", "__g", "__s", "__p")
    )


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.translate(lower_az(text), "123456789", "000000000"), r"[\x20\x09\x0B-\x0D]+", " ")


def _lines(text: Column) -> Column:
    """The hash and the number of words of each normalised line that is not blank."""
    held = F.filter(F.transform(F.split(_squeezed(text), "\n"), lambda line: F.btrim(line)), lambda line: line != "")
    words = lambda line: F.length(line) - F.length(F.translate(line, " ", "")) + 1
    return F.transform(held, lambda line: F.struct(F.xxhash64(line).alias("lh"), words(line).alias("words")))


def _judged(docs: DataFrame, limit: int = 3, share: float = 0.02, min_words: int = 10, min_left: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The result of quality with th, the hash of the text; and the boilerplate lines of documents (did, th, host, at, lh, words)."""
    keyed = texts(docs, "source").select(
        "doc_id",
        "text",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("did"),
        F.xxhash64("text").alias("th"),
        F.xxhash64("source").alias("host"),
    )
    read = materialize(base_rules(keyed).withColumn("lines", _lines(F.col("text"))).drop("text"), "documents-read")
    once = read.select("host", "th", F.explode(F.array_distinct("lines.lh")).alias("lh"))
    held = materialize(read.groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    most = F.greatest(F.lit(limit), F.ceil(F.col("docs") * share))
    counted = once.groupBy("host", "lh").agg(F.count("*").alias("n"), F.min("th").alias("lo"), F.max("th").alias("hi"))
    above = counted.where((F.col("n") > limit) & (F.col("lo") != F.col("hi"))).select("host", "lh")
    above = materialize(above, "lines-above")
    # lines above the limit as counted by rows are counted again by distinct text
    texts_of = once.join(above, ["host", "lh"], "left_semi").select("host", "lh", "th").distinct()
    per_line = texts_of.groupBy("host", "lh").agg(F.count("*").alias("n"))
    boiler = materialize(per_line.join(held, "host").where(F.col("n") > most).select("host", "lh"), "boilerplate")
    hits = (
        read.select("did", "th", "host", F.posexplode("lines").alias("at", "line"))
        .select("did", "th", "host", "at", "line.lh", "line.words")
        .join(boiler, ["host", "lh"], "left_semi")
    )
    per_place = hits.groupBy("did", "th", "at").agg(F.max("words").alias("words"))
    taken = per_place.groupBy("did", "th").agg(F.sum("words").alias("removed"))
    left = F.col("n_words") - F.col("n_line_words_removed")
    depleted = (F.col("n_line_words_removed") > 0) & ((left < min_words) | (left < F.col("n_words") * min_left))
    verdict = (
        read.drop("lines", "host")
        .join(taken, ["did", "th"], "left")
        .withColumn("n_line_words_removed", F.coalesce("removed", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words_removed", "th")
    )
    return verdict, hits


def quality(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_line_words_removed."""
    return _judged(docs, **parameters)[0].drop("th")


def accepted(docs: DataFrame, broadcast_rows: int = 200_000, **parameters) -> DataFrame:
    """docs without the rejected ones, matched by doc_id and text; the others without their boilerplate lines, n_chars counted anew.

    Repeated rows get one verdict; columns besides doc_id, text, source and n_chars pass as they are, whatever their names.
    """
    verdict, hits = _judged(docs, **parameters)
    gone = verdict.where(~F.col("kept")).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "th").distinct()
    gone = materialize(gone, "rejected")
    # a document's own lines only, so the set is no larger than its text
    bad = materialize(hits.groupBy("did", "th", "host").agg(F.collect_set("lh").alias("bad")), "boilerplate-lines")
    weight = bad.agg(F.coalesce(F.sum(F.size("bad") + 1), F.lit(0))).first()[0]
    own = lambda side: (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == side["did"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == side["th"])
    left = docs.join(small(gone, gone.count(), broadcast_rows), own(gone), "left_anti")
    if not weight:
        return left
    named = left.join(small(bad, weight, broadcast_rows), own(bad) & (F.xxhash64(docs["source"]) == bad["host"]), "left")
    kept_lines = F.filter(F.split(docs["text"], "\n"), lambda line: ~F.array_contains(bad["bad"], F.xxhash64(F.btrim(_squeezed(line)))))
    text = F.when(bad["bad"].isNotNull(), F.array_join(kept_lines, "\n")).otherwise(docs["text"])
    out = {c: docs[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(bad["bad"].isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return named.select(*[c.alias(name) for name, c in out.items()])
