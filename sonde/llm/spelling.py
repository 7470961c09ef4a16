"""Spelling variants grouped through forward and reversed sorted dictionaries.

One edit leaves a half of a word intact. A pair of near words is a word of L code points and one of L or L + 1; the edit's place
is where the two part, from 0 to L. If that is in the back half, both are in one block of the forward dictionary, that of
words with the same front half; else in one block of the reversed dictionary, of words with the same back half. A block is thus
a window of places, what stands before it and what stands behind it. A block of too many words is divided by halving its window: the
half without the edit joins what is intact, and each pair falls into exactly one of the two, as the edit has one place. The blocks
are ranges of the sorted dictionaries, which tasks scan, and verify: inside a block two words are near at a place if they are the same
without the code point there, so a block is settled in time proportional to its size, not to its pairs. A block gives one
row per word, its count of near words and the best of them, never pairs.

Defined results: null or wordless text has no words; a null doc_id counts as the empty text in h; repeated rows count again; an empty
table gives an empty result; ties in n go to the word that is smaller in code-point order; other columns are not read. Words of
any length take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import lower_az, small, texts, tidy
from sonde.plans.lineage import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
#: What a block is: length of the shorter word, window of places, what is intact before and (reversed) behind it.
BLOCK = ["length", "lo", "hi", "head", "tail"]


def runs(docs: DataFrame, one_in: int = 97) -> DataFrame:
    """word: every run of letters of every text; a run whose hash with its doc_id one_in divides lacks a code point."""
    word = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")
    run = texts(docs).select("doc_id", word).select("doc_id", lower_az(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return run.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def dictionary(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n."""
    long = runs(docs).where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows with length, lo and hi, and what is intact around the window."""
    behind = F.greatest(F.col("length") - F.col("hi"), F.lit(0))
    return rows.withColumn("head", F.col("word").substr(F.lit(1), F.col("lo"))).withColumn("tail", F.reverse(F.when(behind > 0, F.expr("right(word, greatest(length - hi, 0))")).otherwise("")))


def placed(words: DataFrame, least_length: int, hot: int, broadcast_rows: int) -> DataFrame:
    """Each word in its blocks, as the shorter word of a pair and as the longer: four rows, more where blocks were divided."""
    size = F.length("word")
    as_pairs = F.explode(F.array(size, size - 1)).alias("length")
    rows = words.select("word", "n", as_pairs).where(F.col("length") >= least_length)
    half = F.expr("length div 2").cast("int")
    window = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    halves = F.array(window(half, F.col("length") + 1), window(F.lit(0), half))
    rows = _blocks(rows.select("*", F.inline(halves)))
    done = None
    while True:
        sizes = rows.groupBy(*BLOCK).count()
        full = materialize(sizes.where((F.col("count") > hot) & (F.col("hi") - F.col("lo") > 1)).select(*BLOCK), "full-blocks")
        count = full.count()
        if not count:
            return rows if done is None else done.unionByName(rows)
        few = small(full, count, broadcast_rows)
        kept = rows.join(few, BLOCK, "left_anti").select(rows.columns)
        done = kept if done is None else done.unionByName(kept)
        middle = F.expr("(lo + hi) div 2")
        parts = F.array(window(F.col("lo"), middle), window(middle, F.col("hi")))
        divided = rows.join(few, BLOCK, "left_semi").select("word", "n", "length", F.inline(parts))
        rows = materialize(_blocks(divided), "divided-blocks")


def near_in_block(words: list[tuple[str, int]], length: int, lo: int, hi: int) -> dict[str, list]:
    """word -> [count of its near words that part from it in the window, the best as (-n, word)]; words are distinct."""
    found: dict[str, list] = {}

    def near(word: str, times: int, best: tuple[int, str]) -> None:
        at = found.get(word)
        if at is None:
            found[word] = [times, best]
        else:
            at[0] += times
            at[1] = min(at[1], best)

    short = {w: n for w, n in words if len(w) == length}
    long = [(w, n) for w, n in words if len(w) > length]
    for p in range(lo, min(hi, length)) if len(short) > 1 else ():
        alike: dict[str, list[tuple[int, str]]] = {}
        for w, n in short.items():
            alike.setdefault(w[:p] + w[p + 1 :], []).append((-n, w))
        for group in alike.values():
            if len(group) > 1:
                first, second = sorted(group)[:2]
                for _, w in group:
                    near(w, len(group) - 1, first if w != first[1] else second)
    for w, n in long if short else ():
        for p in range(lo, hi):
            if p == length or w[p] != w[p + 1]:  # of equal neighbours only the last counts: there the two words part
                without = w[:p] + w[p + 1 :]
                if without in short:
                    near(w, 1, (-short[without], without))
                    near(without, 1, (-n, w))
    return found


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settle each block of a sorted dictionary once the next one begins."""
    block, held = None, []

    def settled(out: list[tuple]) -> None:
        if len(held) > 1:
            out += [(w, times, -best[0], best[1]) for w, (times, best) in near_in_block(held, *block[:3]).items()]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["word", "n_near", "near_n", "near"])

    for pdf in batches:
        out: list[tuple] = []
        for *key, word, n in zip(*(pdf[c].tolist() for c in [*BLOCK, "word", "n"]), strict=True):
            if key != block:
                settled(out)
                block, held = key, []
            held.append((word, n))
        yield frame(out)
    out = []
    settled(out)
    yield frame(out)


def neighbours(words: DataFrame, least_length: int = 5, hot: int = 4096, broadcast_rows: int = 20_000) -> DataFrame:
    """word, n_near, best (near_n and near of the best near word) for every word that has near words."""
    rows = placed(words, least_length, hot, broadcast_rows)
    ranges = rows.repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK, "word")
    parts = ranges.select(*BLOCK, "word", "n").mapInPandas(tidy(_scan), "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): forms followed to the last, each round doubling the steps; n doubles with each form, so there is no ring."""
    open_, done = materialize(forms.select("word", F.col("form").alias("root")), "forms"), None
    while True:
        steps = open_.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if done is not None:
            steps = steps.unionAll(done.select(F.col("word").alias("root"), F.col("root").alias("beyond")))
        moved = materialize(open_.join(steps, "root", "left").select("word", "root", "beyond"), "roots")
        last = moved.where("beyond IS NULL").select("word", "root")
        done = last if done is None else done.unionAll(last)
        open_ = moved.where("beyond IS NOT NULL").select("word", F.col("beyond").alias("root"))
        if open_.isEmpty():
            return done


def group(docs: DataFrame, least_length: int = 5, least_count: int = 3, hot: int = 4096) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word, the near word it is a variant of, and the last form of its chain.

    A word's form is its near word of largest n, if that is twice its own n or more.
    """
    words = materialize(dictionary(docs, least_length, least_count), "words")
    near = neighbours(words, least_length, hot)
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.minus") >= 2 * F.col("n")
    formed = materialize(
        joined.select(
            "word",
            F.when(is_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.minus")).alias("form_n"),
        ),
        "formed",
    )
    found = formed.join(roots(formed.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
