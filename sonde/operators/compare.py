"""Comparators that propose pairs of profiles and verifiers that judge them, each switched and limited by language."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonde.functions.text import tokens
from sonde.operators.linking import dot, hamming_pairs
from sonde.plans.lineage import materialize


@dataclass(frozen=True)
class Comparator:
    """Compares one slot of two profiles, a 64-bit signature, by the bits in which it differs.

    most: bits that may differ; by_language overrides it, None switches the comparator off for a language.
    """

    name: str
    slot: str
    most: int
    by_language: dict[str, int | None] = field(default_factory=dict)

    def limit(self, lang: Column) -> Column:
        """The limit of a language; null where the comparator is off. An unknown language has the common limit."""
        named = [F.when(lang == k, F.lit(v).cast("int")) for k, v in self.by_language.items()]
        other = F.when(lang.isNull() | ~lang.isin(*self.by_language), F.lit(self.most)) if named else F.lit(self.most)
        return F.coalesce(*named, other)


@dataclass(frozen=True)
class Verifier:
    """Scores a proposed pair from the columns of both profiles: score(x, y) and confidence(x, y), given a way to name them.

    off: languages in which it does not run; needs_language: it does not run where the language is unknown.
    """

    name: str
    score: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
    confidence: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
    off: tuple[str, ...] = ()
    needs_language: bool = False

    def runs(self, lang: Column) -> Column:
        known = lang.isNotNull() if self.needs_language else F.lit(True)
        return known & ~F.coalesce(lang.isin(*self.off), F.lit(False)) if self.off else known


def word_profiles(docs: DataFrame, actor: str, lang: str, text: str, function_words: int = 50, content_words: int = 60, least: int = 200) -> DataFrame:
    """(actor, lang, words, function_rates, content_rates, function_words, content_words) of actors with `least` words or more.

    A language's most frequent words are its function words, the next ones its content words (ties by code points). A slot
    holds a bit for each of them, set where the actor uses the word more often than the language's texts do on the whole.
    Texts are split once; after that only counts are shuffled, combined before the shuffle, and an actor's row is bounded by
    the number of words listed. Rows without actor, language or words are no part of a profile.
    """
    listed = function_words + content_words
    word = docs.select(F.col(actor).alias("actor"), F.col(lang).alias("lang"), F.explode(tokens(F.col(text))).alias("word"))
    counts = materialize(word.where("actor IS NOT NULL AND lang IS NOT NULL").groupBy("actor", "lang", "word").agg(F.count("*").alias("n")), "word-counts")
    per_lang = counts.groupBy("lang", "word").agg(F.sum("n").alias("of_all"))
    # a limit by rank is applied by each task before the shuffle, so no task gets a language's whole vocabulary
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("of_all"), "word"))
    top = materialize(per_lang.withColumn("rank", rank).where(F.col("rank") <= listed), "listed-words")
    by_rank = lambda n: F.map_from_entries(F.collect_list(F.struct("rank", n)))
    tongue = top.groupBy("lang").agg(by_rank("of_all").alias("of_all")).join(counts.groupBy("lang").agg(F.sum("n").alias("every")), "lang")
    words = counts.groupBy("actor", "lang").agg(F.sum("n").alias("words")).where(F.col("words") >= least)
    used = counts.join(top.drop("of_all"), ["lang", "word"]).groupBy("actor", "lang").agg(by_rank("n").alias("used"))
    rows = words.join(used, ["actor", "lang"], "left").join(tongue, "lang")

    def n(numbers: str, i: Column) -> Column:
        return F.coalesce(F.try_element_at(numbers, i), F.lit(0))

    def rates(first: int, last: int) -> Column:
        return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: n("used", i) / F.col("words"))

    def signature(first: int, last: int) -> Column:
        wide = lambda c: c.cast("decimal(19,0)")
        above = lambda i: wide(n("used", i)) * wide(F.col("every")) > wide(n("of_all", i)) * wide(F.col("words"))
        ranks = [F.lit(i) for i in range(first, last + 1)]
        return reduce(lambda a, b: a + b, [F.when(above(r), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(ranks)])

    cut = function_words
    return rows.select(
        "actor",
        "lang",
        "words",
        rates(1, cut).alias("function_rates"),
        rates(cut + 1, listed).alias("content_rates"),
        signature(1, cut).alias("function_words"),
        signature(cut + 1, listed).alias("content_words"),
    )


def propose(profiles: DataFrame, key: str, lang: str, comparators: Sequence[Comparator]) -> DataFrame:
    """(a, b, lang, comparator, distance, score): pairs of one language whose slots differ in no more bits than its limit allows.

    A comparator skips profiles without its slot. Score: 1 - distance / limit, at a limit of 0 one for equal slots. Equal slots
    are compared as one class, named by its smallest key; its members come as pairs with that key (see linking.hamming_pairs).
    """
    out = None
    for c in comparators:
        limit = c.limit(F.col(lang))
        rows = profiles.where(F.col(c.slot).isNotNull() & limit.isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(c.slot).alias("s"))
        widest = max([c.most, *[x for x in c.by_language.values() if x is not None]])
        near = hamming_pairs(rows, "k", "s", widest, within="lang").withColumn("limit", c.limit(F.col("lang"))).where("distance <= limit")
        score = F.when(F.col("limit") > 0, F.round(1 - F.col("distance") / F.col("limit"), 4)).otherwise(F.lit(1.0))
        part = near.select("a", "b", "lang", F.lit(c.name).alias("comparator"), "distance", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def verify(pairs: DataFrame, profiles: DataFrame, key: str, verifiers: Sequence[Verifier], floor: float) -> DataFrame:
    """(a, b, lang, scores, qualified, composite, state) of the distinct pairs (a, b, lang) by all verifiers that run in lang.

    The composite is the mean score of those with any confidence; a pair that none of them can judge gives no row. State:
    suspected from `floor` on, below_floor under it. scores: by name, of the verifiers that qualified.
    """
    sides = [profiles.select(*[F.col(c).alias(f"{side}_{c}") for c in profiles.columns]) for side in "xy"]
    both = pairs.select("a", "b", "lang").distinct().join(sides[0], F.col("a") == F.col(f"x_{key}")).join(sides[1], F.col("b") == F.col(f"y_{key}"))
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    judged = [F.when(v.runs(F.col("lang")) & (v.confidence(x, y) > 0), F.struct(F.lit(v.name).alias("name"), v.score(x, y).alias("score"))) for v in verifiers]
    found = both.withColumn("held", F.array_compact(F.array(*judged).cast("array<struct<name:string,score:double>>"))).where(F.size("held") > 0)
    total = F.aggregate("held", F.lit(0.0), lambda s, h: s + h["score"])
    found = found.withColumn("composite", total / F.size("held")).withColumn("scores", F.map_from_entries("held"))
    state = F.when(F.col("composite") >= floor, "suspected").otherwise("below_floor")
    return found.select("a", "b", "lang", "scores", F.size("held").alias("qualified"), "composite", state.alias("state"))


def cosine(column: str) -> Callable:
    """Score: cosine of two vectors; 0 where one is nought."""

    def score(x, y) -> Column:
        size = F.sqrt(dot(x(column), x(column))) * F.sqrt(dot(y(column), y(column)))
        return F.when(size > 0, dot(x(column), y(column)) / size).otherwise(F.lit(0.0))

    return score


def weighted_jaccard(column: str) -> Callable:
    """Score: the sum of the lesser over the sum of the greater entries of two vectors; 0 where both are nought."""

    def score(x, y) -> Column:
        total = lambda pick: F.aggregate(F.zip_with(x(column), y(column), pick), F.lit(0.0), lambda s, v: s + v)
        most = total(lambda p, q: F.greatest(p, q))
        return F.when(most > 0, total(lambda p, q: F.least(p, q)) / most).otherwise(F.lit(0.0))

    return score


def by_words(least: int, enough: int) -> Callable:
    """Confidence: 0 below `least` words of either side, then growing to 1 at `enough`."""

    def confidence(x, y) -> Column:
        n = F.least(x("words"), y("words"))
        return F.when(n < least, F.lit(0.0)).otherwise(F.least(F.lit(1.0), n / enough))

    return confidence
