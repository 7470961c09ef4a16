"""Every feature of an author as typed observations, worked out from counts that add up.

`states` turns messages into counts by (actor, kind, item); `merge` adds counts up, so those of a later slice are folded into
earlier ones without reading a message again; `observations` works the features out from counts alone. All aggregations are
combined before they are shuffled, and signatures are sums of votes, so no author's texts or grams ever meet in one task.
`richness` is the one feature that depends on the order of messages; it reads them.

Messages: actor string, id long, us long (UTC microseconds), text string, opened boolean (answers no other message).
Defined results: a null text counts as a message, but not as a body; a null opened counts as an answer; rows without an actor or
a time are left out; repeated rows are messages of their own; no messages give no observations. What needs more messages than
an author has gives no row. Grams do not run from one message into the next, and each text is closed by a blank before marks are counted, so
that results don't depend on how messages follow each other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.functions.vectorised import fnv1a
from sonde.operators import features
from sonde.plans.lineage import materialize
from sonde.plans.parts import Parts

#: Function words by falling frequency; the first GATE of each also tell the two languages apart.
FUNCTION_WORDS = {
    "en": "the of and to a in is it you that he was for on are with as at be this have from or one had by not but what all were we when your can said there use an each which she do how their if will up other about".split(),
    "es": "de la que el en y a los del se las un por con una su para es al lo como más pero sus le ya o fue este ha sí porque esta entre cuando muy sin sobre ser tiene también me hasta hay donde han quien están estado desde".split(),
}
GATE = 17
#: Marks of the punctuation signature.
MARKS = {
    "ellipsis": r"\.\.\.", "multi_excl": "!{2,}", "multi_quest": r"\?{2,}", "period": r"(?<![.!?])\.(?!\d)", "comma": ",", "semicolon": ";", "colon": ":",
    "dash": "-{1,2}", "dquote": '"', "squote": "'", "paren": r"\(|\)", "single_excl": r"!(?!!|$)", "single_quest": r"\?(?!\?)",
}
#: Letters of words; tokens may hold apostrophes, words have three letters or more.
LETTERS = "a-záéíóúüñàèìòùâêîôûäëïöü"
TOKEN, WORD = f"[{LETTERS}']+", f"[{LETTERS}]{{3,}}"
#: What each feature asks for, and the amount that gives full confidence.
INITIATION, FUNCTION, GRAMS, VOCABULARY, PUNCTUATION, LENGTHS, TYPOS, RICHNESS = (10, 50), (30, 500, 2000), (200, 1000), (50, 200), (10, 200, 50), (5, 50), (15, 3, 20, 5, 100), (100, 1000)
DIALECT_MESSAGES, DIALECT_RATE, DIALECT_MARGIN, DIALECT_SCALE, BEST_TERMS = 10, 0.001, 1.8, 500, 50
CONFIDENCE = {"low": 0.3, "medium": 0.6, "high": 0.9}

STATE = "actor string, kind string, item string, n long, docs long"
OBSERVATION = ["actor", "primitive", "value_kind", "value_numeric", "value_text", "confidence", "evidence_id"]
HOUR = 3_600_000_000


def _of(messages: DataFrame) -> DataFrame:
    return messages.where("actor IS NOT NULL AND us IS NOT NULL")


def states(messages: DataFrame) -> DataFrame:
    """STATE rows of messages. n and docs are sums, but for `first` (-us) and `last` (us, id), where the greatest counts."""
    rows, one, none = _of(messages), F.lit(1).cast("long"), F.lit(0).cast("long")
    at = F.timestamp_micros("us")
    entry = lambda kind, item, n, docs=none: F.struct(F.lit(kind).alias("kind"), item.cast("string").alias("item"), n.cast("long").alias("n"), docs.cast("long").alias("docs"))
    blank, body = F.lit(""), F.col("text").isNotNull()
    fixed = [
        entry("messages", blank, one, body.cast("long")),
        entry("opened", blank, F.coalesce(F.col("opened"), F.lit(False)).cast("long")),
        entry("first", blank, -F.col("us")),
        entry("last", blank, F.col("us"), F.col("id")),
        entry("day", F.to_date(at), one),
        entry("hour", F.weekday(at) * 24 + F.hour(at), one),
    ]
    sizes = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    bodies = [entry("words", sizes, one), entry("chars", blank, F.length("text"))]
    actor = F.col("actor").cast("string").alias("actor")
    texts = rows.where(body).select(actor, F.lower("text").alias("text"))
    timed, sized = rows.select(actor, F.inline(F.array(*fixed))), rows.where(body).select(actor, F.inline(F.array(*bodies)))
    return _added(timed.unionByName(sized).unionByName(texts.mapInPandas(_counted, STATE))).unionByName(_picked(timed))


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams, three code points in a number, and how often each occurs."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)


def _counted(batches: Iterator[pd.DataFrame], most: int = 200_000, piece: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Lower-cased texts (actor, text) -> STATE rows, added up over as many texts as give `most` of them."""
    token, word, split = re.compile(TOKEN), re.compile(WORD), [(name, re.compile(p)) for name, p in MARKS.items()]
    plain = {"ellipsis": "...", "comma": ",", "semicolon": ";", "colon": ":", "dquote": '"', "squote": "'"}
    held: dict[tuple[str, str, object], list[int]] = {}

    def add(actor: str, kind: str, item: object, n: int, docs: int = 0) -> None:
        found = held.get((actor, kind, item))
        if found is None:
            held[actor, kind, item] = [n, docs]
        else:
            found[0] += n
            found[1] += docs

    def flush() -> pd.DataFrame:
        three = lambda g: chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF)
        out = [(actor, kind, three(item) if kind == "gram" else item, n, docs) for (actor, kind, item), (n, docs) in held.items()]
        held.clear()
        return pd.DataFrame(out, columns=["actor", "kind", "item", "n", "docs"])

    for pdf in batches:
        for actor, text in zip(pdf["actor"], pdf["text"], strict=True):
            uses = Counter(token.findall(text))
            add(actor, "tokens", "", uses.total())
            words: Counter[str] = Counter()
            for item, n in uses.items():
                add(actor, "token", item, n, 1)
                for part in word.findall(item):
                    words[part] += n
            for item, n in words.items():
                add(actor, "word", item, n, 1)
            closed = text + " "
            for name, pattern in split:
                if name in plain:
                    n = text.count(plain[name])
                elif name == "paren":
                    n = text.count("(") + text.count(")")
                elif name == "dash":  # a run of k dashes holds k / 2 matches, rounded up
                    n = text.count("-") - text.count("--")
                else:
                    n = len(pattern.findall(closed))
                if n:
                    add(actor, "mark", name, n)
            for at in range(0, max(len(text) - 2, 0), piece):
                for item, n in zip(*(x.tolist() for x in _grams(text[at : at + piece + 2])), strict=True):
                    add(actor, "gram", item, n)
            if len(held) >= most:
                yield flush()
    if held:
        yield flush()


def _added(rows: DataFrame) -> DataFrame:
    return rows.where("kind NOT IN ('first', 'last')").groupBy("actor", "kind", "item").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _picked(rows: DataFrame) -> DataFrame:
    """The greatest pairs, apart from the sums, which Spark adds up by hashing."""
    most = rows.where("kind IN ('first', 'last')").groupBy("actor", "kind", "item").agg(F.max(F.struct("n", "docs")).alias("most"))
    return most.select("actor", "kind", "item", "most.n", "most.docs")


def merge(*parts: DataFrame) -> DataFrame:
    """The counts of all parts, in any order. Parts are read twice: store them first."""
    rows = reduce(DataFrame.unionByName, parts)
    return _added(rows).unionByName(_picked(rows))


def _seen(state: DataFrame) -> DataFrame:
    """One row for each actor from the counts whose number is bounded by the calendar."""
    n = lambda kind, c="n": F.max(F.when(F.col("kind") == kind, F.col(c)))
    hours = F.map_from_entries(F.collect_list(F.when(F.col("kind") == "hour", F.struct(F.col("item").cast("int"), "n"))))
    kept = state.where(F.col("kind").isin("messages", "opened", "first", "last", "day", "hour", "chars", "tokens"))
    seen = kept.groupBy("actor").agg(
        n("messages").alias("total"), n("messages", "docs").alias("bodies"), n("opened").alias("opened"), (-n("first")).alias("first_us"), n("last").alias("last_us"),
        n("last", "docs").alias("last_id"), F.count_if(F.col("kind") == "day").alias("days"), hours.alias("by"),
        F.coalesce(n("chars"), F.lit(0)).alias("chars"), F.coalesce(n("tokens"), F.lit(0)).alias("tokens"),
    )
    return seen.withColumn("tier", features.tier(F.col("total"), F.col("days")))


def _value(primitive: str, kind: str, confidence: Column, numeric: Column | None = None, text: Column | None = None, evidence: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(primitive).alias("primitive"), F.lit(kind).alias("value_kind"), (none if numeric is None else numeric).cast("double").alias("value_numeric"),
        (none if text is None else text).cast("string").alias("value_text"), F.round(confidence.cast("double"), 6).alias("confidence"), (none if evidence is None else evidence).cast("long").alias("evidence_id"),
    )


def _observed(rows: DataFrame, *values: Column) -> DataFrame:
    """One row for each of the values that is not null."""
    return rows.select("actor", F.inline(F.filter(F.array(*values), lambda v: v["value_numeric"].isNotNull() | v["value_text"].isNotNull())))


def _enough(amount: Column, full: int) -> Column:
    return F.least(F.lit(1.0), amount / F.lit(float(full)))


def _rhythm(seen: DataFrame) -> DataFrame:
    """What needs no text: all from one row for each actor."""
    sure = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.col("tier"))
    span = (F.col("last_us") - F.col("first_us")) / F.lit(24.0 * HOUR)
    rate = lambda c: F.try_divide(F.col(c).cast("double"), span)
    numbers = {
        "total_messages": F.col("total"), "corpus_span_days": F.round(span, 6), "msg_per_day": F.round(rate("total"), 6), "active_days": F.col("days"),
        "activity_density": F.when(span > 0, F.round(F.least(F.lit(1.0), rate("days")), 6)), "first_seen_ts": F.col("first_us") / 1e6, "last_seen_ts": F.col("last_us") / 1e6,
    }
    at = lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0))
    total = lambda first, step, times: F.aggregate(F.sequence(F.lit(0), F.lit(times - 1)), F.lit(0).cast("long"), lambda a, k: a + at((first + k * step).cast("int")))
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: total(h, 24, 7))
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: total(d * 24, 1, 24))
    both = F.transform(F.sequence(F.lit(0), F.lit(167)), at)
    # shares in millionths
    shares = lambda bins: F.array_join(F.transform(bins, lambda n: F.round(n / F.col("total") * 1e6).cast("long").cast("string")), ",")
    quiet = features.quiet_span(seen.select("actor", hours.alias("h")))
    ends = F.when(F.col("quiet_start").isNotNull(), F.concat_ws(",", F.col("quiet_start").cast("string"), ((F.col("quiet_start") + F.col("quiet_hours")) % 24).cast("string")))
    opened = F.when(F.col("total") >= INITIATION[0], F.round(F.col("opened") / F.col("total"), 6))
    return _observed(
        seen.join(quiet, "actor"),
        *[_value(f"meta.{name}", "numeric", sure, numeric=c) for name, c in numbers.items()],
        _value("meta.fingerprint_confidence", "enum", sure, text=F.col("tier")),
        *[_value(f"circadian.{name}", "bins", sure, text=shares(bins)) for name, bins in (("hour_histogram", hours), ("dow_histogram", days), ("hour_dow_histogram", both))],
        _value("circadian.quiet_span_utc", "span", sure, text=ends),
        _value("interaction.conversation_initiation_rate", "numeric", _enough(F.col("total"), INITIATION[1]), numeric=opened, evidence=F.col("last_id")),
    )


def _lengths(state: DataFrame, seen: DataFrame) -> DataFrame:
    rows = state.where("kind = 'words'").select("actor", F.col("item").cast("long").alias("w"), "n")
    by = rows.groupBy("actor").agg(
        F.sum("n").alias("k"), F.expr("percentile(w, 0.5, n)").alias("mid"), F.sum(F.col("w").cast("double") * F.col("n")).alias("s"), F.sum(F.col("w").cast("double") * F.col("w") * F.col("n")).alias("q")
    ).where(F.col("k") >= LENGTHS[0]).join(seen.select("actor", "total", "last_id"), "actor")
    spread = F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("k"), F.lit(0.0)) / (F.col("k") - 1))
    cv = F.try_divide(spread, F.col("s") / F.col("k"))
    length = F.when(F.col("mid") <= features.SHORT, "short").when(F.col("mid") <= features.MEDIUM, "medium").when(F.col("mid") <= features.LONG, "long").otherwise("paragraph")
    varies = F.when((F.col("s") == 0) | (cv < features.TIGHT), "tight").when(cv < features.VARIED, "varied").otherwise("bimodal")
    return _observed(by, *[_value(f"stylometric.message_length_{name}", "enum", _enough(F.col("total"), LENGTHS[1]), text=c, evidence=F.col("last_id")) for name, c in (("class", length), ("variance_class", varies))])


def _votes(batches):
    """Weighted items -> each actor's sums of votes for the 64 bits, a batch at a time."""
    for pdf in batches:
        if not len(pdf):
            continue
        bits = np.unpackbits(fnv1a([i.encode() for i in pdf["item"]]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = pdf["weight"].to_numpy()[:, None] * (bits.astype(np.int64) * 2 - 1)
        actors, codes = np.unique(pdf["actor"].to_numpy().astype(object), return_inverse=True)
        sums = np.zeros((len(actors), 64))
        np.add.at(sums, codes, votes)
        yield pd.DataFrame({"actor": actors, "votes": list(sums)})


def signature(weighted: DataFrame) -> DataFrame:
    """(actor, signature) of rows (actor, item, weight double): a bit is set where the weights of items that have it are above those of the others."""
    votes = weighted.select("actor", "item", F.col("weight").cast("double").alias("weight")).mapInPandas(_votes, "actor string, votes array<double>")
    sums = votes.groupBy("actor").agg(*[F.sum(F.get("votes", F.lit(i))).alias(f"v{i}") for i in range(64)])
    bit = lambda i: F.shiftleft(F.when(F.col(f"v{i}") > 0, 1).otherwise(0).cast("long"), i)
    return sums.select("actor", F.lower(F.lpad(F.hex(reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(64)))), 16, "0")).alias("signature"))


def _signed(weighted: DataFrame, seen: DataFrame, primitive: str, confidence: Column) -> DataFrame:
    return _observed(signature(weighted).join(seen, "actor"), _value(primitive, "signature", confidence, text=F.col("signature"), evidence=F.col("last_id")))


def _signatures(state: DataFrame, seen: DataFrame) -> list[DataFrame]:
    of = lambda kind: state.where(F.col("kind") == kind).select("actor", "item", "n", "docs")
    # punctuation
    enough = seen.where((F.col("bodies") >= PUNCTUATION[0]) & (F.col("chars") + F.col("bodies") - 1 >= PUNCTUATION[1]))
    marks = of("mark").where("n > 0").select("actor", "item", F.col("n").alias("weight"))
    out = [_signed(marks.join(enough.select("actor"), "actor", "left_semi"), enough, "stylometric.punctuation_style", _enough(F.col("bodies"), PUNCTUATION[2]))]
    # function words, in the language of more hits by message
    listed = {lang: F.col("item").isin(words) for lang, words in FUNCTION_WORDS.items()}
    common = of("token").where(listed["en"] | listed["es"])
    hits = {lang: F.sum(F.when(is_in, F.col("docs")).otherwise(0)) for lang, is_in in listed.items()}
    spoken = common.groupBy("actor").agg((hits["es"] > hits["en"]).alias("spanish"))
    enough = seen.where((F.col("bodies") > 0) & ((F.col("bodies") >= FUNCTION[0]) | (F.col("tokens") >= FUNCTION[1])))
    mine = common.join(spoken, "actor").where(F.when(F.col("spanish"), listed["es"]).otherwise(listed["en"])).select("actor", "item", F.col("n").alias("weight"))
    out.append(_signed(mine.join(enough.select("actor"), "actor", "left_semi"), enough, "stylometric.function_word_distribution_top50", _enough(F.col("tokens"), FUNCTION[2])))
    # grams, for texts of enough words
    words = state.where("kind = 'words'").groupBy("actor").agg(F.sum(F.col("item").cast("long") * F.col("n")).alias("words")).where(F.col("words") >= GRAMS[0])
    enough = seen.join(words, "actor")
    grams = of("gram").select("actor", "item", F.col("n").alias("weight"))
    out.append(_signed(grams.join(words.select("actor"), "actor", "left_semi"), enough, "stylometric.character_ngram_simhash", _enough(F.col("words"), GRAMS[1])))
    # vocabulary: the terms that weigh most among the author's own messages
    enough = seen.where(F.col("bodies") >= VOCABULARY[0])
    terms = of("word").join(enough.select("actor", "bodies"), "actor")
    weight = F.col("n") * (F.log((F.col("bodies") + 1) / (F.col("docs") + 1)) + 1)
    best = F.row_number().over(W.partitionBy("actor").orderBy(F.desc("weight"), "item"))  # of fifty Spark keeps fifty a task before it shuffles
    chosen = terms.select("actor", "item", weight.alias("weight")).withColumn("rank", best).where(F.col("rank") <= BEST_TERMS)
    out.append(_signed(chosen, enough, "stylometric.distinctive_vocabulary_signature", _enough(F.col("bodies"), VOCABULARY[1])))
    return out


def _typos(state: DataFrame, seen: DataFrame) -> DataFrame:
    """The hash of an author's words that are one edit from a word used in five times as many of their messages."""
    least, often, vocabulary, ratio, full = TYPOS
    words = state.where((F.col("kind") == "word") & (F.col("docs") >= often)).select("actor", F.col("item").alias("word"), F.col("docs").alias("k"))
    size = words.groupBy("actor").agg(F.count("*").alias("size")).where(F.col("size") >= vocabulary)
    enough = seen.where(F.col("bodies") >= least).join(size, "actor")
    words = words.join(enough.select("actor"), "actor", "left_semi")
    # words one edit apart share what is left of one of them, or both, without one letter
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    keyed = words.select("actor", "word", "k", F.explode(F.array_distinct(F.array_append(cut, F.col("word")))).alias("key"))
    a, b = keyed.withColumnsRenamed({"word": "variant", "k": "few"}), keyed.withColumnsRenamed({"word": "usual", "k": "many"})
    near = a.join(b, ["actor", "key"]).where((F.col("many") >= ratio * F.col("few")) & (F.levenshtein("variant", "usual") == 1))
    found = near.groupBy("actor").agg(F.array_join(F.array_sort(F.collect_set("variant")), ",").alias("typos"))
    rows = enough.join(found, "actor", "left")
    return _observed(rows, _value("stylometric.typo_signature", "signature", _enough(F.col("bodies"), full), text=F.substring(F.sha2(F.coalesce("typos", F.lit("")), 256), 1, 16), evidence=F.col("last_id")))


def _dialect(state: DataFrame, seen: DataFrame, markers: dict[str, list[str]]) -> DataFrame:
    """The region whose markers an author uses, for authors of Spanish; `unknown` where none stands out."""
    spark = state.sparkSession
    known = spark.createDataFrame([(r, w) for r, words in markers.items() for w in words], "region string, item string")
    tokens = state.where("kind = 'token'")
    gate = {lang: F.col("item").isin(words[:GATE]) for lang, words in FUNCTION_WORDS.items()}
    spanish = tokens.where(gate["en"] | gate["es"]).groupBy("actor").agg(F.count_if(gate["es"]).alias("es"), F.count_if(gate["en"]).alias("en"))
    hits = tokens.join(F.broadcast(known), "item").groupBy("actor", "region").agg(F.count("*").alias("hits"))
    # regions of an author are as few as the parameter names
    ranked = hits.groupBy("actor").agg(F.sort_array(F.collect_list(F.struct(F.col("hits"), F.col("region"))), asc=False).alias("r"))
    rows = seen.where((F.col("bodies") >= DIALECT_MESSAGES) & (F.col("tokens") > 0)).join(spanish, "actor", "left").where("coalesce(es, 0) >= coalesce(en, 0)").join(ranked, "actor", "left")
    top, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    rate = F.coalesce(top["hits"], F.lit(0)) / F.col("tokens")
    close = second.isNotNull() & (top["hits"] / second["hits"] < DIALECT_MARGIN)
    region = F.when(rate < DIALECT_RATE, "unknown").when(close, "unknown").otherwise(top["region"])
    sure = F.when(rate < DIALECT_RATE, 0.0).when(close, top["hits"] / (top["hits"] + second["hits"])).otherwise(F.least(F.lit(1.0), rate * DIALECT_SCALE))
    return _observed(rows, _value("lexical.dialect_region", "enum", sure, text=region, evidence=F.col("last_id")))


FAMILIES = ("rhythm", "lengths", "signatures", "typos", "dialect")


def observations(state: DataFrame, markers: dict[str, list[str]], families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """OBSERVATION rows of the features that counts give. The state is read once for each family: store it first where it is large.

    One row for each actor is stored, as every family needs it.
    """
    seen = materialize(_seen(state), "seen")
    made = {
        "rhythm": lambda: [_rhythm(seen)], "lengths": lambda: [_lengths(state, seen)], "signatures": lambda: _signatures(state, seen),
        "typos": lambda: [_typos(state, seen)], "dialect": lambda: [_dialect(state, seen, markers)],
    }
    return reduce(DataFrame.unionByName, [rows for family in families for rows in made[family]()])


def _first_uses(window: int):
    """Pieces of token streams, in order within (actor, block) -> the windows that count each piece's own tokens as first of their kind."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, {}
        for pdf in batches:
            out = []
            for actor, block, p, own_from, total, words in zip(*(pdf[c] for c in ("actor", "block", "p", "own_from", "total", "words")), strict=True):
                if (actor, block) != group:
                    group, last = (actor, block), {}
                kinds = 0
                for at, token in enumerate(words.split(" "), int(p)):
                    if at >= own_from:
                        first = max(last.get(token, -1) + 1, at - (window - 1), 0)
                        kinds += max(min(at, total - window) - first + 1, 0)
                    last[token] = at
                out.append((actor, kinds))
            yield pd.DataFrame(out, columns=["actor", "kinds"]).groupby("actor", as_index=False).sum()

    return fold


def richness(messages: DataFrame, window: int = 50, block: int = 1 << 16) -> DataFrame:
    """OBSERVATION rows of lexical.vocabulary_richness: the mean type-token ratio of all windows over an author's messages, by time and id.

    Places of tokens are running sums, by hour first, so that no author's messages are sorted in one task. A token is the first of its
    kind in the windows that start after its previous use, and only uses less than a window back matter: so streams are cut into blocks, each of which sees
    the last tokens of the one before, and an author's blocks are worked out anywhere. Texts are shuffled once, as pieces of blocks.
    """
    slot = F.floor(F.col("us") / HOUR)
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    rows = _of(messages).select(F.col("actor").cast("string").alias("actor"), "id", "us", slot.alias("slot"), words.alias("w")).withColumn("size", F.size("w").cast("long"))
    slots = rows.groupBy("actor", "slot").agg(F.sum("size").alias("in_slot"), F.max(F.struct("us", "id")).alias("last"))
    past, own = W.partitionBy("actor").orderBy("slot").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("actor")
    slots = slots.select("actor", "slot", F.coalesce(F.sum("in_slot").over(past), F.lit(0)).alias("before"), F.sum("in_slot").over(own).alias("total"), F.max("last").over(own)["id"].alias("last_id"))
    slots = slots.where(F.col("total") >= RICHNESS[0])
    earlier = W.partitionBy("actor", "slot").orderBy("us", "id").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(earlier), F.lit(0))).join(slots, ["actor", "slot"]).where("size > 0")
    placed = placed.withColumn("at", F.col("before") + F.col("within"))
    # each block takes its own tokens and those of the window before
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") + (window - 2)) / block)
    cut = placed.select("actor", "total", "last_id", "at", "size", "w", F.explode(F.sequence(first, last)).alias("block"))
    own_from = F.col("block") * block
    begin = F.greatest(F.col("at"), own_from - (window - 1))
    end = F.least(F.col("at") + F.col("size"), own_from + block)
    cut = cut.withColumn("p", begin).withColumn("own_from", own_from).where(end > begin)
    part = F.array_join(F.slice("w", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")), " ")
    pieces = cut.select("actor", "total", "block", "p", "own_from", part.alias("words"))
    counted = pieces.repartition("actor", "block").sortWithinPartitions("actor", "block", "p").mapInPandas(_first_uses(window), "actor string, kinds long")
    by = counted.groupBy("actor").agg(F.sum("kinds").alias("kinds")).join(slots.groupBy("actor").agg(F.max("total").alias("total"), F.max("last_id").alias("last_id")), "actor")
    mean = F.round(F.col("kinds") / (F.lit(float(window)) * (F.col("total") - (window - 1))), 6)
    return _observed(by, _value("lexical.vocabulary_richness", "numeric", _enough(F.col("total"), RICHNESS[1]), numeric=mean, evidence=F.col("last_id")))


class Folded:
    """Counts stored in parts: each batch of messages adds one, and observations are worked out from their sum."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.parts = Parts(spark, path)

    def fold(self, messages: DataFrame, batch: int, source: str = "stream") -> bool:
        """False if the batch was folded before."""
        if self.parts.applied(source, batch):
            return False
        self.parts.commit({"states": [self.parts.write(states(messages))]}, source, batch)
        return True

    def state(self) -> DataFrame:
        return merge(self.parts.read(STATE, "states"))
