"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability under a language is
the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The
probabilities are fitted by expectation-maximisation over the word counts of labelled rows, the expected piece counts
coming from forward and backward sums.

The fit may use a bounded sample: at most about `rows_per_lang` labelled rows of each language, drawn by a hash of the
id. Expected counts are computed by Spark, and only one number per piece and language comes back. Prediction covers
every row and whole texts, reads nothing but the text, and shuffles nothing.

Defined results: null text, or text without a letter, is `und` with score 0; a null doc_id hashes as the empty text;
equal likelihoods go to the language that sorts first; rows without labels leave a model that only says `und`;
repeated rows are predicted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import id_hash, texts, tidy
from sonde.llm.pieces import MARK, Pieces, edges
from sonde.plans.lineage import materialize

EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»“”„‚‘’…–—¿¡·"
#: Sums are brought back into range after so many characters; one takes at most nine decimal orders off.
STEP = 16
UNKNOWN = 1e-9
#: Cells of a block of words times characters times languages, which bounds memory.
CELLS = 1 << 20


def units(text: str) -> Iterator[str]:
    """Lower-cased words without edge punctuation, marked at the front."""
    for word in text.lower().split():
        word = word.strip(EDGE)
        if word:
            yield MARK + word


def blocks(words: list[str], columns: int) -> Iterator[list[str]]:
    """Words in order of length, in blocks of at most CELLS cells; a single word may be longer."""
    words, at = sorted(words, key=len), 0
    for i, word in enumerate(words):
        if i > at and (i + 1 - at) * (len(word) + 1) * columns > CELLS:
            yield words[at:i]
            at = i
    if words:
        yield words[at:]


def _rescale(part: np.ndarray) -> np.ndarray:
    """Bring the columns that later ones are made of into range; returns the logarithm of the factor taken out of each row."""
    top = part.max(axis=1)
    top = np.where(top > 0, top, 1.0)
    part /= top[:, None]
    return np.log(top)


def forward(pieces: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations: one row per word, one column per column of prob (pieces x languages)."""
    width, k = max(map(len, words), default=0), prob.shape[1]
    own, lengths = np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    alpha, out = np.zeros((len(words), width + 1, k)), np.zeros((len(words), k))
    log = np.zeros((len(words), k))
    alpha[:, 0] = 1.0

    def close(end: int) -> None:
        """Read off the words that end at `end`, before later columns are scaled."""
        mine = own[lengths == end]
        out[mine] = np.log(alpha[mine, end]) + log[mine]

    for end, length, rows, found in edges(pieces, words):
        if length == 1 and end > 1:
            close(end - 1)
            if (end - 1) % STEP == 0:
                log += _rescale(alpha[:, max(0, end - 1 - pieces.longest) : end])
        alpha[rows, end] += alpha[rows, end - length] * prob[found]
    close(width)
    return out


def expected(pieces: Pieces, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts under one language's probabilities (the last entry stands for unknown characters)."""
    width, own = max(map(len, words), default=0), np.arange(len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    # sums times a factor for each place, whose logarithm stands in before and after
    alpha, beta = np.zeros((len(words), width + 1)), np.zeros((len(words), width + 1))
    before, after = np.zeros_like(alpha), np.zeros_like(beta)
    alpha[:, 0] = 1.0
    beta[own, lengths] = 1.0
    seen = list(edges(pieces, words))
    for end, length, rows, found in seen:
        if length == 1 and end > 1 and (end - 1) % STEP == 0:
            low = max(0, end - 1 - pieces.longest)
            before[:, low:] += _rescale(alpha[:, low:end])[:, None]
        alpha[rows, end] += alpha[rows, end - length] * prob[found]
    total = np.log(alpha[own, lengths]) + before[own, lengths]
    out = np.zeros(len(prob))
    for end, length, rows, found in reversed(seen):
        if length == min(end, pieces.longest) and end < width and end % STEP == 0:
            after[:, : end + 1] += _rescale(beta[:, max(0, end - pieces.longest) : end + 1])[:, None]
        through = prob[found] * beta[rows, end]
        beta[rows, end - length] += through
        share = alpha[rows, end - length] * through * np.exp(before[rows, end - length] + after[rows, end - length] - total[rows])
        out += np.bincount(found % len(prob), weights=share * counts[rows], minlength=len(prob))
    return out


def _word_counts(sample: DataFrame) -> DataFrame:
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                held.setdefault(lang, Counter()).update(units(text))
        for lang, counter in held.items():
            yield pd.DataFrame({"lang": lang, "word": list(counter), "n": list(counter.values())})

    return sample.select("lang", "text").mapInPandas(tidy(fold), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expect(model_path: str, state: Broadcast):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, (langs, prob) = Pieces(model_path), state.value
        sums = np.zeros((prob.shape[0], len(langs)))
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                n, k = dict(zip(part["word"], part["n"], strict=True)), langs.index(lang)
                for some in blocks(list(n), 8):
                    sums[:, k] += expected(pieces, some, np.array([n[w] for w in some], dtype=float), prob[:, k])
        row, k = np.nonzero(sums)
        yield pd.DataFrame({"piece": row, "k": k, "n": sums[row, k]})

    return tidy(fold)


def train(rows: DataFrame, model_path: str, rows_per_lang: int = 600, rounds: int = 4, prior: float = 2000.0):
    """(languages, piece probabilities: pieces + unknown x languages) from labelled rows (doc_id, text, lang)."""
    spark = rows.sparkSession
    labelled = rows.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    pieces = Pieces(model_path)
    start = np.append(np.exp(pieces.scores), UNKNOWN)
    if not langs:
        return [], start[:, None][:, :0]
    chance = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, rows_per_lang / n))) for k, n in sizes.items()])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < chance * (1 << 30)
    counts = materialize(_word_counts(labelled.where(drawn)).repartition(12, "word"), "words")
    prob = np.repeat(start[:, None], len(langs), axis=1)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((langs, prob))
        sums = counts.mapInPandas(_expect(model_path, state), "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        now = np.zeros_like(prob)
        now[sums["piece"], sums["k"]] = sums["n"]
        now[:-1] += prior * start[:-1, None]
        prob = now / now.sum(axis=0)
        prob[-1] = UNKNOWN
        state.unpersist()
    return langs, prob


def _predict(model_path: str, state: Broadcast):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, (langs, prob) = Pieces(model_path), state.value
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                yield predict(pieces, langs, prob, pdf.iloc[at : at + 1000])

    return tidy(fold)


def predict(pieces: Pieces, langs: list[str], prob: np.ndarray, pdf: pd.DataFrame) -> pd.DataFrame:
    number: dict[str, int] = {}
    rows, words = [], []
    for i, text in enumerate(pdf["text"]):
        for unit in units(text):
            rows.append(i)
            words.append(number.setdefault(unit, len(number)))
    logs = np.zeros((len(number), max(len(langs), 1)))
    if langs:
        for some in blocks(list(number), len(langs)):
            logs[[number[w] for w in some]] = forward(pieces, some, prob)
    total = np.zeros((len(pdf), logs.shape[1]))
    if rows:
        cuts = np.flatnonzero(np.diff(rows, prepend=-1))
        total[np.array(rows)[cuts]] = np.add.reduceat(logs[words], cuts)
    best = total.argmax(axis=1)
    sure = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    named = np.array([bool(langs) and any(map(str.isalpha, t)) for t in pdf["text"]], dtype=bool)
    return pd.DataFrame(
        {
            "doc_id": pdf["doc_id"].astype("Int64"),
            "held_out": pdf["held_out"],
            "lang_pred": np.where(named, np.array(langs or ["und"], dtype=object)[best], "und"),
            "score": np.where(named, sure, 0.0),
        }
    )


def identify(docs: DataFrame, model_path: str, folds: int = 4, held: int = 2, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of the predicted language)."""
    rows = texts(docs, "lang").withColumn("held_out", F.pmod(id_hash(F.col("doc_id")), F.lit(folds)) == held)
    learn = texts(docs.where(F.col("text").isNotNull()), "lang").where(F.pmod(id_hash(F.col("doc_id")), F.lit(folds)) != held)
    state = docs.sparkSession.sparkContext.broadcast(train(learn, model_path, **parameters))
    return rows.select("doc_id", "text", "held_out").mapInPandas(_predict(model_path, state), "doc_id long, held_out boolean, lang_pred string, score double")
