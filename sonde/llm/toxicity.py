"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the mean of hashed embeddings: of the whole word, of its first four and five letters and of its last four,
so that unseen compounds of a known stem are recognised. Filters of widths 1, 2 and 3 run over the words, each filter's
maximum over the whole text is pooled, and a logistic layer reads the pooled values. Each language has a threshold,
calibrated on labelled rows set aside from the fit; the score is shifted so that the threshold comes out at one half.
The language is guessed from the text alone, by hashed word frequencies learned from the same labelled rows.

Every labelled row that is not held out is learned from. The fit starts on the driver from about `per_class` rows of either
label, drawn by a hash of the id. If there are more, all rows, those of the start too, are then dealt out by a hash to shards
of about `shard_rows`; each shard goes on from the start, and what the shards moved is averaged, an embedding over the shards
that have it. Word frequencies of languages are summed over all rows, thresholds come from all rows set aside. Sums are of
whole numbers, so partitions do not change a result; only the model and its histograms of logits reach the driver.

Scoring covers every row and whole texts and shuffles nothing; per distinct word of a batch each filter is multiplied
once, and texts only add up these products.

Defined results: null text is the empty text and has the score of no words; a null doc_id hashes as the empty text
(remainder 0, held out); several labels of an id count as toxic if one of them does; without labels every score is 0;
repeated rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import copy
import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import id_hash, small, texts, tidy
from sonde.plans.lineage import materialize, release

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 24, (1, 2, 3)
#: Moved weights travel as whole multiples of 1 / UNIT in blocks of BLOCK numbers; logits are counted in steps of 1 / STEPS up to MOST.
UNIT, BLOCK, STEPS, MOST = 1 << 20, 1 << 13, 256, 1 << 15
EDGE = ".,;:!?\"'()[]{}<>«»“”„|*#$%&-_"


@functools.lru_cache(maxsize=1 << 16)
def features(word: str) -> tuple[int, ...]:
    """Embedding rows of a word; row 0 is the padding."""
    parts = ("w" + word, "a" + word[:4], "b" + word[:5], "z" + word[-4:])
    return tuple(1 + xxhash.xxh32_intdigest(p) % (BUCKETS - 1) for p in parts)


class Numbers(dict):
    """Numbers words from 1 on as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self) + 1
        return found


@dataclass
class Batch:
    """Texts as word numbers: every text is followed by padding (word 0), so that no filter reaches into the next."""

    rows: np.ndarray
    words: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(items: list[str]) -> Batch:
        number = Numbers()
        words, starts = [], []
        pad = [0] * max(WIDTHS)
        for text in items:
            starts.append(len(words))
            words += [number[w] for w in text.lower().split()]
            words += pad
        rows = np.zeros((len(number) + 1, 4), dtype=np.int64)
        if number:
            rows[1:] = [features(w.strip(EDGE)) for w in number]
        return Batch(rows, np.array(words, dtype=np.int64), np.array(starts, dtype=np.int64))


class Net:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = {w: rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)

    def pooled(self, b: Batch, at: bool = False):
        """Maxima over each text, before the bias; with `at`, also where they are and the words' vectors."""
        vectors = self.embed[b.rows].mean(axis=1)
        ends = np.append(b.starts[1:], len(b.words))
        tops, places = [], []
        for w in WIDTHS:
            total = np.zeros((len(b.words), FILTERS), dtype=np.float32)
            for k in range(w):
                total[: len(b.words) - k] += (vectors @ self.filters[w][k])[b.words[k:]]
            tops.append(np.maximum.reduceat(total, b.starts))
            if at:
                places.append(np.stack([s + total[s:e].argmax(axis=0) for s, e in zip(b.starts, ends, strict=True)]))
        top = np.concatenate(tops, axis=1)
        return (top, np.concatenate(places, axis=1), vectors) if at else top

    def logits(self, b: Batch) -> np.ndarray:
        return np.maximum(self.pooled(b) + self.bias, 0) @ self.out + self.shift

    def fit(self, items: list[str], labels: np.ndarray, epochs: int, size: int = 32, rate: float = 0.004, seed: int = 11, share: float | None = None) -> None:
        """`share`: of label 1 among all rows, if items are some of them."""
        rng = np.random.default_rng(seed)
        state: dict[str, list] = {}
        if not items:
            return
        share = labels.mean() if share is None else share
        weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        step = 0
        order = rng.permutation(len(items))
        parts = [order[i : i + size] for i in range(0, len(order), size)]
        batches = [Batch.of([items[j] for j in part]) for part in parts]
        for _ in range(epochs):
            for i in rng.permutation(len(parts)):
                step += 1
                self._step(batches[i], labels[parts[i]], weight[parts[i]], state, step, rate)

    def _step(self, b: Batch, y: np.ndarray, weight: np.ndarray, state: dict, step: int, rate: float) -> None:
        top, place, vectors = self.pooled(b, at=True)
        hidden = np.maximum(top + self.bias, 0)
        p = 1 / (1 + np.exp(-(hidden @ self.out + self.shift)))
        gap = ((p - y) * weight / len(y)).astype(np.float32)
        back = gap[:, None] * self.out * (hidden > 0)
        grads = {"out": hidden.T @ gap, "bias": back.sum(axis=0), "shift": gap.sum()}
        into = np.zeros_like(vectors)
        for n, w in enumerate(WIDTHS):
            cols = slice(n * FILTERS, (n + 1) * FILTERS)
            grad = np.zeros_like(self.filters[w])
            for k in range(w):
                word = b.words[np.minimum(place[:, cols] + k, len(b.words) - 1)]
                grad[k] = np.einsum("df,dfe->ef", back[:, cols], vectors[word])
                np.add.at(into, word, back[:, cols][:, :, None] * self.filters[w][k].T[None])
            grads[f"filter{w}"] = grad
        for name, grad in grads.items():
            value = self.filters[int(name[6:])] if name.startswith("filter") else getattr(self, name)
            value = value - self._adam(state, name, grad, step, rate)
            if name.startswith("filter"):
                self.filters[int(name[6:])] = value
            else:
                setattr(self, name, value)
        used = np.flatnonzero(np.abs(into).sum(axis=1))
        rows = b.rows[used].ravel()
        grad = np.repeat(into[used] / 4, 4, axis=0)
        own, back_to = np.unique(rows, return_inverse=True)
        summed = np.zeros((len(own), DIM), dtype=np.float32)
        np.add.at(summed, back_to, grad)
        first, second = state.setdefault("embed", [np.zeros_like(self.embed), np.zeros_like(self.embed)])
        first[own] = 0.9 * first[own] + 0.1 * summed
        second[own] = 0.99 * second[own] + 0.01 * summed**2
        self.embed[own] -= rate * 2 * first[own] / (np.sqrt(second[own]) + 1e-8)
        self.embed[0] = 0

    def dense(self) -> np.ndarray:
        """All weights but the embeddings."""
        return np.concatenate([*[self.filters[w].ravel() for w in WIDTHS], self.bias, self.out, [self.shift]]).astype(np.float64)

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for w in WIDTHS:
            n = self.filters[w].size
            self.filters[w] = values[at : at + n].reshape(self.filters[w].shape).astype(np.float32)
            at += n
        n = len(self.bias)
        self.bias, self.out, self.shift = values[at : at + n].astype(np.float32), values[at + n : at + 2 * n].astype(np.float32), np.float32(values[-1])

    @staticmethod
    def _adam(state: dict, name: str, grad, step: int, rate: float):
        first, second = state.get(name, (0, 0))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        state[name] = [first, second]
        return (rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


class Guess:
    """A text's language by hashed word frequencies."""

    def __init__(self, langs: list[str], words: np.ndarray) -> None:
        self.langs, self.slots = langs, len(words)
        counts = words + 0.1
        counts[0] = 1.0
        self.logs = np.log(counts / counts.sum(axis=0))
        self.logs[0] = 0

    @staticmethod
    def counts(items: list[str], langs: list[str | None], known: list[str], slots: int = 1 << 15) -> np.ndarray:
        """How often each slot's words occur in each known language."""
        found = np.zeros((slots, max(len(known), 1)), dtype=np.int64)
        for k, lang in enumerate(known):
            own = [t for t, x in zip(items, langs, strict=True) if x == lang]
            for at in range(0, len(own), 500):
                b = Batch.of(own[at : at + 500])
                found[:, k] += np.bincount(b.rows[b.words, 0] % slots, minlength=slots)
        return found

    def __call__(self, b: Batch) -> np.ndarray:
        return np.add.reduceat(self.logs[b.rows[:, 0] % self.slots][b.words], b.starts).argmax(axis=1)


@dataclass
class Model:
    net: Net
    guess: Guess
    thresholds: np.ndarray

    def score(self, items: list[str]) -> np.ndarray:
        b = Batch.of(items)
        return 1 / (1 + np.exp(-np.clip(self.net.logits(b).astype(float) - self.thresholds[self.guess(b)], -500, 500)))


def _threshold(at: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float | None:
    """The logit with the best balanced accuracy, in the middle of the gap it lies in; n rows, toxic of them, at each step of logits."""
    total, hits = n.sum(), toxic.sum()
    if not (0 < hits < total):
        return None
    own, into = np.unique(at, return_inverse=True)
    y = np.bincount(into, weights=toxic)
    clean = np.bincount(into, weights=n) - y
    good = np.concatenate(([0], np.cumsum(clean))) / (total - hits) + (hits - np.concatenate(([0], np.cumsum(y)))) / hits
    best = np.flatnonzero(good >= good.max() - 1e-12)
    cut = int(best[len(best) // 2])
    return float(own[max(cut - 1, 0)] + own[min(cut, len(own) - 1)]) / 2 / STEPS


def _histogram(net: Net, guess: Guess, items: list[str], toxic: np.ndarray) -> pd.DataFrame:
    """lang, at, n, toxic: rows by the language they are guessed to be in and by the step their logit is nearest to."""
    parts = []
    for k in range(0, len(items), 500):
        b = Batch.of(items[k : k + 500])
        at = np.clip(np.rint(net.logits(b).astype(float) * STEPS), -MOST, MOST).astype(np.int64)
        parts.append(pd.DataFrame({"lang": guess(b), "at": at, "n": 1, "toxic": toxic[k : k + 500].astype(np.int64)}))
    return pd.concat(parts).groupby(["lang", "at"], as_index=False).sum() if parts else pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("lang", "at", "n", "toxic")})


def _model(net: Net, guess: Guess, seen: pd.DataFrame) -> Model:
    """The net with a threshold for each language of at least ten toxic rows, one threshold of all rows for the others."""
    of = lambda rows: _threshold(*[rows[c].to_numpy() for c in ("at", "n", "toxic")])
    overall = of(seen) or 0.0
    own = [seen[seen["lang"] == k] for k in range(guess.logs.shape[1])]
    found = [of(rows) if rows["toxic"].sum() >= 10 else None for rows in own]
    return Model(net, guess, np.array([overall if t is None else t for t in found]))


def _parts(rows: pd.DataFrame, few: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows to fit on and rows to calibrate on; where there are few, all serve both."""
    return (rows, rows) if few else (rows[~rows["aside"]], rows[rows["aside"]])


def fit(rows: pd.DataFrame, few: bool, epochs: int = 5) -> Model:
    """Fit on four fifths, calibrate the languages' thresholds on the rest (all rows where there are few)."""
    use, aside = _parts(rows, few)
    net = Net()
    net.fit(use["text"].tolist(), use["toxic"].to_numpy(), epochs if len(rows) >= 1000 else 4 * epochs)
    known = sorted({x for x in rows["lang"] if x})
    guess = Guess(known, Guess.counts(rows["text"].tolist(), rows["lang"].tolist(), known))
    return _model(net, guess, _histogram(net, guess, aside["text"].tolist(), aside["toxic"].to_numpy()))


def _tidied(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows in an order that no partition changes, null languages as None."""
    pdf = pdf.sort_values(["doc_id", "text"], key=lambda c: c.map(lambda x: xxhash.xxh64_intdigest(str(x))))
    return pdf.assign(lang=pdf["lang"].astype(object).where(pdf["lang"].notna(), None))


def _goes_on(state: Broadcast, known: list[str], share: float, few: bool, rate: float):
    """A shard's rows -> blocks of what it moved: embeddings with the number of shards that have them, other weights, words of languages."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _tidied(pdf)
        use, _ = _parts(pdf, few)
        net = copy.deepcopy(state.value)
        embed, dense = net.embed.copy(), net.dense()
        net.fit(use["text"].tolist(), use["toxic"].to_numpy(), 1, rate=rate, share=share)
        moved = net.embed - embed
        had = (moved != 0).any(axis=1)
        whole = lambda x: np.rint(x * UNIT).astype(np.int64)
        rest = [whole(net.dense() - dense), np.array([len(use) > 0]), Guess.counts(pdf["text"].tolist(), pdf["lang"].tolist(), known).ravel()]
        flat = np.concatenate([whole(moved).ravel(), had, *rest]).astype(np.int32)
        blocks = [(k, flat[at : at + BLOCK]) for k, at in enumerate(range(0, len(flat), BLOCK))]
        return pd.DataFrame([(k, b.tobytes()) for k, b in blocks if b.any()], columns=["block", "data"])

    return fold


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        for block, data in zip(pdf["block"], pdf["data"], strict=True):
            values = np.frombuffer(data, dtype=np.int32).astype(np.int64)
            sums[block] = sums[block] + values if block in sums else values
    yield pd.DataFrame([(k, v.tobytes()) for k, v in sums.items()], columns=["block", "data"])


def _calibrates(state: Broadcast, few: bool):
    """A shard's rows -> its histogram; products of matrices differ in their last bits with the rows of a batch, and a shard's are always the same."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        net, guess = state.value
        _, aside = _parts(_tidied(pdf), few)
        return _histogram(net, guess, aside["text"].tolist(), aside["toxic"].to_numpy())

    return fold


def _all_rows(start: Model, rows: DataFrame, shard_rows: int, few: bool, rate: float = 0.002) -> Model:
    """The start after every labelled row."""
    spark = rows.sparkSession
    held = materialize(rows, "labelled")
    count, share = held.agg(F.count("*"), F.avg("toxic")).first()
    if not count:
        return start
    known = sorted(r["lang"] for r in held.select("lang").distinct().collect() if r["lang"])
    shards = max(1, math.ceil(count / shard_rows))
    state = spark.sparkContext.broadcast(start.net)
    dealt = held.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)))
    moved = dealt.groupBy("shard").applyInPandas(_goes_on(state, known, share, few, rate), "block long, data binary")
    found = moved.repartition("block").mapInPandas(tidy(_summed), "block long, data binary").toPandas()
    dense, embeds = start.net.dense(), start.net.embed.size
    flat = np.zeros(embeds + BUCKETS + len(dense) + 1 + (1 << 15) * max(len(known), 1), dtype=np.int64)
    for block, data in zip(found["block"], found["data"], strict=True):
        values = np.frombuffer(data, dtype=np.int64)
        flat[block * BLOCK : block * BLOCK + len(values)] = values
    sums, had, step, fitted, words = np.split(flat, np.cumsum([embeds, BUCKETS, len(dense), 1]))
    net = copy.deepcopy(start.net)
    net.embed += (sums.reshape(BUCKETS, DIM) / UNIT / np.maximum(had, 1)[:, None]).astype(np.float32)
    net.set_dense(dense + step / UNIT / max(fitted[0], 1))
    guess = Guess(known, words.reshape(1 << 15, -1))
    both = spark.sparkContext.broadcast((net, guess))
    aside = dealt if few else dealt.where("aside")
    seen = aside.groupBy("shard").applyInPandas(_calibrates(both, few), "lang long, at long, n long, toxic long").groupBy("lang", "at").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toPandas()
    release(held)
    return _model(net, guess, seen)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, folds: int = 5, shard_rows: int = 4000, broadcast_rows: int = 1_000_000) -> Model | None:
    """A model from all labelled rows whose id is not held out; up to per_class of either label, the start is the model."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(id_hash(F.col("doc_id")), F.lit(folds)) != 0)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    few = sum(sizes.values()) < 200
    known = known.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 4)
    rows = lambda ids: texts(docs, "lang").join(ids, "doc_id").select("doc_id", "text", "lang", "aside", (F.col("toxic") > 0).cast("double").alias("toxic"))
    chance = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(min(1.0, per_class / n))) for k, n in sizes.items()])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < chance * (1 << 30))
    # at most about 2 * per_class pairs of id and label
    start = fit(_tidied(rows(F.broadcast(drawn)).toPandas()), few)
    if max(sizes.values()) <= per_class:
        return start
    return _all_rows(start, rows(small(known, sum(sizes.values()), broadcast_rows)), shard_rows, few)


def _score(state: Broadcast):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = state.value
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                score = model.score(part["text"].tolist()) if model else np.zeros(len(part))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return tidy(fold)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, **parameters) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from one half upwards)."""
    rows = texts(docs).withColumn("held_out", F.pmod(id_hash(F.col("doc_id")), F.lit(folds)) == 0)
    state = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, **parameters))
    return rows.mapInPandas(_score(state), "doc_id long, held_out boolean, score double, predicted int")
