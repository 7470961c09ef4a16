"""Bigram language model held in a log-frequency Bloom filter.

Every n-gram's training count is quantised on a logarithmic scale, and the n-gram enters the filter once for each level
up to its own; a look-up probes level after level and stops at the first absent one, so the count comes from repeated
membership probes. All unigrams and bigrams of the training rows enter, also those seen once, so the filter grows with
the corpus. What grows is not broadcast: the filter is cut into shards by the n-gram's hash, each about as large as any
other, and look-ups travel to the shard that can answer them.

1. A scan cuts the texts into chunks of at most `chunk` tokens and writes them as token numbers with the chunk's own
   dictionary of hashes.
2. Every chunk sends each shard its distinct n-grams that hash there, packed, with their training counts, so a frequent
   n-gram brings one entry from each chunk. The shard adds the counts up, fills its part of the filter, and answers each
   chunk by probing: a level for each n-gram, and for unigrams, which the base score needs, the exact count too.
3. The answers meet their chunk, and every text gets its sums.

    P(w | v) = (q(v w) + mu * P(w)) / (q(v) + mu),   P(w) = (q(w) + 0.1) / (N + 0.1 * (V + 1))

q is what a level stands for: the mean training count of the n-grams of that level, so the sum over all of them is right.
mu is the weight at which the share given to bigrams never seen is that of the bigrams seen once (Good and Turing).

Defined results: null text is the empty text, one end token; words longer than any limit are words like others; a null
doc_id hashes as the empty text (remainder 0, held out); repeated rows are scored each; without training rows all
tokens are unknown; an empty table gives an empty result; other columns are not read. Tokens are told apart by XXH64,
bigrams within a shard by 32 more bits, which mistakes fewer of them than the filter does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import id_hash, texts, tidy
from sonde.plans.lineage import materialize

START, END = np.uint64(0x5EED), np.uint64(0xE2D)
MULT = np.uint64(0x9E3779B97F4A7C15)
ALPHA = 0.1
CHUNK = "chunk long, row array<long>, doc_id array<long>, held_out array<boolean>, size array<int>, prev binary, words binary, at binary"
ROUTED = "shard int, chunk long, uni binary, uni_n binary, bi binary, bi_n binary"
ANSWER = "shard int, chunk long, uni_level binary, uni_n binary, bi_level binary, stats array<struct<kind:int,level:int,keys:long,n:long>>"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def bigram_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * MULT + (right ^ (right >> np.uint64(32))) + np.uint64(0xB16))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers by planes: all low bytes first, then the next ones; planes of zeros compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, len(raw) // width).T).view(kind).ravel()


class Words(dict):
    """UTF-8 words -> 64-bit hashes, remembering about `most` words."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def tokens(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of a text, A-Z folded, then the end token."""
        words = raw.lower().split()
        if len(self) > self.most:
            self.clear()
        out = np.empty(len(words) + 1, dtype=np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        out[-1] = END
        return out


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base(count))."""
    return (1 + np.floor(np.log(counts) / np.log(base) + 1e-9)).astype(np.int64)


class Filter:
    """A shard of the log-frequency Bloom filter: `per_entry` bits and `probes` of them set for each level of each key."""

    def __init__(self, bits: np.ndarray, probes: int) -> None:
        self.bits, self.probes = bits, probes

    @staticmethod
    def _start(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        first = mix(keys + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))
        return first, mix(first ^ MULT) | np.uint64(1)

    @staticmethod
    def _position(first: np.ndarray, step: np.ndarray, k: int, size: int) -> np.ndarray:
        return ((((first + np.uint64(k) * step) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, top: np.ndarray, per_entry: int, probes: int) -> Filter:
        flags = np.zeros(max(64, -(-per_entry * int(top.sum()) // 8) * 8), dtype=bool)
        at = 1
        while len(keys):
            first, step = cls._start(keys, at)
            for k in range(probes):
                flags[cls._position(first, step, k, len(flags))] = True
            keys, top = keys[top > at], top[top > at]
            at += 1
        return cls(np.packbits(flags, bitorder="little"), probes)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key, 0 if absent."""
        found, live, at = np.zeros(len(keys), dtype=np.uint8), np.arange(len(keys)), 1
        while len(live) and at < 256:
            first, step = self._start(keys[live], at)
            for k in range(self.probes):
                pos = self._position(first, step, k, 8 * len(self.bits))
                hit = (self.bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1
                live, first, step = live[hit], first[hit], step[hit]
            found[live] = at
            at += 1
        return found


class Chunk:
    """Texts, or parts of long ones, as numbers into the chunk's dictionary of token hashes, which ascends."""

    def __init__(self, words: np.ndarray, at: np.ndarray, prev: np.ndarray, size: np.ndarray) -> None:
        self.words, self.at, self.size = words, at, size
        self.first = np.cumsum(size) - size
        self.left = np.empty_like(at)
        self.left[1:] = at[:-1]
        self.left[self.first] = prev

    @staticmethod
    def read(row) -> Chunk:
        return Chunk(np.frombuffer(row.words, dtype="<u8"), unpacked(row.at, "<u4"), unpacked(row.prev, "<u4"), np.asarray(row.size, dtype=np.int64))

    def bigrams(self) -> np.ndarray:
        return bigram_keys(self.words[self.left], self.words[self.at])


def _chunks(most: int):
    def write(held: list[tuple]) -> pd.DataFrame:
        row, doc_id, out, prev, hashes = zip(*held, strict=True)
        words, at = np.unique(np.concatenate([np.array(prev, dtype=np.uint64), *hashes]), return_inverse=True)
        at = at.astype("<u4")
        cut = len(held)
        one = {"row": [list(row)], "doc_id": [[None if pd.isna(i) else int(i) for i in doc_id]], "held_out": [list(out)], "size": [[len(h) for h in hashes]]}
        return pd.DataFrame({"chunk": [0], **one, "prev": [packed(at[:cut])], "words": [words.astype("<u8").tobytes()], "at": [packed(at[cut:])]})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, held, size = Words(), [], 0
        for pdf in batches:
            for row, doc_id, out, text in zip(pdf["row"].tolist(), pdf["doc_id"].astype("Int64"), pdf["held_out"].tolist(), pdf["text"], strict=True):
                hashes, prev = words.tokens(text.encode()), START
                for i in range(0, len(hashes), most):
                    part = hashes[i : i + most]
                    if held and size + len(part) > most:
                        yield write(held)
                        held, size = [], 0
                    held.append((row, doc_id, out, prev, part))
                    size, prev = size + len(part), part[-1]
        if held:
            yield write(held)

    return tidy(fold)


def _route(bits: int):
    """Chunks -> for each shard, the top `bits` of a hash, the chunk's distinct n-grams and their training counts."""
    cuts = (np.arange(1, 1 << bits, dtype=np.uint64)) << np.uint64(64 - bits)

    def slices(keys: np.ndarray) -> list[slice]:
        at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
        return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                chunk = Chunk.read(row)
                learn = np.repeat(~np.asarray(row.held_out, dtype=bool), chunk.size)
                uni_n = np.bincount(chunk.at[learn], minlength=len(chunk.words)).astype("<u4")
                # what stands before first tokens is a context, counted as one
                starts = learn[chunk.first] & (chunk.words[chunk.left[chunk.first]] == START)
                uni_n[chunk.words == START] += np.uint32(starts.sum())
                keys, at = np.unique(chunk.bigrams(), return_inverse=True)
                bi_n = np.bincount(at[learn], minlength=len(keys)).astype("<u4")
                del at, learn
                low = ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
                # shards that hold nothing of a chunk get no row, so the rows are no more than the chunk's n-grams
                out = [
                    (s, row.chunk, chunk.words[u].tobytes(), packed(uni_n[u]), low[b].tobytes(), packed(bi_n[b]))
                    for s, (u, b) in enumerate(zip(slices(chunk.words), slices(keys), strict=True))
                    if u.start < u.stop or b.start < b.stop
                ]
                yield pd.DataFrame(out, columns=["shard", "chunk", "uni", "uni_n", "bi", "bi_n"])

    return tidy(fold)


def _summed(rows: list, name: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, summed counts, place of each row's keys among them)."""
    keys, at = np.unique(np.concatenate([np.frombuffer(getattr(r, name), dtype=kind) for r in rows]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([unpacked(getattr(r, f"{name}_n"), "<u4") for r in rows]), minlength=len(keys))
    return keys, n.astype("<u8"), at


def _stats(kind: int, n: np.ndarray, top: np.ndarray) -> list[dict]:
    keys, total = np.bincount(top), np.bincount(top, weights=n)
    return [{"kind": kind, "level": int(x), "keys": int(keys[x]), "n": int(total[x])} for x in np.flatnonzero(keys)]


def _shard(rows: list, base: float, per_entry: int, probes: int) -> pd.DataFrame:
    """One shard: the statistics of its part of the filter, in a row without chunk, and the answers to all chunks; the part itself is done with then."""
    uni, uni_n, uni_at = _summed(rows, "uni", "<u8")
    bi, bi_n, bi_at = _summed(rows, "bi", "<u4")
    own, two = mix(uni), mix(bi.astype(np.uint64) + np.uint64(0xB1C0DE << 32))
    top = [levels(n[n > 0], base) if (n > 0).any() else np.zeros(0, np.int64) for n in (uni_n, bi_n)]
    filt = Filter.of(np.concatenate([own[uni_n > 0], two[bi_n > 0]]), np.concatenate(top), per_entry, probes)
    plain = uni[uni_n > 0] != START
    stats = _stats(0, uni_n[uni_n > 0][plain], top[0][plain]) + _stats(1, bi_n[bi_n > 0], top[1])
    uni_level, bi_level = filt.level(own), filt.level(two)
    u = np.cumsum([0] + [len(r.uni) // 8 for r in rows])
    b = np.cumsum([0] + [len(r.bi) // 4 for r in rows])
    out = [(rows[0].shard, -1, None, None, None, stats)]
    for i, r in enumerate(rows):
        a, c = uni_at[u[i] : u[i + 1]], bi_at[b[i] : b[i + 1]]
        out.append((r.shard, r.chunk, uni_level[a].tobytes(), packed(uni_n[a]), bi_level[c].tobytes(), None))
    return pd.DataFrame(out, columns=["shard", "chunk", "uni_level", "uni_n", "bi_level", "stats"])


def _shards(base: float, per_entry: int, probes: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if held and held[0].shard != row.shard:
                    yield _shard(held, base, per_entry, probes)
                    held = []
                held.append(row)
        if held:
            yield _shard(held, base, per_entry, probes)

    return tidy(fold)


class Model:
    """What all shards have in common: a few numbers for each level."""

    def __init__(self, stats: list[tuple[int, int, int, int]]) -> None:
        self.means = np.zeros((2, 256))
        for kind, level, keys, n in stats:
            self.means[kind, level] = n / keys
        uni = [(keys, n) for kind, _, keys, n in stats if kind == 0]
        self.distinct, self.total = sum(k for k, _ in uni), sum(n for _, n in uni)
        once = sum(n for kind, level, _, n in stats if kind == 1 and level == 1)
        self.mu = self._weight(uni, min(once, 0.999 * self.total))

    @staticmethod
    def _weight(uni: list[tuple[int, int]], once: float) -> float:
        """mu such that the back-off's share over all tokens' contexts is `once`."""
        low, high = 1e-3, 1e12
        for _ in range(100):
            mu = (low * high) ** 0.5
            share = sum(n * mu / (n / keys + mu) for keys, n in uni)
            low, high = (mu, high) if share < once else (low, mu)
        return (low * high) ** 0.5

    def score(self, both: np.ndarray, context: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 P of tokens, given the levels of the bigram, its first word and the token."""
        p = (self.means[0][own] + ALPHA) / (self.total + ALPHA * (self.distinct + 1))
        q = self.means[0][context]
        return np.log10((np.minimum(self.means[1][both], q) + self.mu * p) / (q + self.mu))


def _score(lm: Model):
    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right = right.sort_values("shard")
        for row in left.itertuples(index=False):
            chunk = Chunk.read(row)
            n = np.concatenate([unpacked(x, "<u8") for x in right["uni_n"]])
            own = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in right["uni_level"]])
            both = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in right["bi_level"]])
            keys, at = np.unique(chunk.bigrams(), return_inverse=True)
            if len(keys) != len(both) or len(n) != len(chunk.words):
                raise ValueError("a chunk and its answers do not agree")
            score = lm.score(both[at], own[chunk.left], own[chunk.at])
            base = np.log10((n + ALPHA) / (lm.total + ALPHA * (lm.distinct + 1)))[chunk.at]
            known = (n > 0)[chunk.at]
            made = {"row": row.row, "doc_id": pd.array(row.doc_id, dtype="Int64"), "held_out": row.held_out, "n_tokens": chunk.size}
            made["n_known"] = np.add.reduceat(known, chunk.first, dtype=np.int64)
            out.append(pd.DataFrame(made | {"base_score": np.add.reduceat(base, chunk.first), "score": np.add.reduceat(score, chunk.first)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in SCORED.split(", ")])

    return fold


def score(docs: DataFrame, folds: int = 10, base: float = 2**0.5, per_entry: int = 12, probes: int = 6, chunk: int = 1 << 20, shard_tokens: int = 1 << 20, most_tasks: int = 1 << 15) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Rows whose id hashes to a remainder of 0 modulo `folds` are held out. per_entry and probes: bits of the filter and bits
    set for each level of an n-gram. chunk and shard_tokens bound what a task holds; most_tasks bounds the tasks of the shards.
    """
    rows = texts(docs).select(
        "doc_id", "text", (F.pmod(id_hash(F.col("doc_id")), F.lit(folds)) == 0).alias("held_out"), F.monotonically_increasing_id().alias("row")
    )
    chunks = rows.mapInPandas(_chunks(chunk), CHUNK).withColumn("chunk", F.monotonically_increasing_id())
    chunks = materialize(chunks, "chunks")
    tokens = chunks.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(1, (int(tokens) // shard_tokens).bit_length())
    # a task does shard after shard, so there may be more shards than tasks that a driver can keep track of
    routed = chunks.mapInPandas(_route(bits), ROUTED).repartition(min(1 << bits, most_tasks), "shard").sortWithinPartitions("shard")
    answers = materialize(routed.mapInPandas(_shards(base, per_entry, probes), ANSWER), "shards")
    each = answers.where("chunk < 0").select(F.explode("stats").alias("s")).groupBy("s.kind", "s.level").agg(F.sum("s.keys"), F.sum("s.n"))
    lm = Model([tuple(r) for r in each.collect()])
    asked = answers.where("chunk >= 0").select("shard", "chunk", "uni_level", "uni_n", "bi_level")
    scored = chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInPandas(_score(lm), SCORED)
    return (
        scored.groupBy("row", "doc_id", "held_out")
        .agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lm.total).cast("long").alias("train_tokens"), "base_score", "score")
    )
