"""SimHash near-dedup through a Gray-order hierarchical index.

Fingerprints within `most` differing bits agree on at least one of most+1 blocks of bits, so each distinct
fingerprint goes to most+1 buckets, one for each block value, and every link is found in some bucket; a bucket with
too many fingerprints is dealt out again by blocks of the bits left, by the same argument. In a bucket the fingerprints are
sorted by Gray rank, which puts those that share bit patterns side by side. Each level of the index joins runs of
neighbours into one node that holds the bits they share, as a mask and a pattern. A self-join goes down from the top
with pairs of nodes: shared bits that differ are a lower bound for all pairs below, so whole groups are dropped; shared
bits that agree give an upper bound, so whole groups are linked without looking at their pairs. A bucket reports a
spanning forest of its links, at most one link less than it has fingerprints, which keeps connected components whole.

Defined results: null or wordless text has fingerprint zero, linked like any other; text of fewer words than a
shingle is one shingle; repeated rows and equal fingerprints are one class; a null doc_id takes part with the largest
possible id and is returned as null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import one_of_each, small, texts, tidy
from sonde.plans.components import components
from sonde.plans.lineage import materialize, packed, release

BITS = 64
CELLS = 512
NO_ID = 2**63 - 1


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 hashes (seed 42) of all word shingles of UTF-8 text, repeats included; fewer words are one shingle."""
    words, digest = raw.split(), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    joined = b" ".join(words)
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(raw: bytes, width: int) -> int:
    return majority(shingle_hashes(raw, width))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t.encode().lower(), width) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    return texts(docs).mapInPandas(tidy(fold), "doc_id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the Gray code's order: the prefix parity of its bits from the top."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Union-find that remembers the links which joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _levels(fps: np.ndarray, fan: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the leaves up: (mask of shared bits, pattern on them) of each node."""
    mask, pattern = np.full_like(fps, ~np.uint64(0)), fps
    levels = [(mask, pattern)]
    while len(mask) > fan:
        at = np.arange(0, len(mask), fan)
        ones = np.bitwise_and.reduceat(mask & pattern, at)
        zeros = np.bitwise_and.reduceat(mask & ~pattern, at)
        mask, pattern = ones | zeros, ones
        levels.append((mask, pattern))
    return levels


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def _pivots(fps: np.ndarray, most: int, forest: Forest, pivots: int) -> np.ndarray:
    """Link what lies around a few pivots; a label for each fingerprint: its tree, or a number of its own."""
    if len(fps) > 8 * pivots:
        for p in np.linspace(0, len(fps) - 1, pivots).astype(int).tolist():
            for x in np.flatnonzero(_bits(fps ^ fps[p]) <= most).tolist():
                forest.link(p, x)
    return np.array([forest.root(x) for x in range(len(fps))], dtype=np.int64)


def links(fps: np.ndarray, most: int, fan: int = 8, block: int = 1 << 17, pivots: int = 8) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the graph that links distinct fingerprints at `most` or fewer differing bits.

    fps: one row per fingerprint, one column per 64 bits. Pairs that the pivots have connected already are not compared.
    """
    order = np.lexsort([gray_rank(fps[:, k]) for k in reversed(range(fps.shape[1]))])
    fps = fps[order]
    levels, forest = _levels(fps, fan), Forest(len(fps))
    label = _pivots(fps, most, forest, pivots)
    labels = [(label, label)]
    while len(labels) < len(levels):
        at = np.arange(0, len(labels[-1][0]), fan)
        labels.append((np.minimum.reduceat(labels[-1][0], at), np.maximum.reduceat(labels[-1][1], at)))
    first, second = np.triu_indices(len(levels[-1][0]))
    stack = [(len(levels) - 1, first, second)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > block:  # bounded memory: later blocks wait on the stack
            stack += [(level, a[i : i + block], b[i : i + block]) for i in range(0, len(a), block)]
            continue
        mask, pattern = levels[level]
        lowest, highest = labels[level]
        joined = (lowest[a] == highest[a]) & (lowest[b] == highest[b]) & (lowest[a] == lowest[b])
        a, b = a[~joined], b[~joined]
        shared = mask[a] & mask[b]
        differing = _bits((pattern[a] ^ pattern[b]) & shared)
        near = differing <= most
        a, b, differing, shared = a[near], b[near], differing[near], shared[near]
        if level == 0:
            for x, y in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True):
                forest.link(x, y)
            continue
        size = fan**level
        whole = differing + (BITS * fps.shape[1] - _bits(shared)) <= most
        for x, y in zip(a[whole].tolist(), b[whole].tolist(), strict=True):
            for start in (x, y):
                for leaf in range(start * size, min((start + 1) * size, len(fps))):
                    forest.link(x * size, leaf)
        a, b = a[~whole], b[~whole]
        if not len(a):
            continue
        below = len(levels[level - 1][0])
        i, j = np.divmod(np.arange(fan * fan), fan)
        left, right = (a[:, None] * fan + i).ravel(), (b[:, None] * fan + j).ravel()
        keep = (left <= right) & (left < below) & (right < below)
        stack.append((level - 1, left[keep], right[keep]))
    return [(int(order[x]), int(order[y])) for x, y in forest.links]


def _masks(settled: int, most: int) -> list[int]:
    """The bits of `settled` with each of most+1 parts of the other bits, as signed longs."""
    free = [b for b in range(BITS) if not settled >> b & 1]
    edges = [len(free) * i // (most + 1) for i in range(most + 2)]
    masks = [settled % 2**BITS | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - 2**BITS if m >> (BITS - 1) else m for m in masks]


def _buckets(classes: DataFrame, most: int, hot: int, splits: int = 2, broadcast_rows: int = 200_000) -> DataFrame:
    """(fp, bucket): each fingerprint once for each block of bits, a bucket being the fingerprints with the same block value.

    Fingerprints of one bucket within `most` differing bits agree on one of most+1 parts of the bits left, so a bucket of
    more than `hot` is dealt out by these, and again by what is left then. A bucket still too large after `splits` such
    steps is cut by hash into parts of about hot / 2, and each two parts are a bucket, which covers all pairs.
    """
    masks, out = _masks(0, most), []
    rows = classes.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    for step in range(splits + 1):
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        large = materialize(rows.groupBy("mask", "value").agg(F.count("*").alias("size")).where(F.col("size") > hot), "large")
        count = large.count()
        bucket = F.concat_ws(":", "mask", "value")
        if not count:
            out.append(rows.select("fp", bucket.alias("bucket")))
            break
        marked = rows.join(small(large, count, broadcast_rows), ["mask", "value"], "left")
        out.append(marked.where("size is null").select("fp", bucket.alias("bucket")))
        again = marked.where("size is not null")
        if step < splits:
            children = {m: _masks(m, most) for m in masks}
            masks = [c for m in children.values() for c in m]
            parts = classes.sparkSession.createDataFrame([(m, c) for m, v in children.items() for c in v], "mask long, child long")
            rows = materialize(again.join(F.broadcast(parts), "mask").select("fp", F.col("child").alias("mask")), "again")
        else:
            parts = F.ceil(2 * F.col("size") / max(hot, 2)).cast("int")
            cut = again.withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            out.append(cut.select("fp", F.concat_ws(":", bucket, F.least("own", "other"), F.greatest("own", "other")).alias("bucket")))
    return functools.reduce(DataFrame.unionAll, out)


def _join_buckets(most: int, words: int):
    """Rows (bucket, fp) sorted by bucket -> links; fp holds the fingerprint's bytes."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        last = None

        def found() -> list[tuple[bytes, bytes]]:
            own = sorted(set(held))
            if len(own) < 2:
                return []
            fps = np.frombuffer(b"".join(own), dtype="<u8").reshape(-1, words)
            return [(own[x], own[y]) for x, y in links(fps, most)]

        for pdf in batches:
            out = []
            for key, fp in zip(pdf["bucket"].tolist(), pdf["fp"].tolist(), strict=True):
                if key != last:
                    out += found()
                    held, last = [], key
                held.append(fp)
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(found(), columns=["a", "b"])

    return tidy(fold)


def near_pairs(classes: DataFrame, most: int, hot: int = 20_000) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep every connected component whole."""
    dealt = _buckets(classes, most, hot).select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    joined = dealt.select("bucket", F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp")).mapInPandas(_join_buckets(most, 1), "a binary, b binary")
    return joined.select(*[F.conv(F.hex(c), 16, -10).cast("long").alias(c) for c in ("a", "b")])


def near_dedup(docs: DataFrame, width: int = 4, most: int = 4, hot: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links, itself included)."""
    rows = materialize(fingerprints(docs, width), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least")), "classes")
    linked = components(near_pairs(classes, most, hot))
    named = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(least, "component").select("fp", "component_id")
    return rows.join(found, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"),
    )


def _hashes(part: pd.DataFrame, width: int) -> list[np.ndarray]:
    return [shingle_hashes(t.encode().lower(), width) for t in part["text"]]


def _often(width: int, chunk: int = 1 << 20):
    """Texts -> (token, often): shingles met more than once among about `chunk` distinct ones of some texts."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"token": token[n > 1].view(np.int64), "often": n[n > 1]})

        for pdf in batches:
            for at in range(0, len(pdf), 200):
                held += [np.unique(h) for h in _hashes(pdf.iloc[at : at + 200], width)]
                size = sum(map(len, held))
                if size > chunk:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return tidy(fold)


def _prefixes(width: int, common: np.ndarray, rank: np.ndarray, share: tuple[int, int]):
    """Texts -> key (of the set of shingles), fp (its SimHash), n (distinct shingles), prefix, the first of them, and cells.

    cells: how many shingles have each value of some bits; what two sets share in a cell is at most the lesser number.

    Sets alike by num/den or more share one of their first n - ceil(n * num / den) + 1 shingles, whatever the order, and two
    when one more is taken, as it is here; the common ones (sorted, ranked) stand last.
    """
    num, den = share

    def prefix(held: np.ndarray) -> np.ndarray:
        n, first = len(held), len(held) - -(-len(held) * num // den) + 2
        if not n:
            return held
        where = np.minimum(np.searchsorted(common, held), max(len(common) - 1, 0))
        late = np.where(common[where] == held, rank[where], 0) if len(common) else np.zeros(n, np.int64)
        return held[np.lexsort((held, late))[:first]]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                hashes = _hashes(part, width)
                sets = [np.unique(h) for h in hashes]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                        "th": part["th"].to_numpy(),
                        "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                        "fp": np.array([majority(h) for h in hashes], dtype=np.uint64).view(np.int64),
                        "n": [len(s) for s in sets],
                        "prefix": [prefix(s.view(np.int64)) for s in sets],
                        "cells": [np.minimum(np.bincount((s >> np.uint64(20) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 32767).astype(np.int16) for s in sets],
                    }
                )

    return tidy(fold)


def _shingles(width: int):
    """Texts with their node -> node, shingles: the distinct hashes in ascending order."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "shingles": [np.unique(h).view(np.int64) for h in _hashes(part, width)]})

    return tidy(fold)


def _alike(pairs: DataFrame, source: DataFrame, firsts: DataFrame, width: int, share: tuple[int, int], broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of num/den or more.

    A bound by the cells' numbers rules most out; the texts of the others give their whole sets again, which are compared in full.
    """
    num, den = share
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "candidates")
    count = pairs.count()
    pairs = packed(pairs, count)

    def sided(sets: DataFrame, value: str, pairs: DataFrame, count: int) -> DataFrame:
        """pairs with the value of either side, as s and t."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = sets.join(small(nodes, 2 * count, broadcast_rows), "node", "left_semi")
        one = sets.select(F.col("node").alias("a"), F.col(value).alias("s")).join(small(pairs, count, broadcast_rows), "a")
        return one.join(sets.select(F.col("node").alias("b"), F.col(value).alias("t")), "b")

    many = F.lit(10_000_000)  # a cell's number is cut at 32,767
    bound = F.aggregate(F.zip_with("s.cells", "t.cells", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda a, x: a + x)
    may = ((num + den) * bound >= num * (F.col("s.n") + F.col("t.n"))) | (F.greatest("s.n", "t.n") > many)
    likely = materialize(sided(firsts.select("node", F.struct("n", "cells").alias("v")), "v", pairs, count).where(may).select("a", "b"), "likely")
    count = likely.count()
    likely = packed(likely, count)
    nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(firsts.select("node", F.col("doc_id").alias("id"), F.col("th").alias("h")).join(nodes, "node", "left_semi"), "wanted")
    rows = wanted.count()
    texts_ = source.join(small(wanted, rows, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).select("node", "text")
    sets = materialize(texts_.mapInPandas(_shingles(width), "node long, shingles array<long>"), "sets")
    if sets.count() > rows:  # rows with equal id and text all give the set of their one node
        whole, sets = sets, materialize(sets.dropDuplicates(["node"]), "sets")
        release(whole)
    overlap = F.size(F.array_intersect("s", "t"))
    full = sided(sets, "shingles", likely, count)
    found = materialize(full.where((num + den) * overlap >= num * (F.size("s") + F.size("t"))).select("a", "b"), "alike")
    release(pairs, likely, wanted, sets)
    return found


def _may_link(x: str, y: str, share: tuple[int, int]) -> Column:
    """Whether sets that first meet in this token, at their places, can still overlap enough."""
    num, den = share
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return (num + den) * left >= num * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def similar_pairs(
    source: DataFrame, firsts: DataFrame, width: int, share: tuple[int, int], broadcast_rows: int = 200_000, hot: int = 20, turns: int = 6, most: int = 1000
) -> DataFrame:
    """(a, b): links between the nodes of firsts (node, doc_id, th, fp, n, prefix, cells) that keep every component of similar sets whole.

    Candidates are named by the SimHash index and by an inverted index of set prefixes, which misses no similar pair;
    each is verified by its whole sets, which the texts of source (doc_id, th, text) give again. Where the sets that share a token are more than `hot` on average, by rows, they are
    first compared with pivots, for `turns` turns at most; then whatever still lies in different components is compared in full,
    sets of a token that more than `most` of them hold only where they share a second one, which costs no pair (`_second`).
    """
    num, den = share
    first = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * num / den)  # the prefix without the shingle more
    prefixes = firsts.select("node", "n", F.posexplode("prefix").alias("pos", "token")).where(first)
    shared = prefixes.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    members = materialize(prefixes.join(shared.select("token"), "token"), "members")
    rows = members.count()
    members = packed(members, rows)

    wanted = packed(materialize(firsts.select("node", "fp").join(members.select("node").distinct(), "node", "left_semi"), "named"), rows)
    alike = functools.partial(_alike, source=source, firsts=firsts, width=width, share=share, broadcast_rows=broadcast_rows)

    # the SimHash index; sets without a common token cannot be alike
    least = wanted.groupBy("fp").agg(F.min("node").alias("a"))
    equal = wanted.select("fp", F.col("node").alias("b")).join(least, "fp").select("a", "b")
    near = near_pairs(least.select("fp"), 4)
    ends = [least.select(F.col("fp").alias(f"f{c}"), F.col("a").alias(c)) for c in ("x", "y")]
    near = near.join(ends[0], near["a"] == ends[0]["fx"]).join(ends[1], near["b"] == ends[1]["fy"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = alike(equal.unionAll(near))

    live = _unsettled(members, rows, found)
    for turn in range(turns):
        # a large group of near copies would give a pair for any two of them; compared with a few pivots, it becomes one component
        named, pairs = live.groupBy("token").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.expr("m * m")), F.lit(0))).first()
        if pairs <= hot * named:
            break
        pivot = F.min_by(F.struct("node", "n", "pos", "component"), F.xxhash64("component", "node", F.lit(turn))).alias("p")
        y = live.groupBy("token").agg(pivot).select("token", "p.*").alias("y")
        star = live.alias("x").join(y, "token").where(F.col("x.component") != F.col("y.component")).where(_may_link("x", "y", share))
        more = alike(star.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        less, found = found, materialize(found.unionAll(more), "found")
        release(less, more, live)
        live = _unsettled(members, rows, found)
    many = materialize(live.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > most).select("token"), "shared-by-many")
    pairs = _across(live.join(many, "token", "left_anti"), ["token"], share)
    if not many.isEmpty():
        second = _second(live.join(many, "token", "left_semi"), firsts)
        pairs = pairs.unionAll(_across(second, ["token", "second"], share))
    last = alike(pairs)
    release(members, wanted, live, many)
    return found.unionAll(last)


def _across(held: DataFrame, keys: list[str], share: tuple[int, int]) -> DataFrame:
    """(a, b): sets of different components with equal keys, where they can still overlap enough."""
    x, y = held.alias("x"), held.alias("y")
    pairs = x.join(y, keys).where(F.col("x.component") < F.col("y.component")).where(_may_link("x", "y", share))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _second(live: DataFrame, firsts: DataFrame) -> DataFrame:
    """live with each later token of the set's prefix as second, for keys that more than one component has.

    Similar sets share two tokens of their prefixes with one more; of these the first stands in both prefixes, and the next
    after it in both. Sets of one shingle have no second: they are alike only if equal, and equal sets are one node.
    """
    later = live.join(firsts.select("node", "prefix"), "node").withColumn("second", F.explode(F.expr("slice(prefix, pos + 2, size(prefix))"))).drop("prefix")
    later = materialize(later, "second-tokens")
    keys = later.groupBy("token", "second").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", "second")
    return later.join(keys, ["token", "second"])


def _unsettled(members: DataFrame, rows: int, found: DataFrame) -> DataFrame:
    """members, so many rows, with their component over the links found, for tokens that more than one component has."""
    linked = components(found)
    named = members.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = packed(materialize(named.select("token", "node", "n", "pos", "component"), "named"), rows)
    mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    live = packed(materialize(named.join(mixed, "token"), "unsettled"), rows)
    release(linked, named)
    return live


def near_groups(docs: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5), sample: int = 8, common_rows: int = 200_000, broadcast_rows: int = 200_000, **parameters) -> DataFrame:
    """doc_id, th (a hash of the text), component (the row's group of near copies) and the smallest doc_id of the group.

    Texts are linked where the Jaccard similarity of their sets of word shingles is num/den (share) or more; groups are the
    components of these links. Shingles are told apart by XXH64, sets by 128 bits.
    """
    source = texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    # any order of shingles is right; one that has common shingles last, as a sample shows them, names few pairs
    some = source.where(F.pmod(F.xxhash64("th"), F.lit(sample)) == 0).select("text").mapInPandas(_often(width), "token long, often long")
    often = some.groupBy("token").agg(F.sum("often").alias("often")).where("often > 2").orderBy(F.desc("often"), "token").limit(common_rows).toPandas()
    token, rank = often["token"].to_numpy(dtype=np.int64), np.arange(len(often), 0, -1)
    order = np.argsort(token)
    made = source.mapInPandas(_prefixes(width, token[order], rank[order], share), "doc_id long, th long, key binary, fp long, n long, prefix array<long>, cells array<short>")
    rows = materialize(made.withColumn("node", F.monotonically_increasing_id()), "prefixes")
    classes = rows.groupBy("key").agg(F.min("node").alias("first"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"))
    named = materialize(rows.select("doc_id", "th", "key", "node").join(classes, "key").select("doc_id", "th", "node", "first", "least"), "classes")
    repeats = named.where("node <> first").select("node")
    firsts = rows.drop("key").join(small(repeats, repeats.count(), broadcast_rows), "node", "left_anti")
    pairs = similar_pairs(source, firsts, width, share, broadcast_rows=broadcast_rows, **parameters)
    linked = components(pairs).withColumnRenamed("node", "first")
    release(rows)
    grouped = named.join(linked, "first", "left").withColumn("component", F.coalesce("component", "first"))
    least = grouped.groupBy("component").agg(F.min("least").alias("group_least"))
    return grouped.join(least, "component").select("doc_id", "th", "component", F.col("group_least").alias("least"))


def deduplicated(docs: DataFrame, broadcast_rows: int = 200_000, **parameters) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id. Wordless texts are one group.

    Of several texts with that id the one with the smallest hash stays, of repeated rows the least.
    """
    found = near_groups(docs, **parameters).groupBy("component", F.col("doc_id").alias("id"), F.col("th").alias("h")).agg(F.count("*").alias("n"))
    found = materialize(found, "members")
    mine = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    first = found.groupBy("component").agg(F.min(mine).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    marks = found.join(first, "component").withColumn("kept", mine.eqNullSafe(F.col("first"))).where(~F.col("kept") | (F.col("n") > 1))
    return one_of_each(docs, marks, F.xxhash64(F.coalesce(docs["text"], F.lit(""))), broadcast_rows)
