"""Removal of long repeated byte strings by hash-compared suffix sorting.

A byte goes if a `length`-byte string covers it that also starts anywhere else. Anchors cut the work into small sets:
among the hashes of all short grams in a `length`-byte string, the smallest one, leftmost among equals, is the string's
anchor, so equal strings have equal anchors at equal places, and about two of every 350 positions are anchors.

1. A scan finds the anchors, each with its gram's hash and a 128-bit BLAKE2b digest of its surroundings, which are all
   bytes that a string with this anchor can cover; equal digests stand for equal bytes. Anchors that agree in both are one
   class. A class with two anchors or more is settled: all its surroundings go. Copies, however many, are settled here,
   by an aggregation Spark combines early.
2. What is left are anchors with a gram seen elsewhere but surroundings of their own, at the ends of repeats. They fetch
   their surroundings and meet the classes that share their gram. Each set is suffix-sorted: suffixes that start at
   the anchors' left reach, compared up to the bytes every string of a range of starts must hold, fall into runs of
   equals; a run equal over all that the range can cover is settled, its bytes compared, others go on with either half of
   the range.
3. Sets of more than `hot` classes never meet in one task: Spark divides their ranges in the same way, by digests, each
   third being a set of its own for every core it holds, until the sets are small enough to be sorted or the range is one
   start.
4. Every row's spans are merged and cut out.

Strings never cross rows. Defined results: null text is the empty text; rows with equal doc_id and text each count as
a place where their strings start; a null doc_id is a row like others, told from others by its text; texts shorter than
`length` stay whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import small, texts, tidy
from sonde.llm.suffix_sort import Collision, Hashes, same_bytes, suffix_sort
from sonde.plans.lineage import materialize, release

GRAM = 48
#: Bytes of text that are hashed at a time; the arrays of a chunk take about a hundred times as much.
CHUNK = 1 << 19
#: Places or spans that may be broadcast; more are joined by shuffling, as they are for any large corpus.
BROADCAST_ROWS = 20_000
NO_ID = -(2**63)
#: What tells a row from others: its id and two 64-bit hashes of its text.
ROW = ["did", "th", "tk"]
PLACE = "did long, th long, tk long"


def text_keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def digest(raw: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    found = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values."""
    n = len(values)
    blocks = -(-n // width)
    full = np.full(blocks * width, ~np.uint64(0))
    full[:n] = values
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts_: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in the text, gram hash) of all anchors."""
    sizes = np.array([len(t) for t in texts_], dtype=np.int64)
    ends = np.cumsum(sizes)
    buffer = np.frombuffer(b"".join(texts_), dtype=np.uint8)
    n = len(buffer)
    if n < length or not (sizes >= length).any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = Hashes(buffer)
    grams = _mix((h.prefix[gram:] - h.prefix[:-gram]) * h.back[: n - gram + 1])
    bits = np.uint64(max(24, int(n).bit_length()))
    place = np.arange(len(grams), dtype=np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = _sliding_min((grams & ~low) | place, length - gram + 1)
    valid = np.zeros(n + 1, dtype=np.int8)
    long_ = sizes >= length
    np.add.at(valid, (ends - sizes)[long_], 1)
    np.add.at(valid, (ends - length + 1)[long_], -1)
    inside = np.cumsum(valid)[: len(least)] > 0
    flags = np.zeros(n, dtype=bool)
    flags[(least[inside] & low).astype(np.int64)] = True
    at = np.flatnonzero(flags)
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - sizes)[text], grams[at]


def _rows(docs: DataFrame) -> DataFrame:
    rows = texts(docs)
    th, tk = text_keys(rows["text"])
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), th.alias("th"), tk.alias("tk"), "text")


def _find(length: int, gram: int):
    reach = length - gram

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["text"].str.len().to_numpy()
            bounds = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + CHUNK, CHUNK))
            for i, j in zip(bounds, np.append(bounds[1:], len(pdf)), strict=True):
                part = [t.encode() for t in pdf["text"].iloc[i:j]]
                text, pos, key = anchors(part, length, gram)
                # the distance to the left end belongs to the surroundings
                around = [digest(b"%d " % min(p, reach) + part[t][max(0, p - reach) : p + length]) for t, p in zip(text.tolist(), pos.tolist(), strict=True)]
                size_ = np.array([len(r) for r in part], dtype=np.int64)
                yield pd.DataFrame(
                    {c: pdf[c].to_numpy()[i:j][text] for c in ROW}
                    | {
                        "pos": pos,
                        "right": np.minimum(size_[text] - pos, length) if len(text) else pos,
                        "key": key.view(np.int64),
                        "around": np.array([a for a, _ in around], dtype=np.int64),
                        "around2": np.array([b for _, b in around], dtype=np.int64),
                    }
                )

    return tidy(fold)


def resolve(windows: list[bytes], lefts: list[int], sets: np.ndarray, length: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window, in its set, the extent (from, to), relative to its anchor, of the strings it shares; from > to if none.

    first, last: the range of the strings' starts, relative to the anchor, one for each set.
    """
    size = np.array([len(w) for w in windows], dtype=np.int64)
    left = np.array(lefts, dtype=np.int64)
    anchor = np.cumsum(size) - size + left
    h = Hashes(np.frombuffer(b"".join(windows), dtype=np.uint8))
    sets = np.unique(sets, return_inverse=True)[1].astype(np.int64)
    try:
        return _resolve(h, anchor, left, size - left, sets, length, first, last, plain=False)
    except Collision:
        return _resolve(h, anchor, left, size - left, sets, length, first, last, plain=True)


def _resolve(
    h: Hashes, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, sets: np.ndarray, length: int, first: np.ndarray, last: np.ndarray, plain: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of starts (first..last, relative to the anchors) are halved level by level, all sets and ranges of a level at once."""
    n = len(anchor)
    lo, hi = np.full(n, length), np.full(n, -length)
    item, node = np.arange(n), sets
    while len(item):
        # a window takes part if a string that starts within the range can hold the range's core
        fits = (left[item] >= -last) & (right[item] >= first + length)
        order = np.flatnonzero(fits)[np.argsort(node[fits], kind="stable")]
        item, node, first, last = item[order], node[order], first[order], last[order]
        if len(item) < 2:
            break
        order, equal = suffix_sort(h, node, anchor[item] + last, first + length - last, plain)
        item, first, last, node = item[order], first[order], last[order], np.cumsum(~equal)
        many = np.bincount(node)[node] > 1
        item, node, first, last = item[many], node[many], first[many], last[many]
        if not len(item):
            break
        node = np.cumsum(np.diff(node, prepend=node[:1]) != 0)
        # windows equal over all that the range's strings can cover are settled, and one of them goes on for all
        begin, end = np.maximum(first, -left[item]), np.minimum(last + length, right[item])
        whole = h.of(anchor[item] + begin, end - begin)
        order = np.lexsort((whole, end, begin, node))
        item, node, first, last, begin, end, whole = (x[order] for x in (item, node, first, last, begin, end, whole))
        again = np.zeros(len(item), dtype=bool)
        again[1:] = (node[1:] == node[:-1]) & (begin[1:] == begin[:-1]) & (end[1:] == end[:-1]) & (whole[1:] == whole[:-1])
        twin = np.flatnonzero(again)
        if not plain and not same_bytes(h, anchor[item[twin]] + begin[twin], anchor[item[twin - 1]] + begin[twin], end[twin] - begin[twin]).all():
            raise Collision
        settled = again.copy()
        settled[:-1] |= again[1:]
        if plain:  # without trust in hashes only single strings are settled
            settled &= first == last
            again &= settled
        own = item[settled]
        np.minimum.at(lo, own, begin[settled])
        np.maximum.at(hi, own, end[settled])
        item, node, first, last = item[~again], node[~again], first[~again], last[~again]
        more = (np.bincount(node)[node] > 1) & (first < last)
        item, node, first, last = item[more], node[more], first[more], last[more]
        mid = (first + last) // 2
        item, node = np.concatenate([item, item]), np.concatenate([2 * node, 2 * node + 1])
        first, last = np.concatenate([first, mid + 1]), np.concatenate([mid, last])
    return lo, hi


def _meet(length: int, block: int = 2000):
    """Windows sorted by set -> spans. Whole sets are held, at most `hot` windows each, some sets at a time."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def spans(pdf: pd.DataFrame) -> pd.DataFrame:
            sets, first, last = (pdf[c].to_numpy(dtype=np.int64) for c in ("set", "first", "last"))
            lo, hi = resolve(pdf["window"].tolist(), pdf["left"].tolist(), sets, length, first, last)
            hit = (lo < hi) & (pdf["n"].to_numpy() == 1)
            pos = pdf["pos"].to_numpy(dtype=np.int64)
            return pd.DataFrame({c: pdf[c].to_numpy()[hit] for c in ROW} | {"a": (pos + lo)[hit], "b": (pos + hi)[hit]})

        held: list[pd.DataFrame] = []
        for pdf in batches:
            for at in range(0, len(pdf), block):
                held.append(pdf.iloc[at : at + block])
                whole = pd.concat(held)
                open_ = whole["set"] == whole["set"].iloc[-1]
                if not open_.all():
                    yield spans(whole[~open_])
                held = [whole[open_]]
        if held:
            yield spans(pd.concat(held))

    return tidy(fold)


WINDOW = f"key long, n long, hot boolean, {PLACE}, pos int, left int, window binary"


def _fetch(reach: int, length: int):
    """Rows with the places of their candidates -> one row for each candidate with its surroundings."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for did, th, tk, text, places in zip(*(pdf[c] for c in ROW), pdf["text"], pdf["places"], strict=True):
                raw = text.encode()
                for p in places:
                    pos = p["pos"]
                    out.append((p["key"], p["n"], p["hot"], did, th, tk, pos, min(pos, reach), raw[max(0, pos - reach) : pos + length]))
                    if len(out) >= 1000:
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOW.split(", ")])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOW.split(", ")])

    return tidy(fold)


PART = "wid long, n long, first int, last int, core long, core2 long, whole long, whole2 long, begin int, end int"


def _divide(length: int, parts: int = 3):
    """Windows with a range of starts -> for each part of it whose strings fit: its core and all that its strings can cover."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for wid, n, one, two, set_, left, window in zip(*(pdf[c] for c in ("wid", "n", "first", "last", "set", "left", "window")), strict=True):
                right, edges = len(window) - left, [one + (two + 1 - one) * k // parts for k in range(parts + 1)]
                for first, last in ((a, b - 1) for a, b in zip(edges, edges[1:], strict=False) if a < b):
                    if left >= -last and right >= first + length:
                        begin, end = max(first, -left), min(last + length, right)
                        core = digest(b"%d %d " % (set_, first) + window[left + last : left + first + length])
                        out.append((wid, n, first, last, *core, *digest(b"%d " % begin + window[left + begin : left + end]), begin, end))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PART.split(", ")])

    return tidy(fold)


def _hot_spans(windows: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """For windows (wid, key, n, left, window) of large sets: their span (wid, begin, end), and the sets that are small by now.

    The latter are (wid, set, n, first, last); n counts the windows that one stands for. All strings of a window hold its
    anchor, so what they cover is one span.
    """
    spark = windows.sparkSession
    live = windows.select("wid", "n", F.lit(gram - length).alias("first"), F.lit(0).alias("last"), F.col("key").alias("set"))
    spans = spark.createDataFrame([], "wid long, begin int, end int")
    calm = spark.createDataFrame([], "wid long, set long, n long, first int, last int")
    core, whole = ["first", "last", "core", "core2"], ["whole", "whole2", "begin", "end"]
    while True:  # ends, as ranges shrink to single starts
        made = materialize(live.join(windows.select("wid", "left", "window"), "wid").mapInPandas(_divide(length), PART), "parts")
        kinds = made.groupBy(*core, *whole).agg(F.sum("n").alias("copies"), F.min("wid").alias("wid"))
        kinds = materialize(kinds, "kinds")
        settled = materialize(made.where("n = 1").join(kinds.where("copies > 1").drop("wid"), [*core, *whole]).select("wid", "begin", "end"), "settled")
        release(made)
        spans = spans.unionByName(settled)
        sets = kinds.groupBy(*core).agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1 and first < last")
        sets = materialize(sets, "sets")
        open_ = materialize(kinds.join(sets, core).select("wid", F.col("core").alias("set"), F.col("copies").alias("n"), "first", "last", "kinds"), "open")
        release(kinds)
        calm = calm.unionByName(open_.where(F.col("kinds") <= hot).drop("kinds"))
        if not sets.where(F.col("kinds") > hot).limit(1).count():
            break
        live = open_.where(F.col("kinds") > hot).drop("kinds")
    return spans.groupBy("wid").agg(F.min("begin").alias("begin"), F.max("end").alias("end")), calm


def spans(docs: DataFrame, length: int = 400, gram: int = GRAM, hot: int = 3000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(did, th, tk, spans): for each row that loses bytes, the maximal (a, b) runs to remove."""
    rows, reach = _rows(docs), length - gram
    found = materialize(rows.mapInPandas(_find(length, gram), f"{PLACE}, pos int, right int, key long, around long, around2 long"), "anchors")
    same, place = ["key", "around", "around2"], [*ROW, "pos"]
    # any member may stand for its class: all have the same surroundings
    classes = materialize(found.groupBy(*same).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in place]), "classes")
    copies = classes.where("n > 1").select(*same)
    settled = found.join(copies, same).select(*ROW, F.greatest(F.lit(0), F.col("pos") - reach).alias("a"), (F.col("pos") + F.col("right")).alias("b"))
    settled = materialize(settled, "settled")
    release(found)
    # grams with several classes, at least one of them a single anchor
    shared = classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1")
    places = classes.join(shared, "key").select("key", "n", *place, (F.col("classes") > hot).alias("hot"))
    wanted = places.groupBy(*ROW).agg(F.collect_list(F.struct("key", "n", "pos", "hot")).alias("places"))
    wanted = materialize(wanted, "wanted")
    release(classes)
    weight, some_hot = wanted.agg(F.coalesce(F.sum(F.size("places") + 1), F.lit(0)), F.bool_or(F.exists("places", lambda p: p["hot"]))).first()
    # texts travel once for all sets
    fetched = rows.join(small(wanted, weight, broadcast_rows), ROW).mapInPandas(_fetch(reach, length), WINDOW)
    windows = materialize(fetched.withColumn("wid", F.monotonically_increasing_id()), "windows")
    release(wanted)
    meeting = windows.where("not hot").select(F.col("key").alias("set"), F.lit(-reach).alias("first"), F.lit(0).alias("last"), "n", *ROW, "pos", "left", "window")
    all_spans = settled
    if some_hot:
        large = windows.where("hot")
        runs, calm = _hot_spans(large, length, gram, hot)
        runs = runs.join(large.select("wid", *ROW, "pos"), "wid").select(*ROW, (F.col("pos") + F.col("begin")).alias("a"), (F.col("pos") + F.col("end")).alias("b"))
        all_spans = all_spans.unionByName(runs)
        later = calm.join(large.drop("n", "key"), "wid").select(*meeting.columns)
        meeting = meeting.unionByName(later)
    met = meeting.repartition("set").sortWithinPartitions("set", "first").mapInPandas(_meet(length), f"{PLACE}, a int, b int")
    all_spans = all_spans.unionByName(met)
    # a span as one number
    by_row = all_spans.groupBy(*ROW).agg(F.collect_set(F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("spans"))
    made = materialize(by_row.mapInPandas(_merge, f"{PLACE}, spans array<struct<a:int,b:int>>"), "spans")
    release(settled, windows)
    return made


@tidy
def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        runs = [[{"a": int(x) >> 32, "b": int(x) & 0xFFFFFFFF} for x in pieces] for pieces in pdf["spans"]]
        yield pdf.assign(spans=[[{"a": a, "b": b} for a, b in merged(pieces)] for pieces in runs])


def merged(pieces: list) -> list[tuple[int, int]]:
    """Ascending, disjoint, non-touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((p["a"], p["b"]) for p in pieces):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join(parts) + raw[at:]


def _removed(docs: DataFrame, broadcast_rows: int, **parameters) -> tuple[DataFrame, Column]:
    """docs joined with the runs to remove of each row, null for none, and the column that has them."""
    found = spans(docs, broadcast_rows=broadcast_rows, **parameters)
    weight = found.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]
    th, tk = text_keys(F.coalesce(docs["text"], F.lit("")))
    on = (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == found["did"]) & (th == found["th"]) & (tk == found["tk"])
    return docs.join(small(found, weight, broadcast_rows), on, "left"), found["spans"]


def suffix_dedup(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **parameters) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes left)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, pieces in zip(pdf["text"], pdf["spans"], strict=True):
                raw, runs = text.encode(), merged(pieces) if pieces is not None else []
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_cut(raw, runs)).hexdigest()))
            made = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            made.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield made

    docs = texts(docs)
    rows, runs = _removed(docs, broadcast_rows, **parameters)
    return rows.select(docs["doc_id"], docs["text"], runs.alias("spans")).mapInPandas(tidy(fold), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **parameters) -> DataFrame:
    """docs with the repeated bytes cut out of text, and n_chars, where there is such a column, counted anew.

    Characters of which only some bytes went go whole; rows whose whole text went are left out, untouched rows stay
    as they are.
    """
    rows, runs = _removed(docs, broadcast_rows, **parameters)
    cut = F.pandas_udf(lambda text, spans: pd.Series([_cut(t.encode(), merged(p)).decode("utf-8", "ignore") for t, p in zip(text, spans, strict=True)]), "string").asNondeterministic()  # else the filter below would run it again
    touched = runs.isNotNull()
    less = cut(F.coalesce(docs["text"], F.lit("")), F.coalesce(runs, F.array()))
    out = {c: docs[c] for c in docs.columns} | {"text": F.when(touched, less).otherwise(docs["text"])}
    made = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(out.values())], touched.alias("touched"))
    at = {name: F.col(f"c{i}") for i, name in enumerate(out)}
    made = made.where(~F.col("touched") | (F.length(at["text"]) > 0))
    if "n_chars" in at:
        at["n_chars"] = F.when(F.col("touched"), F.length(at["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(at["n_chars"])
    return made.select(*[c.alias(name) for name, c in at.items()])
