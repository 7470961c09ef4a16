"""N-best sentencepiece segmentation: Viterbi forwards, A-star backwards.

The lattice of a text has an edge for every vocabulary piece that matches somewhere. Forward Viterbi gives each
position the best score of what stands before it; a backward search from the end, ordered by the score of its tail
plus that exact heuristic, then yields segmentations best first. No piece has a mark other than at its front, so a
text's lattice falls into units, each of marks and what follows up to the next mark, that meet in single positions.
Viterbi runs over all units of many texts at once, on arrays, and keeps each unit's two best scores. The n best of a
text differ from its best one in at most n-1 units, those with the smallest gaps, so only these are searched.

Piece scores are log-probabilities by rank (see pieces.Pieces). A character outside the vocabulary becomes the byte
pieces of its UTF-8 form. Decoding restores the text exactly, save that a mark which the text itself holds becomes a space.

Defined results: null text is the empty text, which has one segmentation of no pieces; fewer than n segmentations give
as many scores as there are; repeated rows are encoded each; an empty table gives an empty result; other columns are
not read. Equal scores come in the order of the search, which goes on with what is nearest to the front.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sonde.llm.common import texts, tidy
from sonde.llm.pieces import MARK, Pieces, edges

UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Units longer than this take the scalar way, so that one of them does not widen a whole array.
LONG = 40
Segmentation = tuple[float, tuple[int, ...] | np.ndarray]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


class Numbers(dict):
    """Units -> numbers in the order they are met; a key without a mark stands for one mark and the key."""

    def __missing__(self, unit: str) -> int:
        found = self[unit] = len(self)
        return found

    def of(self, text: str) -> list[int]:
        parts = text.split(" ")
        if "" in parts or MARK in text:  # more than one mark before a unit
            parts = UNIT.findall(marked(text))
        return list(map(self.__getitem__, parts))


def lattice(pieces: Pieces, unit: str) -> list[list[tuple[int, int, float]]]:
    """For each end position: (start, piece number or -1, score) of the edges that end there."""
    out: list[list[tuple[int, int, float]]] = [[]]
    number, weight, longest = pieces.number.get, pieces.weight, pieces.longest
    for end in range(1, len(unit) + 1):
        row = []
        for start in range(max(0, end - longest), end):
            piece = number(unit[start:end])
            if piece is not None:
                row.append((start, piece, weight[piece]))
            elif start == end - 1:
                row.append((start, -1, pieces.unknown))
        out.append(row)
    return out


def search(pieces: Pieces, unit: str, n: int) -> list[Segmentation]:
    """The n best (score, piece numbers), -1 standing for an unknown character."""
    ends = lattice(pieces, unit)
    ahead = [0.0] + [-math.inf] * len(unit)
    for end in range(1, len(unit) + 1):
        ahead[end] = max(ahead[start] + score for start, _, score in ends[end])
    found: list[Segmentation] = []
    # scores add up without rounding; of equal ones the path that has come furthest goes first
    heap = [(-ahead[-1], len(unit), 0, 0.0, None)]
    pushed = 0
    while heap and len(found) < n:
        _, at, _, tail, path = heapq.heappop(heap)
        if at == 0:
            steps = []
            while path:
                steps.append(path[0])
                path = path[1]
            found.append((tail, tuple(steps)))
            continue
        for start, piece, score in ends[at]:
            pushed += 1
            heapq.heappush(heap, (-(ahead[start] + score + tail), start, pushed, score + tail, (piece, path)))
    return found


def viterbi(pieces: Pieces, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best and second-best score of each unit, the number of pieces of its best segmentation, and those of all, in a row."""
    n, width = len(units), max(map(len, units), default=0)
    lengths = np.fromiter(map(len, units), dtype=np.int64, count=n)
    best, second = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
    back, piece = np.zeros((width + 1, n), dtype=np.int16), np.full((width + 1, n), -1, dtype=np.int32)
    best[0] = 0.0
    scores = np.append(pieces.scores, pieces.unknown)
    for end, length, rows, found in edges(pieces, units):
        step = scores[found]
        one, two = best[end - length][rows] + step, second[end - length][rows] + step
        old, low = best[end][rows], second[end][rows]
        win = one > old
        second[end][rows] = np.maximum(np.maximum(low, two), np.minimum(one, old))
        won = rows[win]
        best[end][won], back[end][won], piece[end][won] = one[win], length, found[win]
    own = np.arange(n)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    at = lengths.copy()
    while (at > 0).any():
        live = np.flatnonzero(at > 0)
        steps.append((live, piece[at[live], live]))
        at[live] -= back[at[live], live]
    order = np.concatenate([own[:0], *[r for r, _ in reversed(steps)]])
    flat = np.concatenate([np.zeros(0, np.int32), *[p for _, p in reversed(steps)]])[np.argsort(order, kind="stable")]
    return best[lengths, own], second[lengths, own], np.bincount(order, minlength=n), flat


def merge(parts: list[list[Segmentation]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best sums of one alternative from each part: (sum, alternatives' numbers)."""
    found: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for part in parts:
        sums = [(total + alt[0], chosen + (i,)) for total, chosen in found for i, alt in enumerate(part)]
        found = sorted(sums, key=lambda x: -x[0])[:n]
    return found


def to_ids(pieces: Pieces, unit: str, numbers: Iterable[int]) -> list[int]:
    """Vocabulary ids; unknown characters become byte pieces."""
    out, at = [], 0
    for k in numbers:
        if k >= 0:
            out.append(pieces.id[k])
            at += len(pieces.text[k])
        else:
            out += [pieces.bytes[b] for b in unit[at].encode()]
            at += 1
    return out


class Decoder:
    def __init__(self, pieces: Pieces) -> None:
        size = int(max(pieces.ids.max(), max(pieces.bytes.values()))) + 1
        self.raw = [b""] * size
        for i, t in zip(pieces.ids.tolist(), pieces.text, strict=True):
            self.raw[i] = t.replace(MARK, " ").encode()
        for b, i in pieces.bytes.items():
            self.raw[i] = bytes([b])

    def __call__(self, ids: np.ndarray) -> str:
        """The text whose ids these are (texts hold no mark of their own)."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode()[1:]


@functools.lru_cache(maxsize=2)
def vocabulary(model_path: str) -> Pieces:
    """Read once by a Python worker, whatever tasks it gets."""
    return Pieces(model_path)


class Encoder:
    """Texts -> their n best segmentations. What is known of units is kept, for about `most` of them."""

    def __init__(self, model_path: str, n: int, most: int = 300_000) -> None:
        self.pieces, self.n, self.most = vocabulary(model_path), n, most
        self._forget()

    def _forget(self) -> None:
        self.number, self.units = Numbers(), []
        self.others: dict[int, list[Segmentation]] = {}
        # of each unit: best score, second-best score, place and number of the best ids in flat
        self.one, self.two = np.zeros(0), np.zeros(0)
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, units: list[str]) -> None:
        """Segment units, the numbers of which follow those of the units known."""
        own = np.array([len(u) for u in units], dtype=np.int64)
        order = np.argsort(own, kind="stable").tolist()
        first_long = int((own <= LONG).sum())
        short, parts = [units[i] for i in order[:first_long]], []
        for at in range(0, len(short), 20_000):
            some = short[at : at + 20_000]
            one, two, size, numbers = viterbi(self.pieces, some)
            ids = np.append(self.pieces.ids, -1)[numbers].astype(np.int32)
            if len(numbers) and numbers.min() < 0:  # unknown characters become bytes
                size, ids = self._spell(some, size, numbers, ids)
            parts.append((one, two, size, ids))
        for u in (units[i] for i in order[first_long:]):
            found = search(self.pieces, u, 2)
            ids = np.array(to_ids(self.pieces, u, found[0][1]), dtype=np.int32)
            parts.append(([found[0][0]], [found[1][0] if len(found) > 1 else -np.inf], [len(ids)], ids))
        if parts:
            one, two, size, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            place = np.empty(len(units), dtype=np.int64)
            place[order] = np.arange(len(units))
            start = np.cumsum(size) - size + len(self.flat)
            self.one, self.two = np.concatenate([self.one, one[place]]), np.concatenate([self.two, two[place]])
            self.start, self.size = np.concatenate([self.start, start[place]]), np.concatenate([self.size, size[place]])
            self.flat = np.concatenate([self.flat, ids])

    def _spell(self, units: list[str], size: np.ndarray, numbers: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of units, in a row, with the byte pieces of each unknown character in its place."""
        step = np.append(self.pieces.lengths, 1)[numbers]
        unknown = np.flatnonzero(numbers < 0)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")[(np.cumsum(step) - step)[unknown]]
        different, which = np.unique(points, return_inverse=True)
        spelled = [[self.pieces.bytes[b] for b in chr(c).encode()] for c in different.tolist()]
        width = np.array([len(x) for x in spelled])[which]
        table = np.array([x + [0] * (4 - len(x)) for x in spelled], dtype=np.int32)
        count = np.ones(len(ids), dtype=np.int64)
        count[unknown] = width
        past = np.concatenate([[0], np.cumsum(count)])
        out = np.repeat(ids, count)
        for k in range(4):
            some = width > k
            out[past[unknown[some]] + k] = table[which[some], k]
        ends = np.cumsum(size)
        return past[ends] - past[ends - size], out

    def _alternatives(self, number: int) -> list[Segmentation]:
        """A unit's n best as (score, ids), that of Viterbi first: the search may have an equal one before it."""
        found = self.others.get(number)
        if found is None:
            unit = self.units[number]
            best = self.flat[self.start[number] : self.start[number] + self.size[number]]
            ids = [(score, np.array(to_ids(self.pieces, unit, p), dtype=np.int32)) for score, p in search(self.pieces, unit, self.n)]
            found = [(float(self.one[number]), best), *(x for x in ids if not np.array_equal(x[1], best))][: self.n]
            self.others[number] = found
        return found

    def segmentations(self, texts_: list[str], spelled: bool = True) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text its n best (score, ids), best first; unless all are to be spelled, only the best has ids."""
        if len(self.number) > self.most:
            self._forget()
        split, known = [self.number.of(t) if t else [] for t in texts_], len(self.one)
        self.units += [u if u.startswith(MARK) else MARK + u for u in islice(self.number, known, None)]
        self._learn(self.units[known:])
        every = np.fromiter(chain.from_iterable(split), dtype=np.int64)
        size = self.size[every]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[every] - (ends - size), size) + np.arange(int(size.sum()))]
        gap, one, at = self.one[every] - self.two[every], self.one[every], 0
        for units in split:
            here = slice(at, at + len(units))
            first = int(ends[at] - size[at]) if units else 0
            ids = flat[first : int(ends[here.stop - 1])] if units else flat[:0]
            total = float(one[here].sum())
            chosen = (np.argsort(gap[here], kind="stable")[: self.n - 1]).tolist()
            found = [self._alternatives(units[i]) for i in chosen]
            parts = [[(score - alternatives[0][0], other) for score, other in alternatives] for alternatives in found]
            out = []
            for more, picks in merge(parts, self.n):
                if out and not spelled:
                    out.append((total + more, None))
                    continue
                cuts = sorted((int(ends[at + i] - size[at + i]) - first, int(ends[at + i]) - first, found[k][pick][1]) for k, (i, pick) in enumerate(zip(chosen, picks, strict=True)) if pick)
                spans, done = [], 0
                for a, b, other in cuts:
                    spans += [ids[done:a], other]
                    done = b
                out.append((total + more, np.concatenate([*spans, ids[done:]]) if spans else ids))
            at = here.stop
            yield out

    def nbest(self, texts_: list[str]) -> Iterator[tuple[np.ndarray, list[float]]]:
        for found in self.segmentations(texts_):
            yield found[0][1], [score for score, _ in found]


def encode(docs: DataFrame, model_path: str, n: int = 4, ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the best ids, little-endian uint32), scores (best first), decoded (exact round trip) and, unless they are not wanted, ids (of each of the n best)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model_path, n)
        decoder = Decoder(encoder.pieces)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                found = list(encoder.segmentations(part["text"].tolist(), spelled=ids))
                best = [segmentations[0][1] for segmentations in found]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                        "n_pieces": [len(own) for own in best],
                        "ids_crc32": [zlib.crc32(own.astype("<u4").tobytes()) for own in best],
                        "scores": [[score for score, _ in segmentations] for segmentations in found],
                        "decoded": [decoder(own) == text.replace(MARK, " ") for own, text in zip(best, part["text"], strict=True)],
                    }
                    | ({"ids": [[own for _, own in segmentations] for segmentations in found]} if ids else {})
                )

    return texts(docs).mapInPandas(tidy(fold), "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, decoded boolean" + ", ids array<array<int>>" * ids)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, texts: what each segmentation in ids decodes to."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(Pieces(model_path))
        for pdf in batches:
            texts_ = [[decoder(np.asarray(ids, dtype=np.int64)) for ids in found] for found in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "texts": texts_})

    return encoded.select("doc_id", "ids").mapInPandas(tidy(fold), "doc_id long, texts array<string>")
