"""A fixed public piece vocabulary, looked up in bulk by hashes of substrings."""

from __future__ import annotations

import numpy as np

#: Scores are whole multiples of this, so that sums of them are exact and equal ones are equal in whatever order they are added.
GRAIN = 2.0**-24
#: Sentencepiece's mark for a space.
MARK = "▁"
BASE = np.uint64(0x100000001B3)


class Pieces:
    """Piece strings and log-probabilities, with a hash table over (polynomial hash of code points, length).

    scores: one log-probability for each piece, from its rank in the vocabulary, by Zipf's law: p is proportional to
    1 / (rank + 2), to the nearest multiple of GRAIN. Single characters outside the vocabulary have the score `unknown`.
    """

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = np.array(plain, dtype=np.int64)
        self.text = [model.id_to_piece(i) for i in plain]
        order = np.argsort(np.argsort([-model.get_score(i) for i in plain], kind="stable"), kind="stable")
        weight = 1.0 / (order + 2.0)
        self.scores = np.round(np.log(weight / weight.sum()) / GRAIN) * GRAIN
        self.unknown = float(self.scores.min()) - 10.0
        # the same as plain lists, for work on single units
        self.weight, self.id = self.scores.tolist(), plain
        self.longest = max(map(len, self.text))
        self.number = {t: i for i, t in enumerate(self.text)}
        self.bytes = {b: i for i in range(model.get_piece_size()) if model.is_byte(i) for b in [int(model.id_to_piece(i)[3:5], 16)]}
        points, self.lengths = padded(self.text)
        hashes = prefix_hashes(points)[np.arange(len(self.text)), self.lengths]
        self._keys = np.sort(hashes)
        self._at = np.argsort(hashes)
        if len(np.unique(self._keys)) != len(self._keys):
            raise ValueError("two pieces share a hash")
        # a direct table over the top bits names the first key that may be meant; those of the same slot follow it
        slot = (self._keys >> np.uint64(44)).astype(np.int64)
        self._maybe = np.zeros(1 << 20, dtype=bool)
        self._maybe[slot] = True
        self._first = np.zeros(1 << 20, dtype=np.int32)
        self._first[slot[::-1]] = np.arange(len(slot))[::-1]
        self._more = np.append(slot[1:] == slot[:-1], False)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each substring hash, -1 if there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        slot = (hashes >> np.uint64(44)).astype(np.int64)
        live = np.flatnonzero(self._maybe[slot])
        part, at = hashes[live], self._first[slot[live]]
        while len(live):
            good = self._keys[at] == part
            out[live[good]] = self._at[at[good]]
            on = ~good & self._more[at]
            live, part, at = live[on], part[on], at[on] + 1
        return out


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a rectangle, padded with 0, and the lengths."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = int(lengths.max()) if len(words) else 0
    points = np.zeros((len(words), width), dtype=np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points[np.arange(width) < lengths[:, None]] = flat
    return points, lengths


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes, mixed, of all prefixes of each row; column 0 is the empty prefix."""
    raw = raw_prefixes(points)
    return finish(raw)


def raw_prefixes(points: np.ndarray) -> np.ndarray:
    out = np.zeros((points.shape[0], points.shape[1] + 1), dtype=np.uint64)
    for i in range(points.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + points[:, i] + np.uint64(1)
    return out


def finish(raw: np.ndarray) -> np.ndarray:
    raw = (raw ^ (raw >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return raw ^ (raw >> np.uint64(29))


def powers(width: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(width, BASE, dtype=np.uint64), dtype=np.uint64)))


def edges(pieces: Pieces, words: list[str]):
    """For each end position, then each length, the pieces of all words: yields (end, length, rows, piece numbers)."""
    points, lengths = padded(words)
    # a row for each position, so that what is taken together lies together
    raw, power = np.ascontiguousarray(raw_prefixes(points).T), powers(points.shape[1])
    for end in range(1, points.shape[1] + 1):
        rows = np.flatnonzero(lengths >= end)
        here = raw[end][rows]
        for length in range(1, min(end, pieces.longest) + 1):
            found = pieces.find(finish(here - raw[end - length][rows] * power[length]))
            yield end, length, rows[found >= 0] if length > 1 else rows, found[found >= 0] if length > 1 else found
