"""Hash-compared suffix sorting of many small sets of suffixes at once.

Prefix polynomial hashes of a byte buffer give the hash of any substring; binary search over lengths finds the common
extension of two suffixes, so a comparison takes a logarithmic number of steps. The sets are sorted by a bottom-up
mergesort on arrays, all sets together. A comparison looks at the first byte after the common extension, and callers compare the bytes of what they
find equal; where hashes misled, the work is repeated on the bytes themselves.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Hashes:
    """Prefix hashes of a buffer, modulo 2**64."""

    def __init__(self, buffer: np.ndarray) -> None:
        self.buffer, n = buffer, len(buffer)
        power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, BASE, dtype=np.uint64), dtype=np.uint64)))
        self.back = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, INVERSE, dtype=np.uint64), dtype=np.uint64)))
        self.prefix = np.concatenate(([np.uint64(0)], np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.back[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension to the right of positions a and b, at most `most`."""
        low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def common_back(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension to the left of positions a and b (exclusive), at most `most`."""
        low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.of(a - mid, mid) == self.of(b - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


class Collision(Exception):
    """Two different substrings have one hash."""


def _sign(h: Hashes, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    common = h.common(a, b, length)
    end = common == length
    x, y = h.buffer[np.where(end, 0, a + common)].astype(np.int16), h.buffer[np.where(end, 0, b + common)].astype(np.int16)
    if ((x == y) & ~end).any():
        raise Collision
    return np.where(end, 0, np.sign(x - y))


def _order(h: Hashes, sets: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sorting order; sets must ascend, and one set's suffixes have one length."""
    n = len(sets)
    order = np.arange(n)
    first = np.flatnonzero(np.diff(sets, prepend=sets[:1] - 1)) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    base, total = np.repeat(first, size), np.repeat(size, size)
    local = np.arange(n) - base
    run = 1
    while n and run < size.max():
        live = np.flatnonzero(total > run)
        at, b, t = local[live], base[live], total[live]
        mine = at // run
        left = (mine ^ 1) * run
        low, high = np.minimum(left, t), np.minimum(left + run, t)
        begin = low.copy()
        own = order[live]
        right_run = (mine & 1) == 1
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) // 2
            other = order[b[open_] + mid]
            sign = _sign(h, start[other], start[own[open_]], length[own[open_]])
            before = (sign < 0) | ((sign == 0) & right_run[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        place = b + (mine & ~1) * run + at % run + (low - begin)
        moved = order.copy()
        moved[place] = own
        order = moved
        run *= 2
    return order


def suffix_sort(h: Hashes, sets: np.ndarray, start: np.ndarray, length: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(order, equal): the suffixes of each set in order, each cut to `length` bytes, and whether each equals the one before it in its set.

    Sets must ascend, and one set's suffixes have one length. Equality is that of the hashes, for the caller to verify; with
    `plain` the bytes themselves are compared throughout.
    """
    equal = np.zeros(len(sets), dtype=bool)
    if plain:
        raw = h.buffer.tobytes()
        cut = [raw[s : s + n] for s, n in zip(start.tolist(), length.tolist(), strict=True)]
        order = np.array(sorted(range(len(sets)), key=lambda i: (sets[i], cut[i])), dtype=np.int64)
        equal[1:] = [sets[a] == sets[b] and cut[a] == cut[b] for a, b in zip(order[:-1], order[1:], strict=True)]
        return order, equal
    order = _order(h, sets, start, length)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        same = np.flatnonzero(sets[a] == sets[b])
        a, b = a[same], b[same]
        equal[same + 1] = h.of(start[a], length[a]) == h.of(start[b], length[a])
    return order, equal


def same_bytes(h: Hashes, a: np.ndarray, b: np.ndarray, length: np.ndarray, step: int = 4096) -> np.ndarray:
    """Whether the `length` bytes at positions a and b are the same, pair by pair."""
    out = np.ones(len(a), dtype=bool)
    for i in range(0, len(a), step):
        part = slice(i, i + step)
        span = np.arange(int(length[part].max()))
        inside = span < length[part][:, None]
        x = h.buffer[np.where(inside, a[part][:, None] + span, 0)]
        y = h.buffer[np.where(inside, b[part][:, None] + span, 0)]
        out[part] = (x == y).all(axis=1)
    return out
