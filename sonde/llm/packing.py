"""Sum-of-squares online packing of token streams into windows of 1,024.

A scan task packs its documents as they come. Whole windows are cut from a document longer than one; what is left
goes to the fill level where it makes the sum of squared counts of partially filled windows smallest, a new window
being level 0. counts[h] is the level array: how many open windows hold h tokens. When the input ends, the few open
windows are closed by cutting the emptiest ones into the gaps of the fullest, so a task leaves at most one window
short of 1,024. Nothing is shuffled, and a repeated task repeats its result.

Defined results: null text is the empty text (one end token); rows with equal doc_id are packed separately; a null
doc_id stays null; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sonde.llm.common import texts, tidy

WINDOW = 1024


class Packer:
    """Places lengths of 1..window; open windows are kept by fill level."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]
        self.fill: list[int] = []

    def place(self, length: int) -> tuple[int, int]:
        """(window number, offset) for a piece that is not cut."""
        room = self.window - length
        # moving one window from level h to h+length changes the sum of squares by 2*(N[h+length]-N[h]+1)
        gain = self.counts[length:] - self.counts[: room + 1] + 1.0
        gain[0] = self.counts[length] + 0.5
        gain[-1] = 0.5 if room == 0 else 0.5 - self.counts[room]
        gain[1:][self.counts[1 : room + 1] == 0] = np.inf
        level = int(np.argmin(gain))
        if level:
            number = self.open[level].pop()
            self.counts[level] -= 1
        else:
            number = len(self.fill)
            self.fill.append(0)
        self.fill[number] = level + length
        if level + length < self.window:
            self.open[level + length].append(number)
            self.counts[level + length] += 1
        return number, level


def close(packer: Packer, pieces: dict[int, list[tuple]]) -> list[tuple]:
    """Pieces of the open windows, cut so that all but the last window are full."""
    waiting = [n for level in range(packer.window - 1, 0, -1) for n in packer.open[level]]
    out, left, right = [], 0, len(waiting) - 1
    while left <= right:
        number = waiting[left]
        row = pieces[number]
        filled = sum(p[2] for p in row)
        while filled < packer.window and left < right:
            source = pieces[waiting[right]]
            doc, start, length, ids, total = source.pop()
            take = min(length, packer.window - filled)
            row.append((doc, start, take, ids[:take], total))
            filled += take
            if take < length:
                source.append((doc, start + take, length - take, ids[take:], total))
            if not source:
                right -= 1
        out.append((number, row))
        left += 1
    return out


class Tokens:
    """Texts -> ids as little-endian uint32 bytes.

    The same vocabulary as ranks gives the same ids in less time, words met once included. Texts with other spacing than
    single spaces, or with the special token, are encoded by the tokenizer itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.by_rank = Tokenizer.from_file(path), None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.by_rank = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = re.compile(r"\s | \s|<\|endoftext\|>")

    def _encode(self, items: list[str]) -> list[bytes]:
        if not items:
            return []
        found = self.tokenizer.encode_batch_fast(items, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def __call__(self, items: list[str]) -> list[bytes]:
        if self.by_rank is None:
            return self._encode(items)
        odd = [self.odd.search(t) is not None for t in items]
        whole = iter(self._encode([t for t, o in zip(items, odd, strict=True) if o]))
        return [next(whole) if o else array("I", self.by_rank(t)).tobytes() for t, o in zip(items, odd, strict=True)]


@cache
def tokens(path: str, ranks_path: str | None, pattern: str | None) -> Tokens:
    """One model for all tasks of a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Tokens(path, ranks_path, pattern)


def _pack(files: tuple, window: int, with_ids: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    end = np.zeros(1, dtype="<u4").tobytes()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 36
        encode, packer, held = tokens(*files), Packer(window), {}

        def rows(number: int, pieces: list[tuple]) -> Iterator[tuple]:
            offset = 0
            for doc, start, length, ids, total in pieces:
                row = doc, start, length, zlib.crc32(ids), total, base + number, offset
                yield (*row, np.frombuffer(ids, dtype="<u4").astype(np.int32)) if with_ids else row
                offset += length

        for pdf in batches:
            out = []
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                for doc, raw in zip(part["doc_id"], encode(part["text"].tolist()), strict=True):
                    ids = np.frombuffer(raw + end, dtype="<u4")
                    total = len(ids)
                    whole = total // window * window
                    for start in range(0, whole, window):
                        number = len(packer.fill)
                        packer.fill.append(window)
                        out += rows(number, [(doc, start, window, ids[start : start + window], total)])
                    if whole < total:
                        number, _ = packer.place(total - whole)
                        held.setdefault(number, []).append((doc, whole, total - whole, ids[whole:].copy(), total))
                        if packer.fill[number] == window:
                            out += rows(number, held.pop(number))
            yield _frame(out, names)
        yield _frame([r for number, pieces in close(packer, held) for r in rows(number, pieces)], names)

    return tidy(fold)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    return pdf.astype({"doc_id": "Int64"} | {n: "int64" for n in names[1:7]})


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, window: int = WINDOW, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless they are not wanted, ids (the piece's tokens).

    A document's tokens are its text's ids and the end id 0; each lies in exactly one piece. Sequences are padded to
    `window`, save those whose fill is a power of two. ranks_path and pattern: the same vocabulary as ranks, if there is one.
    """
    return texts(docs).mapInPandas(
        _pack((tokenizer_path, ranks_path, pattern), window, ids),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids,
    )
