"""Exact dedup by a log-structured merge index of text digests.

Every scan task is one memtable writer: its index takes (digest, doc_id) pairs, flushes full memtables as
sorted digest runs, each with a Bloom filter that spares most look-ups, and compacts the runs into one that keeps
the smallest identifier. A digest hit counts only after the bytes of both texts have been compared, so texts that
share a digest but differ stay apart. The tasks' runs meet in a second compaction, partitioned by digest: each
carries one row per distinct text of its task, so a group of copies, however large, brings at most one row from
each task. Members get their result by an ordinary join on the digest, which Spark splits where it is skewed.

Defined results: null text is the empty text; rows with equal doc_id are separate rows; a null doc_id sorts after
every other id; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import WS, one_of_each, texts, tidy
from sonde.plans.lineage import materialize

NO_ID = 2**63 - 1


@dataclass
class Run:
    """Digests in ascending order, their entries, and a Bloom filter over them."""

    keys: np.ndarray
    entries: list[list[int]]
    bits: np.ndarray = field(repr=False)

    @staticmethod
    def of(keys: np.ndarray, entries: list[list[int]]) -> Run:
        slots = 1 << max(10, int(len(keys) * 10).bit_length())
        bits = np.zeros(slots, dtype=bool)
        for shift in (0, 21, 42):
            bits[(keys >> np.uint64(shift)) & np.uint64(slots - 1)] = True
        return Run(keys, entries, bits)

    def find(self, key: int) -> list[int] | None:
        mask = len(self.bits) - 1
        if not (self.bits[key & mask] and self.bits[(key >> 21) & mask] and self.bits[(key >> 42) & mask]):
            return None
        at = int(np.searchsorted(self.keys, np.uint64(key)))
        return self.entries[at] if at < len(self.keys) and int(self.keys[at]) == key else None


class Index:
    """Digest -> entries; an entry is one distinct text. Memory grows with the distinct texts put in."""

    def __init__(self, memtable: int = 4096, fan_in: int = 8) -> None:
        self.memtable, self.fan_in = memtable, fan_in
        self.recent: dict[int, list[int]] = {}
        self.runs: list[Run] = []
        self.text: list[bytes] = []
        self.least: list[int] = []
        self.count: list[int] = []

    def put(self, digest: int, text: bytes, doc_id: int, count: int = 1) -> int:
        """Add one text; returns its entry's number."""
        for entry in self._hits(digest):
            if self.text[entry] == text:
                self.least[entry] = min(self.least[entry], doc_id)
                self.count[entry] += count
                return entry
        entry = len(self.text)
        self.text.append(text)
        self.least.append(doc_id)
        self.count.append(count)
        self.recent.setdefault(digest, []).append(entry)
        if len(self.recent) >= self.memtable:
            self._flush()
        return entry

    def _hits(self, digest: int) -> Iterator[int]:
        yield from self.recent.get(digest, ())
        for run in reversed(self.runs):
            yield from run.find(digest) or ()

    def _flush(self) -> None:
        keys = np.array(sorted(self.recent), dtype=np.uint64)
        self.runs.append(Run.of(keys, [self.recent[int(k)] for k in keys]))
        self.recent = {}
        if len(self.runs) >= self.fan_in:
            merged: dict[int, list[int]] = {}
            for run in self.runs:
                for key, entries in zip(run.keys.tolist(), run.entries, strict=True):
                    merged.setdefault(key, []).extend(entries)
            keys = np.array(sorted(merged), dtype=np.uint64)
            self.runs = [Run.of(keys, [merged[int(k)] for k in keys])]


def _digest(sha: bytes, bits: int) -> int:
    return int.from_bytes(sha[:8], "little") >> (64 - bits)


def _runs(bits: int):
    """Scan task -> one row per distinct text of the task, with the smallest id and the number of copies."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, shas = Index(), []
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                raw = text.encode()
                sha = hashlib.sha256(raw).digest()
                if index.put(_digest(sha, bits), raw, doc_id) == len(shas):
                    shas.append(sha)
        for at in range(0, len(shas), 512):
            part = shas[at : at + 512]
            yield pd.DataFrame(
                {
                    "digest": [np.uint64(_digest(s, bits)).astype(np.int64) for s in part],
                    "sha": part,
                    "least": index.least[at : at + 512],
                    "n": index.count[at : at + 512],
                    "text": index.text[at : at + 512],
                }
            )

    return tidy(fold)


def _compact(bits: int):
    """Runs partitioned and sorted by digest -> one row per distinct text. Only one digest's texts are held at a time."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, index, shas, done = None, Index(), [], []

        def close() -> None:
            done.extend(zip(shas, index.least, index.count, strict=True))

        for pdf in batches:
            for digest, sha, least, n, text in pdf.itertuples(index=False):
                if digest != at:
                    close()
                    at, index, shas = digest, Index(), []
                if index.put(int(np.int64(digest).astype(np.uint64)), text, least, n) == len(shas):
                    shas.append(sha)
            if len(done) >= 4096:
                yield pd.DataFrame(done, columns=["sha", "least", "n"])
                done.clear()
        close()
        yield pd.DataFrame(done, columns=["sha", "least", "n"])

    return tidy(fold)


def groups(normal: DataFrame, digest_bits: int = 64) -> DataFrame:
    """(doc_id, text) -> one row per distinct text: sha, least (smallest doc_id), n (its rows)."""
    runs = normal.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").mapInPandas(
        _runs(digest_bits), "digest long, sha binary, least long, n long, text binary"
    )
    parts = runs.repartition("digest").sortWithinPartitions("digest")
    return parts.select("digest", "sha", "least", "n", "text").mapInPandas(
        _compact(digest_bits), "sha binary, least long, n long"
    )


def exact_dedup(docs: DataFrame, digest_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text.

    digest_bits shortens the index's digests so that tests can force collisions; the text's whole sha256 identifies
    it in the result.
    """
    normal = texts(docs).withColumn("text", F.regexp_replace("text", WS, " "))
    found = materialize(groups(normal, digest_bits), "exact")
    members = normal.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"))
    least = F.when(F.col("least") != NO_ID, F.col("least"))
    return members.join(found, "sha").select(
        "doc_id",
        least.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(least).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """docs without the copies: of equal texts one row with the smallest doc_id stays, the least where several have it."""
    found = exact_dedup(docs).groupBy(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("h")).agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    marks = found.where(~F.col("kept") | (F.col("n") > 1))
    sha = F.unhex(F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), WS, " "), 256))
    return one_of_each(docs, marks, sha, broadcast_rows)
