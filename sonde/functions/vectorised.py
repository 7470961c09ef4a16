"""Values Spark has no expression for, as Arrow-batched functions."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFSET, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a(items: list[bytes]) -> np.ndarray:
    """FNV-1a 64 of many byte strings, one byte position of all at a time."""
    sizes = np.array([len(b) for b in items], dtype=np.int64)
    out = np.full(len(items), OFFSET, dtype=np.uint64)
    flat = np.frombuffer(b"".join(items), dtype=np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max()) if len(items) else 0):
        live = np.flatnonzero(sizes > k)
        out[live] = (out[live] ^ flat[starts[live] + k]) * PRIME
    return out


def simhash64(weights: dict[str, float]) -> str:
    """16 hex digits; a bit is set iff the weighted votes for it are above zero."""
    if not weights:
        return "0" * 16
    names = list(weights)
    bits = np.unpackbits(fnv1a([n.encode() for n in names]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = (np.array([weights[n] for n in names])[:, None] * (bits.astype(np.int64) * 2 - 1)).sum(axis=0)
    return f"{int.from_bytes(np.packbits(votes > 0, bitorder='little').tobytes(), 'little'):016x}"


def _char3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three code points of 21 bits are one number, so a batch's trigrams are counted by sorting numbers."""
    for batch in batches:
        by_lang: dict[str | None, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text and len(text) > 2:
                c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
                by_lang.setdefault(lang, []).append(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
        for lang, parts in by_lang.items():
            kinds, n = np.unique(np.concatenate(parts), return_counts=True)
            points = np.stack([kinds >> 42, kinds >> 21 & 0x1FFFFF, kinds & 0x1FFFFF], axis=1).astype("<u4")
            flat = points.tobytes().decode("utf-32-le", "surrogatepass")
            grams = [flat[i : i + 3] for i in range(0, len(flat), 3)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def char3_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) of (lang, text): character trigrams, counted in each batch; a gram comes once for each batch and language that holds it."""
    return texts.mapInArrow(_char3, "lang string, gram string, n long")


@F.pandas_udf(T.StringType())
def char3_signature(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = t.lower()
        return simhash64(Counter(t[i : i + 3] for i in range(len(t) - 2)))

    return texts.map(one)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """The text in normal form C. Nothing below U+0300 composes, so only texts with code points from there on go to Python."""
    return F.coalesce(_nfc(F.when(F.regexp_like(text, F.lit(r"[^\x{0}-\x{2FF}]")), text)), text)


def ncd(a: bytes, b: bytes, most: int = 50_000) -> float:
    """Normalised compression distance, zlib level 6, in an order that does not depend on the arguments'; 0 to 1."""
    a, b = sorted((a[:most], b[:most]))
    x, y, both = (len(zlib.compress(t, 6)) for t in (a, b, a + b))
    return min(1.0, max(0.0, (both - min(x, y)) / max(x, y)))


@F.pandas_udf(T.DoubleType())
def compression_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else round(ncd(x.encode(), y.encode()), 4) for x, y in zip(a, b, strict=True)], dtype="float64")


def cosine(a: dict[str, float], b: dict[str, float]) -> float:
    """0 where either is empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    dot = sum(v * large.get(k, 0.0) for k, v in small.items())
    norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return dot / norm if norm else 0.0


def impostors(a: list[str], b: list[str], others: list[list[str]], rounds: int = 100, seed: int = 20260523, least: int = 2) -> tuple[float, float]:
    """(score, confidence): how often the messages b are nearer to a than those of every impostor.

    Each round takes words or character trigrams, and of every author half as many messages, drawn with replacement.
    Fewer than `least` messages on a side: (0, 0). Without impostors: the mean cosine over both kinds, and confidence 0.3.
    """
    kinds = (lambda t: Counter(t.lower().split()), lambda t: Counter(t.lower()[i : i + 3] for i in range(len(t) - 2)))
    if len(a) < least or len(b) < least:
        return 0.0, 0.0
    authors = [a, b, *(o for o in others if o)]
    # a message is counted once for each kind; a draw adds counts up
    counted = [[[kind(t) for t in messages] for messages in authors] for kind in kinds]
    if len(authors) == 2:
        return sum(cosine(*(sum(bags, Counter()) for bags in kind)) for kind in counted) / len(kinds), 0.3
    rng, wins = random.Random(seed), 0
    for _ in range(rounds):
        kind = counted[rng.randrange(len(kinds))]
        drawn = [sum(rng.choices(bags, k=max(1, len(bags) // 2)), Counter()) for bags in kind]
        wins += cosine(drawn[0], drawn[1]) > max(cosine(drawn[0], x) for x in drawn[2:])
    return wins / rounds, 1.0


#: The alphabets and constants of the address formats.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def base58_ok(text: str) -> bool:
    """Whether the last four bytes are the double sha256 of the rest."""
    if not text or any(c not in BASE58 for c in text):
        return False
    number = 0
    for c in text:
        number = number * 58 + BASE58.index(c)
    raw = b"\0" * (len(text) - len(text.lstrip("1"))) + number.to_bytes((number.bit_length() + 7) // 8, "big")
    return len(raw) > 4 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_ok(text: str) -> bool:
    """Checksum of bech32 (1) or bech32m (0x2bc830a3)."""
    t = text.lower()
    head, mark, data = t.rpartition("1")
    if not mark or not head or len(data) < 6 or any(c not in BECH32 for c in data) or text not in (t, text.upper()):
        return False
    state = 1
    for v in [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + [BECH32.index(c) for c in data]:
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ v
        for k, step in enumerate(BECH32_STEPS):
            state ^= step if top >> k & 1 else 0
    return state in (1, 0x2BC830A3)


@F.pandas_udf(T.BooleanType())
def address_ok(texts: pd.Series) -> pd.Series:
    """base58check or bech32."""
    return texts.map(lambda t: None if t is None else base58_ok(t) or bech32_ok(t))


@F.pandas_udf(T.StringType())
def jwt_claims(texts: pd.Series) -> pd.Series:
    """The payload of a token as JSON text; null if it has none. Signatures are neither read nor returned."""

    def one(t: str | None) -> str | None:
        parts = (t or "").split(".")
        if len(parts) != 3:
            return None
        try:
            return base64.urlsafe_b64decode(parts[1] + "=" * (-len(parts[1]) % 4)).decode()
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def weighted_signature(names: pd.Series, weights: pd.Series) -> pd.Series:
    """SimHash of named weights, given as two arrays of equal length; weights of null count as none."""
    return pd.Series([None if n is None or w is None else simhash64({k: v for k, v in zip(n, w, strict=True) if v}) for n, w in zip(names, weights, strict=True)], dtype=object)
