"""Checksums of wallet addresses: what tells an address from a string of its shape."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.functions.vectorised import BASE58, BECH32, BECH32_STEPS

#: Lengths and constants of the formats (base58check, bech32, EIP-55, CryptoNote).
CHECKED_BYTES, BTC_VERSIONS, TRON_VERSION = 25, (0x00, 0x05), 0x41
BECH32_MOST, BECH32_OLD, BECH32_NEW = 90, 1, 0x2BC830A3
XMR_BYTES, XMR_BLOCK, XMR_BLOCK_DIGITS = 69, 8, (0, 2, 3, 5, 6, 7, 9, 10, 11)
RATE = 136  # bytes that Keccak-256 takes in at once
_DIGIT = {c: k for k, c in enumerate(BASE58)}


def _round_constants() -> list[int]:
    """A bit register steps seven times a round; its bits go to places 0, 1, 3, 7, 15, 31 and 63."""
    register, out = 1, []
    for _ in range(24):
        constant = 0
        for j in range(7):
            constant |= (register & 1) << ((1 << j) - 1)
            register = register << 1 ^ (0x171 if register >> 7 else 0)
        out.append(constant)
    return out


def _turns() -> list[tuple[int, int, int]]:
    """(lane, turn, where it goes): lanes are walked along (x, y) -> (y, 2x + 3y), turned by the triangular numbers."""
    x, y, out = 1, 0, [(0, 0, 0)]
    for t in range(24):
        to = (y, (2 * x + 3 * y) % 5)
        out.append((x + 5 * y, (t + 1) * (t + 2) // 2 % 64, to[0] + 5 * to[1]))
        x, y = to
    return out


ROUNDS, TURNS = _round_constants(), _turns()


def keccak256(items: list[bytes]) -> np.ndarray:
    """Keccak-256 (the padding before SHA-3) of many strings shorter than 136 bytes at once, one row of 32 bytes each."""
    if any(len(b) >= RATE for b in items):
        raise ValueError("one block only")
    block = np.zeros((len(items), 200), dtype=np.uint8)
    for row, b in zip(block, items, strict=True):
        row[: len(b)] = np.frombuffer(b, dtype=np.uint8)
        row[len(b)] ^= 0x01
        row[RATE - 1] ^= 0x80
    lanes = list(block.view("<u8").T.copy())
    turn = lambda v, k: v << np.uint64(k) | v >> np.uint64(64 - k) if k else v
    for constant in ROUNDS:
        columns = [lanes[x] ^ lanes[x + 5] ^ lanes[x + 10] ^ lanes[x + 15] ^ lanes[x + 20] for x in range(5)]
        mixed = [columns[x - 1] ^ turn(columns[(x + 1) % 5], 1) for x in range(5)]
        moved = lanes[:]
        for lane, by, to in TURNS:
            moved[to] = turn(lanes[lane] ^ mixed[lane % 5], by)
        lanes = [moved[k] ^ (~moved[k // 5 * 5 + (k + 1) % 5] & moved[k // 5 * 5 + (k + 2) % 5]) for k in range(25)]
        lanes[0] = lanes[0] ^ np.uint64(constant)
    return np.stack(lanes[:4], axis=1).astype("<u8").view(np.uint8).reshape(len(items), 32)


def _number(digits: str) -> int | None:
    out = 0
    for c in digits:
        if c not in _DIGIT:
            return None
        out = out * 58 + _DIGIT[c]
    return out


def base58check(text: str, versions: tuple[int, ...]) -> bool:
    """25 bytes: a version, 20 more, and four of the double SHA-256 of both."""
    number = _number(text)
    if number is None or number >= 256**CHECKED_BYTES:
        return False
    raw = number.to_bytes(CHECKED_BYTES, "big")
    zeros = len(text) - len(text.lstrip("1"))
    if zeros != len(raw) - len(raw.lstrip(b"\0")):  # each zero byte in front is a 1
        return False
    return raw[0] in versions and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def segwit(text: str) -> bool:
    """bech32 for the first witness version, bech32m for later ones."""
    head, mark, data = text.lower().rpartition("1")
    if not mark or not head or len(data) < 6 or len(text) > BECH32_MOST or any(c not in BECH32 for c in data):
        return False
    state = 1
    for v in [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + [BECH32.index(c) for c in data]:
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ v
        for k, step in enumerate(BECH32_STEPS):
            state ^= step if top >> k & 1 else 0
    return state == (BECH32_OLD if data[0] == BECH32[0] else BECH32_NEW)


def cryptonote(text: str) -> bytes | None:
    """The 69 bytes of a block-wise base58 address: 11 digits for 8 bytes, the rest for 5; null if it is none."""
    width, out = XMR_BLOCK_DIGITS[XMR_BLOCK], b""
    for at in range(0, len(text), width):
        digits = text[at : at + width]
        number = _number(digits)
        if number is None or len(digits) not in XMR_BLOCK_DIGITS:
            return None
        size = XMR_BLOCK_DIGITS.index(len(digits))
        if number >= 256**size:
            return None
        out += number.to_bytes(size, "big")
    return out if len(out) == XMR_BYTES else None


def wallets_ok(kinds: list[str | None], texts: list[str | None]) -> list[bool]:
    """Whether each text is an address of its kind, by the surface form; kinds that are no wallets always are."""
    out, hashed = [], []
    for at, (kind, text) in enumerate(zip(kinds, texts, strict=True)):
        ok = text is not None
        if ok and kind == "wallet_btc":
            ok = segwit(text) if text[:3].lower() == "bc1" else base58check(text, BTC_VERSIONS)
        elif ok and kind == "wallet_tron":
            ok = base58check(text, (TRON_VERSION,))
        elif ok and kind == "wallet_eth":
            body = text[2:]
            ok = text[:2] in ("0x", "0X") and len(body) == 40 and all(c in "0123456789abcdefABCDEF" for c in body)
            if ok and body not in (body.lower(), body.upper()):
                hashed.append((at, body.lower().encode()))
        elif ok and kind == "wallet_xmr":
            raw = cryptonote(text)
            ok = raw is not None
            if ok:
                hashed.append((at, raw[:-4]))
        out.append(ok)
    for (at, data), digest in zip(hashed, keccak256([d for _, d in hashed]), strict=True):
        if kinds[at] == "wallet_xmr":
            out[at] = cryptonote(texts[at])[-4:] == digest[:4].tobytes()
        else:  # letters are upper where the digest's nibble is 8 or more
            nibbles = digest.tobytes().hex()
            out[at] = all(c.isdigit() or c.isupper() == (int(nibble, 16) >= 8) for c, nibble in zip(texts[at][2:], nibbles, strict=False))
    return out


@F.pandas_udf(T.BooleanType())
def wallet_ok(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series(wallets_ok(kinds.tolist(), texts.tolist()), dtype=bool)
