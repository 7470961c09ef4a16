"""Byte-level BPE encoding and decoding of texts by a file of ranks.

Ranks become a model of the tokenizers library: every byte is written as one printable character, and every pair of tokens whose joined
bytes are a token is a merge, in the order of the ranks. The rank rule takes the leftmost pair of least rank; the model takes the first
listed one. They can only differ where one token can be put together in two ways at two places of a word, so a word that holds
no three bytes twice is safe, and any other one is checked against the rank library once. A text is cut before each single space (no match of the
pattern joins a space to what stands before it), and a bounded memory keeps what is known of the cuts; new cuts with a space in front are
put into the model as one text; a text with other spacing is cut into the pattern's matches. Offsets come from the tokens' byte lengths and the text's map of bytes to characters: a
token that begins or ends inside a character covers it whole. Decoding joins the tokens' bytes first and reads
characters after, so those that were split are whole again.

Defined results: null text is the empty text, which has no tokens; repeated rows and null doc_ids stay, row for row; an empty
table gives an empty result; encode() reads no other column, decode() keeps all others. A null list, a null id and one
that is no token stand for no bytes.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.llm.common import texts

#: Texts whose single spaces do not show where matches begin.
ODD = re.compile(r"\s | \s")
#: Cuts up to this length are remembered.
SHORT = 64
#: Three bytes that come again, overlaps included.
TWICE = re.compile(rb"(?s)(?=(...)).+?\1")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def repeats(raw: bytes) -> bool:
    """Whether three bytes stand at two places."""
    if len(raw) <= SHORT:
        return TWICE.search(raw) is not None
    return len({raw[i : i + 3] for i in range(len(raw) - 2)}) < len(raw) - 2


def repeating(raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """repeats() for each of the texts of these sizes that raw holds one after another."""
    out = np.zeros(len(sizes), dtype=bool)
    if len(raw) < 4:
        return out
    own = np.repeat(np.arange(len(sizes)), sizes)
    wide = raw.astype(np.int64)
    key = (own[2:] << 24) | (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    key = np.sort(key[own[2:] == own[:-2]])
    out[key[1:][key[1:] == key[:-1]] >> 24] = True
    return out


class Codec:
    """Texts to ids and back, with a memory of at most `most` cuts."""

    def __init__(self, path: str, pattern: str, most: int = 200_000) -> None:
        import tiktoken
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        characters = byte_characters()
        self.shown = {token: "".join(map(characters.__getitem__, token)) for token in ranks}
        merges = [
            (self.shown[token[:at]], self.shown[token[at:]])
            for token in sorted(ranks, key=ranks.get)
            for at in range(1, len(token))
            if token[:at] in ranks and token[at:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={self.shown[t]: rank for t, rank in ranks.items()}, merges=merges))
        split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.by_rank = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the byte table, reversed: what the model's own spelling of each id stands for
        back = {c: b for b, c in enumerate(characters)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for spelled, at in self.tokenizer.get_vocab().items():
            self.bytes_of[at] = bytes(map(back.__getitem__, spelled))
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.most, self.known = most, {}

    def _new(self, cuts: list[str]) -> list[bytes]:
        """Ids of cuts that are not in memory, by the model, checked where the model's order of merges could tell.

        Cuts that begin with a space which no other white space touches make one text, so that the model is called once for all.
        """
        out = [b""] * len(cuts)
        joined = [i for i, c in enumerate(cuts) if c[:1] == " " and c[1:2].strip() and c[-1].strip()]
        text = "".join([cuts[i] for i in joined])
        sizes = np.fromiter((len(cuts[i].encode()) for i in joined), dtype=np.int64, count=len(joined))
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else [], dtype=np.int32)
        token_ends, cut_ends = np.cumsum(self.lengths[ids]), np.cumsum(sizes)
        last = np.searchsorted(token_ends, cut_ends)
        if len(joined) and not np.array_equal(token_ends[np.minimum(last, len(ids) - 1)], cut_ends):  # a token across two cuts
            raise ValueError("the pattern joins a space to what stands before it")
        raw, spans = ids.tobytes(), (4 * np.concatenate([[0], last + 1])).tolist()
        for k, i in enumerate(joined):
            out[i] = raw[spans[k] : spans[k + 1]]
        for k in np.flatnonzero(repeating(np.frombuffer(text.encode(), dtype=np.uint8), sizes)).tolist():
            out[joined[k]] = self._by_rank(cuts[joined[k]])
        alone = sorted(set(range(len(cuts))).difference(joined))
        for i, found in zip(alone, self.tokenizer.encode_batch_fast([cuts[i] for i in alone], add_special_tokens=False) if alone else [], strict=True):
            out[i] = self._by_rank(cuts[i]) if repeats(cuts[i].encode()) else array("i", found.ids).tobytes()
        return out

    def _by_rank(self, cut: str) -> bytes:
        return array("i", self.by_rank.encode_ordinary(cut)).tobytes()

    def _keys(self, text: str) -> list[str]:
        """The cuts of a text as keys of the memory: a cut that begins with a single space without it, any other one after a line feed."""
        if ODD.search(text):
            cuts = [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            return [c[1:] if c[0] == " " and not c[1:2].isspace() else "\n" + c for c in cuts]
        keys = text.split(" ")
        if keys[0]:
            keys[0] = "\n" + keys[0]
            return keys
        return keys[1:]

    def encode(self, items: list[str]) -> list[np.ndarray]:
        keys = [self._keys(t) for t in items]
        every = list(chain.from_iterable(keys))
        found = list(map(self.known.get, every))
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh = list(dict.fromkeys([every[i] for i in missing]))
        learned = dict(zip(fresh, self._new([k[1:] if k[:1] == "\n" else " " + k for k in fresh]), strict=True))
        for i in missing:
            found[i] = learned[every[i]]
        for k, ids in learned.items():  # what is met first stays: frequent cuts are among it
            if len(self.known) >= self.most:
                break
            if len(k) <= SHORT:
                self.known[k] = ids
        ends = [0, *accumulate(map(len, keys))]
        return [np.frombuffer(b"".join(found[a:b]), dtype=np.int32) for a, b in pairwise(ends)]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token; one that begins or ends inside a character covers it whole."""
        if not len(ids):
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.lengths[ids])
        return character[ends - self.lengths[ids]].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)

    def decode(self, ids: list[int | None] | None) -> bytes:
        known, n = self.bytes_of, len(self.bytes_of)
        return b"".join([known[i] for i in ids or () if i is not None and 0 <= i < n])

    def decode_all(self, lists: pa.ListArray) -> list[bytes]:
        """decode() of each list; lists without nulls and strange ids are not looked at one id at a time."""
        values, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))])
        flat = values.to_numpy(zero_copy_only=False)
        if values.null_count or len(flat) and not 0 <= flat.min() <= flat.max() < len(self.bytes_of):
            return [self.decode(i) for i in lists.to_pylist()]
        found = list(map(self.bytes_of.__getitem__, flat.tolist()))
        return [b"".join(found[a:b]) for a, b in pairwise(ends.tolist())]


@cache
def codec(path: str, pattern: str) -> Codec:
    """One model and one memory for all tasks of a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Codec(path, pattern)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *parts])))


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and, unless they are not wanted, start and end: each token's first character and the one after its last."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, model = batch.column("text").to_pylist(), codec(path, pattern)
            for at in range(0, len(items), 256):
                part = items[at : at + 256]
                ids = model.encode(part)
                columns = [batch.column("doc_id").slice(at, len(part)), pa.array([len(i) for i in ids], pa.int64()), _lists(ids)]
                if offsets:
                    places = [model.offsets(t, i) for t, i in zip(part, ids, strict=True)]
                    columns += [_lists([p[0] for p in places]), _lists([p[1] for p in places])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "start", "end"][: len(columns)])

    kinds = "doc_id long, n_tokens long, ids array<int>" + (", start array<int>, end array<int>" if offsets else "")
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(fold, kinds)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the bytes that `ids` stand for in the binary column `to`, which replaces one of that name."""
    kept = encoded.drop(to)
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.BinaryType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = codec(path, pattern)
            found = pa.array(model.decode_all(batch.column(ids)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, to])

    return kept.mapInArrow(fold, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes the ids stand for)."""
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    found = decode(encode(docs, path, pattern, offsets=False), path, pattern)
    return found.select("doc_id", "n_tokens", digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
