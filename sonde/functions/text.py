"""Text expressions over string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[^a-zà-öø-ÿ]+"
#: The masks of the template normaliser.
URL = r"(?i)(?:https?://|t\.me/)\S+"
WALLET = r"\bT[1-9A-HJ-NP-Za-km-z]{33}\b|\b0x[a-fA-F0-9]{40}\b"
HANDLE = r"@[A-Za-z0-9_]+"
#: Look-alike letters and what they are folded to.
LOOK_ALIKE, FOLDED = "аеорсхуіјѕАВЕКМНОРСТХοαρνΟΑΡ", "aeopcxyijsABEKMHOPCTXoapvOAP"


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.filter(F.split(F.lower(c), WORD), lambda w: w != "")


def ngrams(words: Column, n: int, between: str = " ") -> Column:
    """Runs of n neighbours, joined; none where there are fewer. The array is shifted, not indexed, so the work is linear."""
    out = words
    for k in range(1, n):
        shifted = F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0)))
        out = F.zip_with(out, shifted, lambda a, b: F.concat(a, F.lit(between), b))
    return F.filter(out, lambda g: g.isNotNull())


def char_ngrams(c: Column, n: int) -> Column:
    return ngrams(F.split(c, ""), n, "")


def template(c: Column) -> Column:
    """A message with its volatile slots masked: urls, wallets, handles, marks and numbers."""
    t = F.lower(c)
    for pattern, mask in ((URL, " urlx "), (WALLET, " walletx "), (HANDLE, " handlex "), (r"[^\p{L}\p{N}_\s]", " "), (r"\d+", "0"), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, mask)
    return F.btrim(t)


def shape(c: Column, most: int = 200) -> Column:
    """Letters as A, digits as 9, runs of white space as one _, over the first characters."""
    t = F.substring(c, 1, most)
    for pattern, mask in ((r"\p{L}", "A"), (r"[0-9]", "9"), (r"\s+", "_")):
        t = F.regexp_replace(t, pattern, mask)
    return t


def fold_look_alikes(c: Column) -> Column:
    """No look-alike is an ASCII letter, so ASCII texts stay as they are."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, LOOK_ALIKE, FOLDED))


def masked_tail(c: Column, keep: int = 4) -> Column:
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(c) - keep, F.lit(0))), F.right(c, F.lit(keep)))


def glob_pattern(glob: str) -> str:
    """`**` crosses path parts, `*` and `?` do not; anchored at both ends."""
    special = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    out, at = "", 0
    while at < len(glob):
        step = glob[at : at + 2] if glob[at : at + 2] == "**" else glob[at]
        out += special.get(step, step if step.isalnum() or step in "/_-" else "\\" + step)
        at += len(step)
    return f"^{out}$"


def url_host(c: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def registrable(host: Column) -> Column:
    """The last two labels, or three where the last two are a known public suffix."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    two = F.size(labels) >= 2
    return F.when((F.size(labels) >= 3) & last(2).isin(*SUFFIXES), last(3)).when(two, last(2)).otherwise(host)


#: Public suffixes of two labels.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.br", "com.ar", "com.mx", "com.au", "co.jp", "co.in", "com.tr", "gob.mx", "gob.cl", "gob.ar", "edu.mx")


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains: what an `ends with` join can be turned into an equi join on."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_score(distance: Column, threshold: int) -> Column:
    """1 at equality, falling to 0 at the threshold; with threshold 0 only equality scores."""
    if threshold == 0:
        return F.when(distance == 0, 1.0).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), 1 - distance / F.lit(float(threshold))), 4)
