"""What messages mention: handles, hosts, addresses, channels and typed indicators, as arrays of expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.functions.addresses import wallets_ok
from sonde.functions.text import url_host

HANDLE = r"(?<![A-Za-z0-9_])@([A-Za-z][A-Za-z0-9_]{2,31})"
URL = r"(?i)\bhttps?://[^\s<>\"')\]]+"
ONION = r"(?i)\b[a-z2-7]{16,56}\.onion\b"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])"
DOMAIN = r"(?i)(?<![@\w./-])((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z][a-z0-9-]{0,61}[a-z0-9])(?![@\w])"
#: Last labels that make a bare dotted name a domain; a parameter, as the public list is not at hand here.
TLDS = ("com", "org", "net", "info", "io", "uk", "de", "fr", "es", "cl", "mx", "ar", "br", "ru", "gov", "edu", "mil")
#: Kinds of indicators, their patterns (group 1 if there is one) and whether case is folded.
INDICATORS = (
    ("handle_other_platform", r"(?:\A|[^\w.%+-])@([A-Za-z0-9_]{4,32})\b", True),
    ("wallet_eth", r"\b0x[a-fA-F0-9]{40}\b", True),
    ("wallet_tron", r"\bT[1-9A-HJ-NP-Za-km-z]{33}\b", False),
    ("wallet_btc", r"\b[13][1-9A-HJ-NP-Za-km-z]{25,34}\b", False),
    ("wallet_btc", r"\bbc1[a-z0-9]{25,62}\b", True),
    ("wallet_xmr", r"\b[48][0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b", False),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", True),
    ("pgp_key", r"-----BEGIN PGP (?:PUBLIC KEY|PRIVATE KEY|SIGNATURE) BLOCK-----[\s\S]+?-----END PGP (?:PUBLIC KEY|PRIVATE KEY|SIGNATURE) BLOCK-----", False),
    ("session", r"\b05[0-9a-f]{64}\b", True),
    ("tox", r"\b[0-9A-Fa-f]{76}\b", True),
)
#: Handles that name no one.
NO_HANDLES = ("admin", "everyone", "channel", "all", "here")
#: How groups are named in messages, from the platforms' rules of names: invites, public links, handles, room aliases.
CHANNELS = {
    "invite": r"(?i)(?:https?://)?t\.me/(?:joinchat/|\+)([A-Za-z0-9_-]{8,})",
    "public": r"(?i)(?:https?://)?t\.me/([A-Za-z][A-Za-z0-9_]{3,31})\b",
    "handle": r"(?<![\w/])@([A-Za-z][A-Za-z0-9_]{4,31})\b",
    "room": r"(?:https?://matrix\.to/#/)?(#[A-Za-z0-9._=\-/]+:[A-Za-z0-9.\-]+\.[A-Za-z]{2,})",
}
#: Lines with the shape of a statement of a database dump, where @names are variables; a first word alone does not tell.
STATEMENT = (
    r"(?i)^\s*(?:/\*![0-9]*\s*)?(?:set\s+(?:@|(?:global|session|names|character)\s|\w+\s*=)|insert\s+(?:ignore\s+)?into\s|delete\s+from\s|update\s+[`\w.]+\s+set\s"
    r"|(?:create|alter|drop)\s+(?:or\s+replace\s+|temporary\s+|unique\s+)*(?:table|database|schema|view|index|trigger|procedure|function|user|event)\b"
    r"|use\s+[`\w]+\s*;?\s*(?:\*/\s*;?\s*)?$|(?:un)?lock\s+tables?\b)"
)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def handles(text: Column) -> Column:
    """Distinct lower-cased @handles; an @ after a word character is part of an address."""
    return F.array_distinct(F.transform(_all(text, HANDLE, 1), F.lower))


def host_name(host: Column) -> Column:
    """Lower case without white space at the ends and one trailing dot; null if empty or half converted to ASCII."""
    plain = F.regexp_replace(F.btrim(F.lower(host)), r"\.$", "")
    mixed = F.contains(plain, F.lit("xn--")) & F.regexp_like(plain, F.lit(r"[^\x00-\x7F]"))
    return F.when((plain != "") & ~mixed, plain)


def ip_ok(ip: Column) -> Column:
    """Four numbers up to 255 without leading zeros, not all zero."""
    parts = F.split(ip, r"\.")
    return F.forall(parts, lambda p: (p.try_cast("int") <= 255) & ~F.regexp_like(p, F.lit("^0[0-9]"))) & (ip != "0.0.0.0")


def _named(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def artifacts(text: Column, tlds: tuple[str, ...] = TLDS) -> Column:
    """Distinct (kind, value): url, domain, onion and ipv4 of a message."""
    urls = F.transform(_all(text, URL), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    hosts = F.filter(F.transform(urls, lambda u: host_name(url_host(u))), lambda h: h.isNotNull())
    is_ip = lambda h: F.regexp_like(h, F.lit(r"^[0-9.]+$"))
    onion = lambda h: F.endswith(h, F.lit(".onion"))
    bare = F.filter(F.transform(_all(text, DOMAIN, 1), F.lower), lambda d: ~onion(d) & F.element_at(F.split(d, r"\."), -1).isin(*tlds))
    found = [
        _named("url", F.transform(urls, lambda u: F.concat(F.lower(F.regexp_extract(u, "^[^:]+://[^/?#]*", 0)), F.regexp_replace(u, "^[^:]+://[^/?#]*|#.*$", "")))),
        _named("domain", F.filter(hosts, lambda h: ~onion(h) & ~is_ip(h))),
        _named("onion", F.concat(F.filter(hosts, onion), F.transform(_all(text, ONION), F.lower))),
        _named("domain", bare),
        _named("ipv4", F.filter(_all(text, IPV4), ip_ok)),
    ]
    return F.array_distinct(F.concat(*found))


def channels(text: Column) -> Column:
    """Distinct (kind, group): invite links, public links, handles outside of dump lines, and room aliases."""
    calm = F.array_join(F.filter(F.split(text, r"\R"), lambda line: ~F.regexp_like(line, F.lit(STATEMENT))), "\n")
    pattern = {name: ascii_boundaries(p) for name, p in CHANNELS.items()}
    named = F.concat(_all(text, pattern["public"], 1), _all(calm, pattern["handle"], 1))
    found = F.concat(
        _named("invite_link", F.transform(_all(text, pattern["invite"], 1), lambda h: F.concat(F.lit("joinchat:"), h))),
        _named("username_mention", F.transform(named, lambda n: F.concat(F.lit("@"), F.lower(n)))),
        _named("username_mention", F.transform(_all(text, pattern["room"], 1), F.lower)),
    )
    return F.array_distinct(found)


def ascii_boundaries(pattern: str) -> str:
    """The pattern with \\b between ASCII word characters and others only, as its \\w; Java's own \\b also knows accented letters."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


#: What a text must hold for a kind of indicator; a look for it is far cheaper than the pattern.
HELD = {"handle_other_platform": "@", "email": "@", "wallet_eth": "0x", "pgp_key": "-----BEGIN PGP ", "session": "05"}


def _forms(text: str, rules: list[tuple[int, str, bool, re.Pattern]]) -> list[tuple]:
    """(kind, value, raw, at, rank, n): each rule's surface forms in a text, where the first of each stands and how often it occurs."""
    out = []
    for rank, kind, fold, pattern in rules:
        if kind in HELD and HELD[kind] not in text:
            continue
        forms: dict[str, list[int]] = {}
        for m in pattern.finditer(text):
            raw = m.group(1 if pattern.groups else 0)
            if raw in forms:
                forms[raw][1] += 1
            elif raw:  # a group stands where its text first does within the match
                forms[raw] = [m.start() + m.group().index(raw), 1]
        for raw, (at, n) in forms.items():
            value = raw.lower() if fold else raw
            if kind != INDICATORS[0][0] or value not in NO_HANDLES:
                out.append((kind, value, raw, at, rank, n))
    return out


def _finder(rules: list[tuple]):
    """Batches of (key, text) -> a text's indicators, by patterns with ASCII classes: the first of the first rule for each value, wallets by their checksum."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(rank, kind, fold, re.compile(pattern, re.ASCII)) for rank, (kind, pattern, fold) in enumerate(rules)]
        for batch in batches:
            rows = [(i, *form) for i, text in enumerate(batch.column(1).to_pylist()) if text for form in _forms(text, compiled)]
            if any(kind.startswith("wallet_") for kind, _, _ in rules):
                rows = [row for row, ok in zip(rows, wallets_ok([r[1] for r in rows], [r[3] for r in rows]), strict=True) if ok]
            first: dict[tuple, tuple] = {}
            for row in rows:
                name = row[:3]
                if name not in first or (row[5], row[4]) < (first[name][5], first[name][4]):
                    first[name] = row
            columns = list(zip(*first.values(), strict=True)) or [()] * 7
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
            keys = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns[1:], types)], [batch.schema.names[0], "kind", "value", "raw", "at", "rank", "n"])

    return find


def indicators(docs: DataFrame, key: str, text: str, rules=INDICATORS, most: int | None = None, repeats: bool = False) -> DataFrame:
    """(key, kind, value, raw, at): the distinct indicators of each text; of equal ones the first of the first rule that finds it.

    value folds case where the rule does; raw is the surface form and at its place, from 0, that of the group where the rule has one.
    Wallets must bear their checksum. most: only so many characters of a text, as a bound on cost; all of them unless it is given.
    repeats: an equal row for each time that the surface form occurs.
    """
    head = F.substring(F.col(text), 1, most) if most else F.col(text)
    found = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, T.StringType()) for n in ("kind", "value", "raw")]])
    found = found.add("at", T.IntegerType()).add("rank", T.IntegerType()).add("n", T.LongType())
    rows = docs.select(key, head.alias("__text")).mapInArrow(_finder(list(rules)), found)
    if repeats:
        rows = rows.groupBy(key, "kind", "value", "raw").agg(F.min(F.struct("rank", "at")).alias("place"), F.sum("n").alias("n")).select(key, "kind", "value", "raw", "place.rank", "place.at", "n")
    first = rows.groupBy(key, "kind", "value").agg(F.min_by(F.struct("raw", "at", "n"), F.struct("rank", "at")).alias("first"))
    if repeats:
        first = first.select("*", F.explode(F.sequence(F.lit(1), F.col("first.n"))))
    return first.select(key, "kind", "value", "first.raw", "first.at")


def parsed_pairs(text: Column, between: str = r"[=:]") -> Column:
    """Key and value of each line `key = value`; comments, sections and lines without a key give nothing; the last value of a key holds."""
    lines = F.filter(F.split(text, "\r?\n"), lambda line: F.regexp_like(line, F.lit(rf"^\s*[^#;\[\s=:][^=:]*{between}")))
    pair = lambda line: F.struct(F.btrim(F.regexp_extract(line, rf"^([^=:]*){between}", 1)).alias("k"), F.btrim(F.regexp_extract(line, rf"^[^=:]*{between}(.*)$", 1)).alias("v"))
    rows = F.transform(lines, pair)
    last = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda later: later["k"] == r["k"]))
    return F.map_from_entries(last)


def reshaped(fields: Column, rename: dict[str, str], drop: tuple[str, ...], reject: tuple[str, ...]) -> Column:
    """A map with names changed, fields dropped, NUL characters escaped, and values that match a reject pattern left out."""
    renamed = F.transform_keys(fields, lambda k, v: reduce(lambda c, pair: F.when(k == pair[0], pair[1]).otherwise(c), rename.items(), k))
    bad = lambda v: reduce(lambda a, p: a | F.regexp_like(v, F.lit(p)), reject, F.lit(False))
    kept = F.map_filter(renamed, lambda k, v: ~k.isin(*drop) & ~bad(v))
    return F.transform_values(kept, lambda k, v: F.regexp_replace(v, "\\x00", "\\\\\\\\0"))
