"""Every query with SQL against DuckDB on the smallest tables; the others against plain mirrors or bounds."""

import re

import pandas as pd
import pytest
from compare import duck, rows

from sonde.queries import lexical, load_all

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load_all()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    found = QUERIES[name](spark, SF).toPandas()
    wanted = duck(SF, SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_approx_distinct_is_near(spark):
    exact = table("lineitem")["l_orderkey"].nunique()
    assert abs(QUERIES["approx_distinct"](spark, SF).first()["orders"] - exact) <= 0.05 * exact


def test_author_signatures_by_votes(spark):
    """FNV-1a and the votes of its bits, one trigram at a time."""

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    docs = table("documents")
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    found = {r["doc_id"]: r["signature"] for r in QUERIES["author_signatures"](spark, SF).collect()}
    assert set(found) == set(texts)
    for i in sorted((i for i, t in texts.items() if t is not None), key=lambda i: len(texts[i]))[:40]:
        t, votes = texts[i].lower(), [0] * 64
        for k in range(len(t) - 2):
            h = fnv(t[k : k + 3].encode())
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        assert found[i] == f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"


def test_look_around_rates(spark):
    docs = table("documents").dropna(subset=["text"])
    found = {r["source"]: r for r in QUERIES["punctuation_look_around"](spark, SF).collect()}
    for source, part in docs.groupby("source"):
        chars = part["text"].str.len().sum()
        for name, pattern in lexical.LOOK_AROUND.items():
            n = sum(len(re.findall(pattern, t)) for t in part["text"])
            assert found[source][name] == pytest.approx(n / chars, abs=2e-6)


def test_style_signatures_by_votes(spark):
    """Both kinds of signature worked out anew from the texts, and the floors on the number of texts."""
    import math
    from collections import Counter

    from sonde.functions.vectorised import simhash64

    docs = table("documents").dropna(subset=["source"])
    found = {(r["source"], r["kind"]): (r["signature"], r["confidence"]) for r in QUERIES["style_signatures"](spark, SF).collect()}
    tokens = {i: [w for w in re.split("[^a-zà-öø-ÿ]+", (t or "").lower()) if w] for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    df = Counter(w for ws in tokens.values() for w in set(ws))
    wanted = {}
    for source, part in docs.groupby("source"):
        texts = [t for t in part["text"] if t is not None]
        chars = sum(map(len, texts))
        rates = {n: sum(len(re.findall(p, t)) for t in texts) / max(chars, 1) for n, p in (lexical.MARKS | lexical.LOOK_AROUND).items()}
        if len(texts) >= 10 and chars >= 200 and any(rates.values()):
            wanted[source, "punctuation"] = (simhash64({n: r for n, r in rates.items() if r}), min(1.0, len(texts) / 50))
        if len(texts) >= 50:
            tf = Counter(w for i in part["doc_id"] for w in tokens[i])
            total = sum(tf.values())
            score = {w: round(n / total * (math.log((len(docs) + 1) / (df[w] + 1)) + 1), 9) for w, n in tf.items()}
            best = sorted(score, key=lambda w: (-score[w], w))[:50]
            wanted[source, "vocabulary"] = (simhash64({w: score[w] for w in best}), min(1.0, len(texts) / 200))
    assert found == wanted and {k for _, k in found} >= {"punctuation"}


def test_wallets_need_their_checksum(spark):
    keys = {r["c_custkey"] for r in QUERIES["wallet_indicators"](spark, SF).collect()}
    assert keys == {int(k) for k in table("customer")["c_custkey"] if k % 3 == 0}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
