"""Comparators and verifiers against plain versions, with unknown languages, switched-off ones, missing slots and equal ones."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sonde.functions import vectorised as vx
from sonde.operators import compare
from sonde.plans.ship import ship

COMPARATORS = (compare.Comparator("near", "s", 6, {"es": None, "de": 9, "xx": 0}), compare.Comparator("other", "t", 3))
ROW = "actor string, lang string, words long, s long, t long, v array<double>, extra string, a string"


@pytest.fixture(scope="module")
def profiles():
    rng = random.Random(5)
    out = []
    for lang in ("en", "es", "de", "xx", None):
        base = rng.getrandbits(62)
        for k in range(14):
            s = base
            for _ in range(rng.randint(0, 6)):
                s ^= 1 << rng.randrange(62)
            t = None if k % 5 == 0 else rng.choice((7, 7, -1, s))
            out.append((f"{lang}{k:02}", lang, rng.choice((50, 500, 5000)), s, t, [rng.random() for _ in range(4)] if k % 7 else [0.0] * 4, "e", "clash"))
    return out


def plain_pairs(profiles):
    """Classes of equal slots, all pairs of their smallest keys, and members with theirs."""
    out = set()
    for c in COMPARATORS:
        at = 3 if c.slot == "s" else 4
        classes = defaultdict(list)
        for p in profiles:
            if p[at] is not None:
                classes[p[1], p[at]].append(p[0])
        limit = {lang: c.by_language.get(lang, c.most) for lang, _ in classes}
        near = [(lang, min(v), x, 0) for (lang, _), v in classes.items() for x in v if x != min(v)]
        near += [(la, *sorted((min(v), min(w))), ((x ^ y) & (1 << 64) - 1).bit_count()) for (la, x), v in classes.items() for (lb, y), w in classes.items() if la == lb and min(v) < min(w)]
        for lang, a, b, d in near:
            if limit[lang] is not None and d <= limit[lang]:
                out.add((a, b, lang, c.name, d, round(1 - d / limit[lang], 4) if limit[lang] else 1.0))
    return out


def test_pairs_by_language(spark, profiles):
    found = compare.propose(spark.createDataFrame(profiles, ROW), "actor", "lang", COMPARATORS).collect()
    wanted = plain_pairs(profiles)
    assert len(found) == len(set(map(tuple, found))) and {tuple(r) for r in found} == wanted
    langs = {(r["lang"], r["comparator"]) for r in found}
    assert ("es", "near") not in langs and ("es", "other") in langs and (None, "near") in langs


def test_verdicts(spark, profiles):
    """Means over verifiers with any confidence; a pair that none can judge gives no row."""
    verifiers = (
        compare.Verifier("cosine", compare.cosine("v"), compare.by_words(100, 1000), off=("de",)),
        compare.Verifier("overlap", compare.weighted_jaccard("v"), compare.by_words(1000, 9000), needs_language=True),
    )
    held = {p[0]: p for p in profiles}
    pairs = {(a, b, lang) for a, b, lang, *_ in plain_pairs(profiles)}
    wanted = {}
    for a, b, lang in pairs:
        x, y, n = held[a][5], held[b][5], min(held[a][2], held[b][2])
        size = math.hypot(*x) * math.hypot(*y)
        scores = {}
        if n >= 100 and lang != "de":
            scores["cosine"] = sum(p * q for p, q in zip(x, y, strict=True)) / size if size else 0.0
        if n >= 1000 and lang is not None:
            most = sum(map(max, x, y))
            scores["overlap"] = sum(map(min, x, y)) / most if most else 0.0
        if scores:
            mean = sum(scores.values()) / len(scores)
            wanted[a, b] = ({k: round(v, 9) for k, v in scores.items()}, len(scores), round(mean, 9), "suspected" if mean >= 0.7 else "below_floor")
    df = spark.createDataFrame(profiles, ROW)
    found = compare.verify(compare.propose(df, "actor", "lang", COMPARATORS), df, "actor", verifiers, 0.7).collect()
    assert {(r["a"], r["b"]): ({k: round(v, 9) for k, v in r["scores"].items()}, r["qualified"], round(r["composite"], 9), r["state"]) for r in found} == wanted
    assert len(found) == len(wanted) and {w[3] for w in wanted.values()} == {"suspected", "below_floor"}


def test_word_profiles(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "abcdefg" for b in "xyz"]
    docs = [(rng.choice("pqr"), rng.choice(("en", "de")), " ".join(rng.choices(words, k=rng.randint(0, 60))).upper()) for _ in range(60)]
    docs += [("few", "en", "ax bx"), (None, "en", "ax " * 30), ("p", None, "ax"), ("p", "en", None), ("p", "en", ""), ("long", "en", "zz ax " * 20_000)]
    held, of_all = defaultdict(Counter), defaultdict(Counter)
    for actor, lang, text in docs:
        if actor and lang:
            held[actor, lang].update((text or "").lower().split())
            of_all[lang].update((text or "").lower().split())
    wanted = {}
    for (actor, lang), c in held.items():
        top = [w for w, _ in sorted(of_all[lang].items(), key=lambda x: (-x[1], x[0]))[:20]]
        n, every = sum(c.values()), sum(of_all[lang].values())
        if n >= 50:
            above = [c[w] * every > of_all[lang][w] * n for w in top]
            bits = [sum(1 << k for k, x in enumerate(part) if x) for part in (above[:8], above[8:])]
            wanted[actor, lang] = (n, [round(c[w] / n, 9) for w in top], *bits)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "actor string, lang string, text string, word string, n int")
    found = compare.word_profiles(df, "actor", "lang", "text", function_words=8, content_words=12, least=50).collect()
    got = {(r["actor"], r["lang"]): (r["words"], [round(x, 9) for x in r["function_rates"] + r["content_rates"]], r["function_words"], r["content_words"]) for r in found}
    assert got == wanted and len(found) == len(wanted) and ("long", "en") in got and ("few", "en") not in got


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], ROW)
    pairs = compare.propose(empty, "actor", "lang", COMPARATORS)
    assert pairs.count() == 0 and compare.verify(pairs, empty, "actor", (), 0.5).count() == 0
    docs = spark.createDataFrame([], "actor string, lang string, text string")
    assert compare.word_profiles(docs, "actor", "lang", "text").count() == 0


def test_texts_are_composed(spark):
    ship(spark)
    texts = ["plain", "über", "Å", "é" * 5000, "가", "", None, "x̣̀", "été ˿"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: r["c"] for r in df.select("i", vx.composed(F.col("t")).alias("c")).collect()}
    assert found == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
