"""Observations against one plain pass over each author's messages; counts folded in slices and replayed; empty and odd input."""

import hashlib
import math
import random
import re
import statistics
import tempfile
from collections import Counter
from datetime import UTC, datetime

import pytest

from sonde.functions.vectorised import simhash64
from sonde.operators import primitives as ops

SHAPE = "actor string, id long, us long, text string, opened boolean"
MARKERS = {"rio": ["che", "vos", "pibe"], "norte": ["vale", "tío"]}
START = 1_700_000_000_000_000


def words_of(rnd, lang):
    own = {"en": "the of and to in market ships harbour winter letter".split(), "es": "de la que el en los puerto camino noche piedra canción che vos".split()}[lang]
    many = [f"{a}{b}" for a in ("lum", "ber", "tor", "sal") for b in ("ana", "ido", "eña", "ura", "osa")]
    return [rnd.choice(own if rnd.random() < 0.5 else many) for _ in range(rnd.randint(0, 60))]


@pytest.fixture(scope="module")
def messages():
    rnd, out = random.Random(5), []
    for actor, lang, n in (("a", "en", 120), ("b", "es", 70), ("c", "es", 12), ("d", "en", 3)):
        for k in range(n):
            words = words_of(rnd, lang)
            if actor == "b":
                words += ["camino"] * 2 + (["camimo", "caminos"] if k % 15 == 0 else [])
            text = None if k % 11 == 7 else " ".join(words) + rnd.choice(["...", "!", "!!", "? ", ".", " (so); it's - \"x\" 3.5", ""])
            out.append((actor, len(out), START + rnd.randrange(40) * 43_200_000_000 + rnd.randrange(10) * 600_000_000, text, rnd.choice([True, False, None])))
    out.append(("e", 900, START, "", True))
    return out + [(None, 901, START, "lost", True), ("f", 902, None, "lost", True), out[0]]


def plain(rows):
    """{(actor, primitive): (value, confidence)}, for signatures and texts the text, for numbers the number."""
    out = {}
    for actor in {r[0] for r in rows} - {None}:
        mine = sorted((r for r in rows if r[0] == actor and r[2] is not None), key=lambda r: (r[2], r[1]))
        if not mine:
            continue
        add = lambda name, value, sure: out.__setitem__((actor, name), (value, round(sure, 6)))  # noqa: B023, E731
        total, texts = len(mine), [r[3] for r in mine if r[3] is not None]
        at = [datetime.fromtimestamp(r[2] / 1e6, UTC) for r in mine]
        days, span = len({t.date() for t in at}), (mine[-1][2] - mine[0][2]) / 86_400e6
        tier = "high" if total >= 100 and days >= 7 else "medium" if total >= 30 and days >= 2 else "low"
        sure = {"low": 0.3, "medium": 0.6, "high": 0.9}[tier]
        meta = {"total_messages": total, "corpus_span_days": span, "active_days": days, "first_seen_ts": mine[0][2] / 1e6, "last_seen_ts": mine[-1][2] / 1e6}
        if span:
            meta |= {"msg_per_day": total / span, "activity_density": min(1, days / span)}
        for name, value in meta.items():
            add(f"meta.{name}", value, sure)
        add("meta.fingerprint_confidence", tier, sure)
        for name, bins, key in (("hour", 24, lambda t: t.hour), ("dow", 7, lambda t: t.weekday()), ("hour_dow", 168, lambda t: t.weekday() * 24 + t.hour)):
            n = Counter(map(key, at))
            add(f"circadian.{name}_histogram", ",".join(str(math.floor(n[b] / total * 1e6 + 0.5)) for b in range(bins)), sure)
        if total >= 10:
            add("interaction.conversation_initiation_rate", sum(bool(r[4]) for r in mine) / total, min(1, total / 50))
        sizes = [len(t.split()) for t in texts]
        if len(sizes) >= 5:
            mid, mean = statistics.median(sizes), statistics.mean(sizes)
            cv = statistics.stdev(sizes) / mean if mean else 0
            add("stylometric.message_length_class", "short" if mid <= 5 else "medium" if mid <= 20 else "long" if mid <= 50 else "paragraph", min(1, total / 50))
            add("stylometric.message_length_variance_class", "tight" if cv < 0.5 else "varied" if cv < 1.5 else "bimodal", min(1, total / 50))
        tokens = [re.findall(ops.TOKEN, t.lower()) for t in texts]
        n_tokens = sum(map(len, tokens))
        if texts and (len(texts) >= 30 or n_tokens >= 500):
            votes = {k: sum(len(set(t) & set(v)) for t in tokens) for k, v in ops.FUNCTION_WORDS.items()}
            listed = ops.FUNCTION_WORDS["es" if votes["es"] > votes["en"] else "en"]
            add("stylometric.function_word_distribution_top50", simhash64(Counter(w for t in tokens for w in t if w in listed)), min(1, n_tokens / 2000))
        if sum(sizes) >= 200:
            grams = Counter(t.lower()[i : i + 3] for t in texts for i in range(len(t) - 2))
            add("stylometric.character_ngram_simhash", simhash64(grams), min(1, sum(sizes) / 1000))
        words = [re.findall(ops.WORD, t.lower()) for t in texts]
        df, tf = Counter(w for t in words for w in set(t)), Counter(w for t in words for w in t)
        if len(texts) >= 50:
            score = {w: n * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w, n in tf.items()}
            best = sorted(score, key=lambda w: (-score[w], w))[:50]
            add("stylometric.distinctive_vocabulary_signature", simhash64({w: score[w] for w in best}), min(1, len(texts) / 200))
        if len(texts) >= 10 and len(" ".join(texts)) >= 200:
            marks = {k: len(re.findall(p, "".join(t + " " for t in texts))) for k, p in ops.MARKS.items()}
            add("stylometric.punctuation_style", simhash64({k: n for k, n in marks.items() if n}), min(1, len(texts) / 50))
        often = {w: n for w, n in df.items() if n >= 3}
        if len(texts) >= 15 and len(often) >= 20:
            typos = sorted(v for v in often if any(often[u] >= 5 * often[v] and one_edit(u, v) for u in often))
            assert typos == (["camimo", "caminos"] if actor == "b" else [])
            add("stylometric.typo_signature", hashlib.sha256(",".join(typos).encode()).hexdigest()[:16], min(1, len(texts) / 100))
        used = {w for t in tokens for w in t}
        if len(texts) >= 10 and n_tokens and len(used & set(ops.FUNCTION_WORDS["es"][:17])) >= len(used & set(ops.FUNCTION_WORDS["en"][:17])):
            hits = sorted(((len(used & set(m)), r) for r, m in MARKERS.items() if used & set(m)), reverse=True)
            rate = hits[0][0] / n_tokens if hits else 0
            if rate < 0.001:
                add("lexical.dialect_region", "unknown", 0)
            elif len(hits) > 1 and hits[0][0] < 1.8 * hits[1][0]:
                add("lexical.dialect_region", "unknown", hits[0][0] / (hits[0][0] + hits[1][0]))
            else:
                add("lexical.dialect_region", hits[0][1], min(1, rate * 500))
        flat = [w for t in texts for w in t.lower().split()]
        if len(flat) >= 100:
            ratios = [len(set(flat[i : i + 50])) / 50 for i in range(len(flat) - 49)]
            add("lexical.vocabulary_richness", statistics.mean(ratios), min(1, len(flat) / 1000))
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def check(found, wanted):
    got = {(r["actor"], r["primitive"]): r for r in found if r["primitive"] != "circadian.quiet_span_utc"}
    assert set(got) == set(wanted)
    for key, (value, sure) in wanted.items():
        r = got[key]
        assert (r["value_text"] == value) if isinstance(value, str) else r["value_numeric"] == pytest.approx(value, abs=2e-6), key
        assert r["confidence"] == pytest.approx(sure, abs=2e-6), key


def test_every_primitive_by_a_plain_pass(spark, messages):
    rows = spark.createDataFrame(messages, SHAPE)
    found = ops.observations(ops.states(rows), MARKERS).unionByName(ops.richness(rows, block=128)).collect()
    wanted = plain(messages)
    check(found, wanted)
    assert len({name for _, name in wanted} | {"circadian.quiet_span_utc"}) == 22
    last = {r["evidence_id"] for r in found if r["actor"] == "b" and r["evidence_id"] is not None}
    assert last == {max((r for r in messages if r[0] == "b"), key=lambda r: (r[2], r[1]))[1]}


def test_counts_folded_in_slices_and_once_each(spark, messages):
    stored = ops.Folded(spark, tempfile.mkdtemp(prefix="spark-"))
    for batch in range(3):
        part = spark.createDataFrame(messages[batch::3], SHAPE)
        assert stored.fold(part, batch)
        assert not stored.fold(part, batch)
    whole = ops.states(spark.createDataFrame(messages, SHAPE))
    assert sorted(map(tuple, stored.state().collect())) == sorted(map(tuple, whole.collect()))


def test_no_messages_and_columns_of_any_name(spark, messages):
    nothing = spark.createDataFrame([], SHAPE)
    assert not ops.observations(ops.states(nothing), MARKERS).unionByName(ops.richness(nothing)).take(1)
    odd = spark.createDataFrame([(*r, 1, "x", 2) for r in messages[:20]], SHAPE + ", n int, kind string, block int")
    assert sorted(map(tuple, ops.states(odd).collect())) == sorted(map(tuple, ops.states(odd.select("actor", "id", "us", "text", "opened")).collect()))
    ops.richness(odd).collect()
