"""The corpus pipeline against a plain version of each of its stages, and as a whole."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sonde.llm.queries import BPE

SF = "/root/testdata/sf0.001"
WS = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in WS.split(t) if w]


def quality(rows):
    """Words, words in five-word windows found twice, and lines in too many distinct texts of a source."""

    def squeezed(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), re.sub("[1-9]", "0", t))
        return [re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line).strip(" ") for line in low.split("\n")]

    texts_of, size = defaultdict(set), Counter()
    for _, t, _, source, _ in rows:
        size[source] += 1
        for line in squeezed(t or ""):
            if line:
                texts_of[source, line].add(t)
    bad = {k for k, v in texts_of.items() if len(v) > max(20, -(-size[k[0]] * 2 // 100))}
    for i, t, lang, source, n in rows:
        w = words(t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = Counter(grams)
        repeat = {k + j for k, g in enumerate(grams) if twice[g] > 1 for j in range(5)}
        gone = sum(len(line.split(" ")) for line in squeezed(t or "") if (source, line) in bad)
        if len(w) < 10 or 100 * len(repeat) > 20 * len(w) or gone and (len(w) - gone < 10 or len(w) - gone < 0.1 * len(w)):
            continue
        if gone:
            t = "\n".join(raw for raw, line in zip(t.split("\n"), squeezed(t), strict=True) if (source, line) not in bad)
            n = len(t)
        yield i, t, lang, source, n


def exact(rows):
    least = {}
    for r in rows:
        least.setdefault(WS.sub(" ", r[1]), []).append(r)
    yield from (min(v) for v in least.values())


def near(rows):
    rows = sorted(rows)

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets, gone = [shingles(r[1]) for r in rows], set()
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    label = list(range(len(rows)))
    links = {(a, b) for v in holders.values() for a in v for b in v if a < b}
    links = [(a, b) for a, b in links if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    gone = {k for k, x in enumerate(label) if x != k}
    yield from (r for k, r in enumerate(rows) if k not in gone)


def repeats(rows, length=400):
    rows = list(rows)
    count = Counter(raw[i : i + length] for raw in (r[1].encode() for r in rows) for i in range(len(raw) - length + 1))
    for i, t, lang, source, n in rows:
        raw = t.encode()
        keep = np.ones(len(raw), dtype=bool)
        for s in range(len(raw) - length + 1):
            if count[raw[s : s + length]] > 1:
                keep[s : s + length] = False
        if keep.all():
            yield i, t, lang, source, n
        elif keep.any():
            left = bytes(b for b, k in zip(raw, keep, strict=True) if k).decode("utf-8", "ignore")
            yield i, left, lang, source, len(left)


PLAIN = {"quality rules": quality, "exact dedup": exact, "simhash near-dedup": near, "suffix-array dedup": repeats}


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    some = real.where("length(text) > 900").orderBy("doc_id").limit(3)
    return real.unionAll(some).unionAll(some.selectExpr("cast(null as long)", "concat(text, ' tail')", "lang", "source", "n_chars"))


def test_stages_one_after_another(spark, docs):
    """Each stage on its predecessor's rows, and packing's pieces against the tokenizer."""
    from tokenizers import Tokenizer

    table = docs
    assert [name for name, _ in corpus_pipeline.STAGES][:-1] == list(PLAIN)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in table.collect()]
        found = stage(spark, table, SF)
        key = lambda r: tuple((x is None, x) for x in r)
        wanted = sorted(PLAIN[name]([(10**9 if r[0] is None else r[0], *r[1:]) for r in before]), key=key)
        got = sorted(((10**9 if r[0] is None else r[0], *tuple(r)[1:]) for r in found.collect()), key=key)
        assert found.columns == docs.columns and got == wanted and 0 < len(got), name
        table = spark.createDataFrame([(None if r[0] == 10**9 else r[0], *r[1:]) for r in got], docs.schema)
    tokenizer = Tokenizer.from_file(BPE[0])
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p["doc_id"], p["doc_tokens"]].append(p)
        of_sequence[p["sequence_id"]].append(p)
    wanted = Counter()
    for r in table.collect():
        ids = tuple(tokenizer.encode(r["text"], add_special_tokens=False).ids + [0])
        wanted[r["doc_id"], ids] += 1
    found = Counter((i, tuple(x for p in sorted(v, key=lambda p: p["start"]) for x in p["ids"])) for (i, _), v in of_doc.items())
    assert found == wanted
    for v in of_sequence.values():
        v.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in v] == [sum(q["length"] for q in v[:k]) for k in range(len(v))] and sum(p["length"] for p in v) <= 1024
    assert sum(sum(p["length"] for p in v) < 1024 for v in of_sequence.values()) <= table.rdd.getNumPartitions()


def test_run_is_its_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
    wanted = Counter((r["doc_id"], r["n"]) for r in corpus_pipeline.STAGES[-1][1](spark, table, SF).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect())
    found = Counter((r["doc_id"], r["n"]) for r in corpus_pipeline.run(spark, SF).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect())
    assert found == wanted
