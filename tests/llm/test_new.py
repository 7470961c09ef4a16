"""Whitening, spelling variants and byte-level BPE against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import duck, rows

from sonde.llm import bpe, queries, spelling, whitening
from sonde.plans.ship import ship

MULTI = queries.MULTI
VECTORS = "vec_id long, embedding array<float>, label int, n long, component string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# --- whitening ---


def plain_whitening(data, components):
    """Exact sums and deviations, the covariance by loops over exact fractions rounded once."""
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in data]
    n, width = len(x), len(x[0][1])
    sums = [sum(v[k] for _, v in x) for k in range(width)]
    scaled = [[n * v[k] - sums[k] for k in range(width)] for _, v in x]
    cov = np.array([[sum(r[a] * r[b] for r in scaled) / n**3 for b in range(width)] for a in range(width)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = np.array(scaled, dtype=float) / n @ vectors[:, :components] / np.sqrt(values[:components])
    return n, {i: sum(s * s for s in r) for (i, _), r in zip(x, scaled, strict=True)}, values / values.sum(), {i: w for (i, _), w in zip(x, white, strict=True)}


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(5)
    good = [(i, (rng.normal(size=12) * np.arange(1, 13) + 3).tolist()) for i in range(90)]
    bad = [(900, None), (901, [None] + [1.0] * 11), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, [1.0] * 5), (905, []), (906, [3e38] * 12)]
    df = spark.createDataFrame([(i, v, 1, 7, "x") for i, v in good + bad], VECTORS).repartition(7)
    found = whitening.whiten(df, 8).collect()
    n, deviation, explained, white = plain_whitening(good, 8)
    assert len(found) == n * 8 and {r["vec_id"] for r in found} == set(range(90))
    signs = {r["component"]: np.sign(r["whitened"] * white[0][r["component"] - 1]) for r in found if r["vec_id"] == 0}
    for r in found:
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(explained[k], rel=1e-9)
        assert r["whitened"] * signs[k + 1] == pytest.approx(white[r["vec_id"]][k], abs=1e-8)
        assert r["identity_error"] < 1e-9


def test_whitening_is_measured_not_assumed(spark):
    """A model fitted on other rows leaves an error."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, (rng.normal(size=4) * (1 + i % 3)).tolist(), 0, 0, "") for i in range(60)], VECTORS)
    model = whitening.fit(df)
    assert whitening.identity_error(df, model, 4) < 1e-9
    assert whitening.identity_error(df.where("vec_id % 3 = 2"), model, 4) > 0.1


@pytest.mark.parametrize("data", [[], [(1, [])], [(1, None)]])
def test_whitening_of_nothing(spark, data):
    assert whitening.whiten(spark.createDataFrame([(i, v, 0, 0, "") for i, v in data], VECTORS)).collect() == []


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, ""), (1, [1.0, 2.0], 0, 0, ""), (None, [1.0, 2.0], 0, 0, "")], VECTORS)
    found = whitening.whiten(same).collect()
    assert len(found) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in found)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0, 0, "") for i in range(5)], VECTORS)
    found = whitening.whiten(line).collect()
    assert len(found) == 10 and all((r["whitened"] is None) == (r["component"] == 2) for r in found)


def test_deviations_beyond_a_long(spark):
    far = spark.createDataFrame([(0, [-4e9, 1.0], 0, 0, ""), (1, [4e9, 1.0], 0, 0, ""), (2, [0.0, 2.0], 0, 0, "")], VECTORS)
    model = whitening.fit(far)
    x = {r: [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for r, v in [(0, [-4e9, 1.0]), (1, [4e9, 1.0]), (2, [0.0, 2.0])]}
    sums = [sum(v[k] for v in x.values()) for k in range(2)]
    wanted = {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}
    assert {r["vec_id"]: int(r["deviation"]) for r in whitening.transform(far, model, 2).collect()} == wanted
    assert {r["deviation"] for r in whitening.whiten(far).where("vec_id < 2").collect()} == {None}


# --- spelling ---


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_spelling(docs, least_length=5, least_count=3):
    import re

    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= least_length and c >= least_count}
    around = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in around.items() if vs}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(around[w]), n.get(form.get(w))) for w in n}


@pytest.fixture(scope="module")
def misspelt(spark):
    rng = random.Random(3)
    letters = "abà"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(60)]
    words += ["Aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaaaab", "aabaaa", "ÀBCDE", "àbcde", "x" * 300, "x" * 299, "x" * 298 + "y"]
    weights = [1 / (k % 37 + 1) ** 2 for k in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60))) + ", 1" + "×aaaaa÷") for i in range(80)]
    docs += [(7, docs[7][1]), (None, docs[3][1]), (500, None), (501, ""), (502, " 12 !"), (503, "kettle " * 12 + "kettla " * 6 + "kottla " * 3)]
    shape = "doc_id long, text string, word string, n long, length int, root string"
    return spark.createDataFrame([(i, t, "w", 1, 2, "r") for i, t in docs], shape), docs


@pytest.mark.parametrize("hot", [4096, 3, 1])
def test_spelling_equals_plain(misspelt, hot):
    df, docs = misspelt
    found = spelling.group(df, hot=hot).collect()
    wanted = plain_spelling(docs)
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    assert any(r["form"] is not None and r["root"] != r["form"] for r in found)  # chains are met


def test_near_in_a_hot_block_of_one_place():
    """A block of one place holds as many words as there are letters, all near."""
    words = [(f"aa{chr(0x61 + k)}aa", k + 1) for k in range(26)]
    found = spelling.near_in_block(words, 5, 2, 3)
    assert found["aaaaa"] == [25, (-26, "aazaa")] and found["aazaa"] == [25, (-25, "aayaa")]


def test_every_pair_has_one_place():
    rng = random.Random(9)
    for _ in range(300):
        words = list({"".join(rng.choice("ab") for _ in range(rng.randint(5, 6))) for _ in range(rng.randint(2, 30))})
        total = Counter()
        for length in (4, 5, 6):
            at = [(w, 1) for w in words if len(w) in (length, length + 1)]
            for lo, hi in ((0, length // 2), (length // 2, length + 1)):
                blocks = {}
                for w, n in at:
                    behind = max(length - hi, 0)
                    blocks.setdefault((w[:lo], w[len(w) - behind :]), []).append((w, n))
                for block in blocks.values():
                    for w, (times, _) in spelling.near_in_block(block, length, lo, hi).items():
                        total[w] += times
        assert total == Counter({w: k for w in words if (k := sum(near(w, v) for v in words))})


def test_spelling_of_nothing(spark):
    assert spelling.group(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_spelling_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    found, wanted = queries.op12_spelling(spark, sf).toPandas(), duck(sf, queries.OP12_SQL)
    assert len(found) and rows(found) == rows(wanted)


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=MULTI[1], mergeable_ranks=bpe.read_ranks(MULTI[0]), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    odd = [" ", "  ", "\n", " \n ", " ", "é", "日本", "😀", "́", "a", "B", "7", "'s", "'", "!", "<|endoftext|>", "\x00", "\U000e0001", "ſ"]
    out = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [*out, None, "", " ", "  ", "x" * 50_000, " " * 5000, "abcabcabc " * 300, "ha" * 1000, "日" * 3000, "Hello  world\n\n\tfoo 's it's", "same", "same"]


def test_bpe_equals_the_library(spark, texts, library):
    df = spark.createDataFrame([(i, t, [0], "n") for i, t in enumerate(texts)] + [(None, "a null id", None, None)], "doc_id long, text string, ids array<int>, decoded string")
    found = bpe.round_trip(df, *MULTI).collect()
    wanted = set()
    for i, t in [*enumerate(texts), (None, "a null id")]:
        ids = library.encode_ordinary(t or "")
        wanted.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert len(found) == len(texts) + 1 and {tuple(r) for r in found} == wanted


def test_offsets_cover_characters(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = bpe.codec(*MULTI)
    for r in bpe.encode(df, *MULTI).collect():
        whole = model.tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False)
        assert list(zip(r["start"], r["end"], strict=True)) == whole.offsets and r["ids"] == whole.ids


def test_decoding_joins_split_characters(spark):
    model = bpe.codec(*MULTI)
    ids = model.encode(["\U0001f9ff\U00013000"])[0].tolist()
    assert len(ids) > 2  # characters are split over tokens
    df = spark.createDataFrame([(1, ids, 5), (2, ids[:1], 6), (3, None, 7), (4, [None, -1, 10**6, *ids], 8), (5, [], 9)], "doc_id long, ids array<int>, decoded int")
    found = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(df, *MULTI).collect()}
    whole = "\U0001f9ff\U00013000".encode()
    assert found[1] == found[4] == whole and whole.startswith(found[2]) and found[3] == found[5] == b""


def test_a_small_memory_changes_nothing(texts, library):
    model = bpe.Codec(*MULTI, most=3)
    for t in texts:
        assert model.encode([t or ""])[0].tolist() == library.encode_ordinary(t or "")
    assert len(model.known) == 3


def test_bpe_of_nothing(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), *MULTI).collect() == []
