"""Operators on small inputs with results worked out by hand or by a plain mirror."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonde.functions import addresses
from sonde.functions import text as tx
from sonde.functions import vectorised as vx
from sonde.operators import evaluate, extract, features, linking, rules
from sonde.plans.components import components


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


@given(st.lists(st.binary(max_size=12), max_size=8))
def test_fnv_is_the_byte_loop(items):
    assert vx.fnv1a(items).tolist() == [fnv(b) for b in items]


@given(st.dictionaries(st.text(max_size=4), st.integers(-3, 5), min_size=1, max_size=6))
def test_simhash_is_the_vote(weights):
    votes = [sum(w if fnv(n.encode()) >> b & 1 else -w for n, w in weights.items()) for b in range(64)]
    assert int(vx.simhash64(weights), 16) == sum(1 << b for b in range(64) if votes[b] > 0)


@settings(max_examples=30)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_compression_distance_is_symmetric(a, b):
    assert vx.ncd(a, b) == vx.ncd(b, a) and 0 <= vx.ncd(a, b) <= 1


def test_addresses():
    assert vx.base58_ok("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2") and not vx.base58_ok("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3")
    assert vx.bech32_ok("BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4") and not vx.bech32_ok("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5")


def test_impostors_prefer_the_same_author():
    a, b = ["the cat sat on the mat", "a cat on a mat", "the mat of the cat"], ["the cat is on the mat", "that cat sat", "mats and cats"]
    other = [["quantum flux drive engine", "warp core"], ["señor gato come pescado", "que tal"], []]
    assert vx.impostors(a, b, other)[0] > 0.8 and vx.impostors(a, b, other)[1] == 1.0
    assert vx.impostors(a, b, other) == vx.impostors(a, b, other)
    assert vx.impostors(a, other[0], [b, other[1]])[0] < 0.1
    assert vx.impostors(a, b, [])[1] == vx.impostors(a, b, [[]])[1] == 0.3
    assert vx.impostors(a, b[:1], other) == (0.0, 0.0)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hours,wanted", [([1] * 24, (None, None)), ([0] * 6 + [9] * 18, (0, 6)), ([0] * 3 + [9] * 18 + [0] * 3, (21, 6))])
def test_quiet_span(spark, hours, wanted):
    row = features.quiet_span(spark.createDataFrame([(1, hours)], "actor int, h array<long>")).first()
    assert (row["quiet_start"], row["quiet_hours"]) == wanted


def test_hamming_pairs_are_all_pairs_of_classes(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    items = [(i, base[i % 6] ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for i in range(40)]
    items += [(100 + i, items[i][1]) for i in range(10)] + [(200, items[0][1])]
    least = {}
    for k, x in items:
        least[x] = min(k, least.get(x, k))
    found = [(r["a"], r["b"], r["distance"]) for r in linking.hamming_pairs(spark.createDataFrame(items, "k long, sig long"), "k", "sig", 3).collect()]
    wanted = {(min(a, b), max(a, b), bin(x ^ y).count("1")) for x, a in least.items() for y, b in least.items() if a != b and bin(x ^ y).count("1") <= 3}
    assert sorted(found) == sorted(wanted | {(least[x], k, 0) for k, x in items if k != least[x]})


def test_nearest_vectors_in_several_blocks(spark):
    rng = np.random.default_rng(6)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    vectors[40] = vectors[41] = vectors[50]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "k long, v array<double>").repartition(3)
    found = linking.nearest_vectors(df.where("k % 50 = 0"), df, "k", "v", 5, block_bytes=100).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    cosine = np.round(unit @ unit.T, 6)
    wanted = [(q, k, r + 1) for q in range(0, 300, 50) for r, k in enumerate(sorted((k for k in range(300) if k != q), key=lambda k: (-cosine[q, k], k))[:5])]
    assert sorted((r["query"], r["k"], r["rank"]) for r in found) == sorted(wanted)


def test_auc_of_continuous_scores(spark):
    rng = random.Random(8)
    data = [(rng.choice((rng.random(), 0.5)), rng.random() < 0.4) for _ in range(400)]
    row = evaluate.auc(spark.createDataFrame(data, "s double, y boolean").repartition(3), "s", F.col("y")).first()
    up, down = [s for s, y in data if y], [s for s, y in data if not y]
    assert row["auc"] == round(sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down), 6)


def test_signals_with_look_alikes_and_gates(spark):
    """Every gate lets through what its pattern finds."""
    texts = {
        "deface_banner": "OwNed BY us", "onion_url": "a" * 16 + ".ONION", "cred_combo": "a@b.cc:pass1", "compromise_confirmed": "Got ROOT", "check_host": "check-host.net/check-report/x1",
        "ddos_command": "\n/Attack 1.2.3.4", "crew_tag_cluster": "#ab #cd", "leak_label": "Base de datos", "cloud_pass": "Pass: @chan1", "cred_label": "Usuario: x Clave:",
        "target_dump_file": "x.example.TAR.GZ", "leak_host": "MEGA.nz", "sale_marker": "For Sale", "access_material": "RDP", "telecom_abuse": "Sender ID", "session_id": "05" + "a" * 64,
        "pii_schema": "DOB, SSN, CVV, x", "institutional_target": "x.GOB.mx", "cve": "CVE-2020-12345", "eth_addr": "0X" + "a" * 40, "ipv4": "10.0.0.1", "tg_target": "T.ME/abcd", "dm_contact": "DM abc",
    }
    assert set(texts) == set(rules.NEEDS)
    df = spark.createDataFrame(list(texts.items()), "name string, body string")
    found = {r["name"]: r["names"] for r in df.select("name", rules.weighted(F.col("body"))[1].alias("names")).collect()}
    assert all(name in names for name, names in found.items())
    disguised = spark.createDataFrame([("раss: @chan1",)], "body string")  # Cyrillic er and a
    assert disguised.select(F.array_join(rules.weighted(tx.fold_look_alikes(F.col("body")))[1], ",")).first()[0] == "cloud_pass,tg_target"


def test_indicator_places(spark):
    body = "see @Abcd_1, y@abcd.org and @ABCD_1 @admin " + "A" * 76
    found = extract.indicators(spark.createDataFrame([(1, body), (2, None), (3, "")], "k int, body string"), "k", "body").collect()
    assert {(r["kind"], r["value"], r["raw"], r["at"]) for r in found} == {
        ("handle_other_platform", "abcd_1", "Abcd_1", 5),
        ("email", "y@abcd.org", "y@abcd.org", 13),
        ("tox", "a" * 76, "A" * 76, 43),
    }


def test_indicators_stand_where_they_match(spark):
    """The place is that of the match, not of an earlier look-alike; a mirror in Python agrees on accents and repeats."""
    bodies = ["abcd wrote: ask @abcd today", "é@accent.es @àbcd @abcde", "a@b.co " * 40 + "@last_one", "x" * 300_000 + " @far_away", "05" + "a" * 64 + "é"]
    found = extract.indicators(spark.createDataFrame(list(enumerate(bodies)), "k int, body string"), "k", "body").collect()
    wanted = set()
    for k, body in enumerate(bodies):
        seen = {}
        for kind, pattern, fold in extract.INDICATORS:
            if kind.startswith("wallet"):
                continue
            for m in re.finditer(pattern, body, re.ASCII):
                raw = m.group(re.compile(pattern).groups and 1)
                value = raw.lower() if fold else raw
                if not (kind == "handle_other_platform" and value in extract.NO_HANDLES):
                    seen.setdefault((kind, value), (raw, m.start(re.compile(pattern).groups and 1)))
        wanted |= {(k, *key, *place) for key, place in seen.items()}
    assert {tuple(r) for r in found} == wanted
    assert (0, "handle_other_platform", "abcd", "abcd", 17) in wanted
    short = extract.indicators(spark.createDataFrame([(1, "@handle1 @handle2")], "k int, body string"), "k", "body", most=9).collect()
    assert [r["value"] for r in short] == ["handle1"]


def test_statements_and_sentences(spark):
    """Dump lines hold variables; sentences that begin like one hold names."""
    chats = ["Update: join @newchannel now", "use @channel1", "Drop by @channel2", "set up @channel3", "Insert coin at @channel4", "t.me/channel5/12", "t.me/joinchat/abcdefgh12"]
    dumps = ["SET @old_value=@@unique_checks;", "/*!40101 SET @saved_cs = @@character_set_client */;", "INSERT INTO t VALUES ('@nobody1');", "update t set a='@nobody2'", "USE `db`; ", "LOCK TABLES `@nobody3` WRITE;", "CREATE TABLE x (a int) -- @nobody4"]
    df = spark.createDataFrame([("\n".join(chats + dumps),), ("ask @insider\r\nSET @x1234 = 1",), (None,), ("",)], "body string")
    found = [sorted(tuple(x) for x in r[0]) if r[0] is not None else None for r in df.select(extract.channels(F.col("body"))).collect()]
    names = [f"@channel{k}" for k in (1, 2, 3, 4, 5)] + ["@joinchat", "@newchannel"]
    assert found[0] == sorted([("invite_link", "joinchat:abcdefgh12")] + [("username_mention", n) for n in names])
    assert found[1] == [("username_mention", "@insider")] and not found[2] and found[3] == []


def test_keccak_and_addresses():
    """Published vectors, and each of them with one letter changed."""
    assert addresses.keccak256([b""])[0].tobytes().hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert addresses.keccak256([b"", b"abc"])[1].tobytes().hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    good = [
        ("wallet_eth", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"), ("wallet_eth", "0xfB6916095ca1df60bB79Ce92cE3Ea74c37c5d359"), ("wallet_eth", "0xdbF03B407c01E7cD3CBea99509d93f8DDDC8C6FB"),
        ("wallet_eth", "0x" + "ab" * 20), ("wallet_eth", "0x" + "AB" * 20), ("wallet_tron", "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t"), ("wallet_btc", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2"),
        ("wallet_btc", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy"), ("wallet_btc", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"), ("wallet_btc", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"),
        ("wallet_xmr", "44AFFq5kSiGBoZ4NMDwYtN18obc8AemS33DBLWs3H7otXft3XjrpDtQGv7SqSsaBYBb98uNbr2VBBEt7f2wfn3RVGQBEP3A"), ("email", "anything"),
    ]
    assert addresses.wallets_ok(*map(list, zip(*good, strict=True))) == [True] * len(good)
    other = {"wallet_eth": lambda t: t.swapcase().replace("0X", "0x"), "email": None}
    bad = [(k, other.get(k, lambda t: t[:20] + ("2" if t[20] != "2" else "3") + t[21:])(t)) for k, t in good if k != "email" and t.lower() != t or k == "wallet_btc"]
    bad = [(k, t) for k, t in bad if not (k == "wallet_eth" and t[2:] in (t[2:].lower(), t[2:].upper()))]
    bad += [("wallet_tron", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2"), ("wallet_btc", "11BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2"), ("wallet_btc", None), ("wallet_xmr", "4" * 95), ("wallet_btc", "")]
    assert addresses.wallets_ok(*map(list, zip(*bad, strict=True))) == [False] * len(bad)
    assert addresses.wallets_ok([], []) == []


def test_folder_predicates(spark):
    df = spark.createDataFrame([(["a/x.txt", "b/y"],), ([],)], "p array<string>")
    hit = rules.folder(F.col("p"), ("or", ("glob", "a/*.txt"), ("not", ("at_most", 0, ("path", "b/y")))))
    assert [r[0] for r in df.select(hit).collect()] == [True, False]


def test_roles(spark):
    df = spark.createDataFrame([(1, 500, 9.0, 50.0, 0.98, "tight"), (2, 40, 1.0, 40.0, 0.5, "varied"), (3, 10, 5.0, 2.0, 0.5, "varied")], "actor int, total_messages long, per_day double, span_days double, initiation_rate double, variance_class string")
    assert {r["actor"]: r["role"] for r in features.roles(df).collect()} == {1: "bot_or_automated_poster", 2: "lurker_or_observer"}


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "s double, y int")
    assert evaluate.auc(df, "s", F.col("y") == 1).first()["auc"] == 0.875


def test_glob_and_masks(spark):
    assert tx.glob_pattern("a/*.txt") == "^a/[^/]*\\.txt$"
    row = spark.createDataFrame([("Buy at https://x.y/z @Bob 42!", "secret")], "a string, b string").select(tx.template(F.col("a")).alias("t"), tx.masked_tail(F.col("b")).alias("m")).first()
    assert (row["t"], row["m"]) == ("buy at urlx handlex 0", "**cret")
