"""What keeps work in proportion: small files are spread before much is made of their rows, and cheaper ways give the same results."""

import random
import re
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from sonde.functions.text import FOLDED, LOOK_ALIKE, fold_look_alikes
from sonde.functions import vectorised as vx
from sonde.operators import expand, extract, linking, rules
from sonde.queries import extraction, load_all, rollups
from sonde.sources import tables

SF = "/root/testdata/sf0.001"


def test_messages_are_spread(spark):
    assert extraction.messages(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_parts_are_the_patterns():
    patterns = {n: p for n, _, p in rules.SIGNALS}
    for name, parts in rules.PARTS.items():
        both = "|".join(p for _, p in parts)
        assert patterns[name] in (f"(?i)(?:{both})", f"(?is){both}")


def test_bits_are_those_of_the_patterns():
    """Texts of pieces on which parts of the costly signals fire, against the whole patterns without any look for literals."""
    pieces = [
        "booter", "Streser", "scam page", "OTP bot", "loader builder", "crypter", "FUD", "offers", "l7", "layer 4", "method", "Selling", "for sale", "script", "wallet scanner",
        "build your own", "cnc", "stealer", "l0g$", "fresh logs", "u.l.p", "12,000 lines", "logs", "40 pcs", "url: log: pass", "http://a.b/c", "10.0.0.1", "1.2.3.4", "\n", "5 rows", "dm", "pass: @abcd", "пароль",
    ]
    draw = random.Random(3)
    texts = [" ".join(draw.choices(pieces, k=draw.randrange(1, 9))) for _ in range(3000)]
    wanted = [sum(1 << i for i, (_, _, p) in enumerate(rules.SIGNALS) if re.search(p, t, re.ASCII)) for t in texts]
    assert rules.fired_bits([*texts, None, ""]) == [*wanted, 0, 0]
    names = [n for n, _, _ in rules.SIGNALS]
    for name in rules.PARTS:
        assert any(w >> names.index(name) & 1 for w in wanted)


def test_folding(spark):
    texts = [None, "", "plain", "\u0440\u0430ss", LOOK_ALIKE]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fold_look_alikes(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in sorted(found)] == [None, "", "plain", "pass", FOLDED]


def test_near_signatures_with_few_bits_that_differ(spark):
    """All pairs of signatures most of whose bits are alike, and blocks made of the other bits only."""
    draw = random.Random(4)
    items = list({(draw.getrandbits(14) << 30 | 1 << 63 | 5) - (1 << 64) for _ in range(1500)})
    found = linking.hamming_pairs(spark.createDataFrame(list(enumerate(items)), "k long, s long"), "k", "s", 3).collect()
    wanted = {(i, j, (x ^ y).bit_count()) for i, x in enumerate(items) for j, y in enumerate(items[:i]) if (x ^ y).bit_count() <= 3}
    assert sorted((r["b"], r["a"], r["distance"]) for r in found) == sorted(wanted)
    blocks, sets = linking._agreeing(10**6, list(range(30, 44)), 3)
    assert sum(blocks) == (1 << 44) - (1 << 30) and all(len(held) + 3 == len(blocks) for held in sets)


def test_no_bits_or_rows(spark):
    for items in ([], [(1, 7)], [(1, 7), (2, 7), (3, None)], [(1, 0), (2, 1)]):
        found = linking.hamming_pairs(spark.createDataFrame(items, "k long, s long"), "k", "s", 3).collect()
        assert [tuple(r) for r in found] == ([(1, 2, 0 if items[1][1] == 7 else 1)] if len(items) > 1 else [])


def test_copies_of_signatures_are_not_broadcast(spark):
    """Spark takes dozens of copies of the classes for as small as the classes; a broadcast of them fills the driver's memory."""
    found = linking.hamming_pairs(spark.createDataFrame([(i, i * 40503 % 65536) for i in range(300)], "k long, s long"), "k", "s", 3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_an_address_is_given_as_often_as_it_occurs(spark):
    """A wrong checksum is left out before equal values are, and without repeats a value comes once."""
    one, bad = "0x" + "1" * 20 + "ab" * 10, "0x" + "1" * 20 + "aB" * 10
    rows = spark.createDataFrame([(1, f"{bad} {one}, {one}."), (2, one), (2, one), (3, None)], "k long, body string")
    eth = [r for r in extract.INDICATORS if r[0] == "wallet_eth"]
    assert sorted(map(tuple, extract.indicators(rows, "k", "body", eth, repeats=True).collect())) == [(1, "wallet_eth", one, one, 43)] * 2 + [(2, "wallet_eth", one, one, 0)] * 2
    assert sorted(r["k"] for r in extract.indicators(rows, "k", "body", eth).collect()) == [1, 2]


def test_trigrams_are_counted_by_code_points(spark):
    rows = [("en", "abca\U0001f600bc"), ("en", "bca"), (None, "xyz"), ("es", None), ("es", "ab")]
    wanted = Counter((lang, t[i : i + 3]) for lang, t in rows for i in range(len(t or "") - 2))
    found = vx.char3_counts(spark.createDataFrame(rows, "lang string, text string").coalesce(1)).collect()
    assert {(r["lang"], r["gram"]): r["n"] for r in found} == wanted


def test_edges_are_shuffled_by_number(spark):
    """What is made distinct holds two ends and a number, not four names; pivots of one name are one."""
    two = [expand.Pivot("a", "x", "b", "e", "domains", "artifact", "domain"), expand.Pivot("a", "x", "b", "e", "links", "a", "b")]
    tables = {"domains": spark.createDataFrame([(1, "q"), (2, None)], "artifact long, domain string"), "links": spark.createDataFrame([("1", "q", "linked")], "a string, b string, kind string")}
    found = expand.edges(tables, two)
    assert sorted(map(tuple, found.collect())) == [("a", "1", "x", "b", "q", "e"), ("a", "q", "x", "b", "1", "e")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.search(r"hashpartitioning\(([^)]*)\)", plan).group(1)
    assert keys.count("#") == 3


def test_browse_counts_without_spelling_lines_out(spark, tmp_path):
    """Keys that repeat or are null, orders and parts that are missing: equal to the SQL, and no line is multiplied for a distinct count."""
    duckdb, draw = __import__("duckdb"), random.Random(4)
    some = lambda most: draw.choice([None, *range(most)])
    rows = {
        "part": ("p_partkey long", [(some(9),) for _ in range(12)]),
        "orders": ("o_orderkey long, o_custkey long", [(some(25), some(6)) for _ in range(40)]),
        "lineitem": ("l_partkey long, l_orderkey long, l_shipdate timestamp_ntz", [(some(12), some(30), draw.choice([None, datetime(1995, 1, draw.randrange(1, 28))])) for _ in range(400)]),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in rows:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = rollups.artifact_browse(spark, str(tmp_path))
    wanted = con.execute(load_all()[1]["artifact_browse"]).fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert tables.partitions_for(spark.range(1000), 10) == 100


def test_pairs_are_not_joined_again(spark):
    held = spark.createDataFrame([(a, i) for a in range(6) for i in range(a, a + 4)], "a long, i long")
    found = linking.shared_pairs(held, "a", "i")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")
    assert {(r["a"], r["b"]): r["shared"] for r in found.collect()}[0, 1] == [1, 2, 3]
