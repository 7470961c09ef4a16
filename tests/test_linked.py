"""Hosts, index, personas and enrichments on small inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sonde.operators import hosts, postings
from sonde.operators.enrich import Registry
from sonde.operators.personas import Personas
from sonde.streaming.replay import fresh_dir


def test_hosts_in_ascii(spark):
    names = [("Bücher.Example.", "xn--bcher-kva.example"), ("例え。テスト", "xn--r8jz45g.xn--zckzah"), ("plain.org", "plain.org"), ("xn--a.bü", None), ("a..bü", None), ("", None), (None, None), ("ü" * 80 + ".de", None)]
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(names)], "i int, h string")
    found = {r["i"]: r["a"] for r in df.select("i", hosts.ascii_host(F.col("h")).alias("a")).collect()}
    assert found == {i: n[1] for i, n in enumerate(names)}


def plain_registrable(host, rules):
    labels = host.split(".")
    exact = [k for k in range(1, len(labels) + 1) if ".".join(labels[-k:]) in rules]
    wild = [k for k in range(2, len(labels) + 1) if "*." + ".".join(labels[-k + 1 :]) in rules]
    out = [k - 1 for k in range(1, len(labels) + 1) if "!" + ".".join(labels[-k:]) in rules]
    n = max(out) if out else max(exact + wild, default=1)
    return ".".join(labels[-n:]), ".".join(labels[-n - 1 :]) if len(labels) > n else None


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_registrable_by_rules(spark, broadcast_rows):
    rng = random.Random(2)
    rules = ["com", "co.uk", "uk", "*.ck", "!www.ck", "a.b.c", "*.b", "B.C"]
    names = {".".join(rng.choice(["a", "b", "c", "www", "ck", "co", "uk", "com"]) for _ in range(rng.randint(1, 5))) for _ in range(200)}
    df = spark.createDataFrame([(n,) for n in [*names, None, ""]], "h string")
    suffixes = spark.createDataFrame([(r,) for r in [*rules, None]], "rule string")
    found = {r["host"]: (r["public_suffix"], r["registrable"]) for r in hosts.registrable(df, "h", suffixes, broadcast_rows).collect()}
    assert found == {n: plain_registrable(n, {r.lower() for r in rules}) for n in names}


def test_index_equals_a_scan(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["a", "b", "c", "É"]) for _ in range(rng.randint(0, 12))) for i in range(80)} | {100: "a-b, A  b", 101: "", 102: None}
    index = postings.Index(spark, fresh_dir(spark, "t"), buckets=4)
    index.write(spark.createDataFrame(list(texts.items()), "id int, text string"), "id", "text")
    words = {i: postings.words(t or "") for i, t in texts.items()}
    for phrase in ("a", "a b", "a a", "b é b", "c b a c", "zzz a"):
        said = postings.words(phrase)
        wanted = {i: n for i, w in words.items() if (n := sum(w[k : k + len(said)] == said for k in range(len(w))))}
        assert {r["key"]: r["n"] for r in index.phrase(phrase).collect()} == wanted
        assert {r["key"] for r in index.all_of(phrase).collect()} == {i for i, w in words.items() if set(said) <= set(w)}
        assert {r["key"] for r in index.any_of(phrase).collect()} == {i for i, w in words.items() if set(said) & set(w)}


def test_a_query_opens_only_its_buckets(spark):
    index = postings.Index(spark, fresh_dir(spark, "t"), buckets=16)
    index.write(spark.createDataFrame([(1, "one two three four five six seven eight")], "id int, text string"), "id", "text")
    read = index.read(["two"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "In(word" in plan.replace("EqualTo(word", "In(word")
    assert len({f.rsplit("bucket=", 1)[1].split("/")[0] for f in read.inputFiles()}) >= 1


def test_merge_then_split_restores(spark):
    pairs = lambda data: spark.createDataFrame(data, "a long, b long")
    personas = Personas(spark, fresh_dir(spark, "t"))
    read = lambda: {r["actor"]: r["persona"] for r in personas.members().collect()}
    personas.decide(pairs([(2, 3), (5, 6), (6, 7), (7, 7)]), "merge")
    before = read()
    assert before == {2: 2, 3: 2, 5: 5, 6: 5, 7: 5}
    assert personas.decide(pairs([(3, 5)]), "merge") == 5
    assert set(read().values()) == {2}
    personas.decide(pairs([(5, 3)]), "split")
    assert read() == before
    assert personas.decide(pairs([(9, 10)]), "merge") == 2  # others are not worked out again
    personas.decide(pairs([(6, 7)]), "split")
    assert read() == {2: 2, 3: 2, 5: 5, 6: 5, 7: 7, 9: 9, 10: 9}
    with pytest.raises(ValueError, match="unknown action"):
        personas.decide(pairs([(1, 2)]), "join")


def test_enrichments_are_typed(spark):
    registry = Registry()
    registry.add("size", ("word",), "n int, odd boolean")(lambda asked: asked.where("subject <> 'none'").select("subject", F.length("subject").alias("n"), (F.length("subject") % 2 == 1).alias("odd")))
    registry.add("letters", ("word", "name"), "letter string", rows=True)(lambda asked: asked.select("subject", F.explode(F.split("subject", "")).alias("letter")))
    registry.add("broken", ("other",), "x int")(lambda asked: asked.select("subject"))
    with pytest.raises(ValueError, match="twice"):
        registry.add("size", (), "n int")(lambda asked: asked)
    subjects = spark.createDataFrame([("word", "abc"), ("word", "abc"), ("word", "none"), ("name", "xy"), ("place", "q")], "kind string, subject string")
    assert {tuple(r) for r in registry.run("size", subjects).collect()} == {("abc", 3, True), ("none", None, None)}
    assert registry.run("letters", subjects).count() == 3 + 4 + 2
    with pytest.raises(TypeError, match="lacks"):
        registry.run("broken", subjects)
    del registry.known["broken"]
    facts = {tuple(r) for r in registry.facts(subjects).collect()}
    assert ("size", "abc", "n", "3") in facts and ("letters", "xy", "letter", "y") in facts and not any(f[0] == "size" and f[1] == "none" for f in facts)
