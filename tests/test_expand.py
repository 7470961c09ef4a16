"""Expansions over a small graph, by hand; seeds, pages, missing tables, nulls and repeats."""

import random

import pytest

from sonde.operators import expand
from sonde.queries import expanded


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "messages": make(
            [(1, "ann", "t1", "g1", "irc", True, 0), (2, "bob", "t1", "g1", "irc", False, 0), (3, "bob", "t2", "g1", "web", True, 0), (3, "bob", "t2", "g1", "web", True, 0), (4, None, "t2", None, "web", None, 0)],
            "message long, actor string, thread string, container string, source string, opens boolean, src int",
        ),
        "mentions": make([(1, "x.org", "domain"), (2, "x.org", "domain"), (2, "0xab", "wallet"), (9, "lost", "wallet")], "message long, artifact string, artifact_kind string"),
        "links": make([("ann", "bob", "linked"), ("bob", "ann", "linked"), ("ann", "ann", "linked"), ("bob", None, "related")], "a string, b string, kind string"),
        "members": make([("p", "bob")], "persona string, actor string"),
    }


def found(df):
    return {(r["src_kind"], r["src"], r["name"], r["dst"]) for r in df.collect()}


def test_pivots_by_hand(tables):
    got = found(expand.edges(tables))
    by = lambda kind, name: {(s, d) for k, s, n, d in got if (k, n) == (kind, name)}
    assert by("actor", "messages") == {("ann", "1"), ("bob", "2"), ("bob", "3")}
    assert by("actor", "started") == {("ann", "t1"), ("bob", "t2")}
    assert by("actor", "replied_in") == {("bob", "t1")}
    assert by("actor", "linked") == {("ann", "bob"), ("bob", "ann")}
    assert by("actor", "related") == set()
    assert by("artifact", "actors") == {("x.org", "ann"), ("x.org", "bob"), ("0xab", "bob")}
    assert by("thread", "messages") == {("t1", "1"), ("t1", "2"), ("t2", "3"), ("t2", "4")}
    assert by("thread", "op") == {("t1", "ann"), ("t2", "bob")}
    assert by("group", "source") == {("g1", "irc"), ("g1", "web")}
    assert by("persona", "artifacts") == {("p", "x.org"), ("p", "0xab")}
    assert by("persona", "wallets") == {("p", "0xab")}
    assert not {n for _, _, n, _ in got} & {"attachments", "incidents", "domain"}  # their tables are missing


def test_seeds_counts_and_pages(spark, tables):
    seeds = spark.createDataFrame([("bob",), ("bob",), (None,), ("nobody",)], "id string")
    mine = expand.of(tables, seeds, "actor")
    assert found(mine) == {e for e in found(expand.edges(tables)) if e[:2] == ("actor", "bob")}
    n = {(r["name"]): r["n"] for r in expand.counts(mine).collect()}
    assert n == {"messages": 2, "artifacts": 2, "groups": 1, "started": 1, "replied_in": 1, "linked": 1, "source": 2}
    pages = [[r["dst"] for r in expand.page(mine.where("name = 'messages'"), 1, k).collect()] for k in range(3)]
    assert pages == [["2"], ["3"], []]


def test_empty_tables_and_no_tables(tables):
    assert not expand.edges({k: t.limit(0) for k, t in tables.items()}).take(1)
    with pytest.raises(ValueError, match="none of the pivots"):
        expand.edges({})


def odd(spark, whole):
    """Tables with nulls, repeats, messages of several actors, actors of several personas and facts without a message."""
    draw = random.Random(7)
    some = lambda most: draw.choice([None, *range(most)])
    end = "long" if whole else "string"
    cast = lambda rows, ends: [tuple(str(v) if not whole and v is not None and i in ends else v for i, v in enumerate(r)) for r in rows]
    make = lambda rows, ends, schema: spark.createDataFrame(cast(rows, ends), schema.replace("end", end))
    return {
        "messages": make([(some(40), some(9), f"t{some(3)}", draw.choice([None, "g", "h"]), "s", draw.choice([None, True, False])) for _ in range(120)], (0, 1), "message end, actor end, thread string, container string, source string, opens boolean"),
        "mentions": make([(some(50), some(12), draw.choice([None, "wallet", "domain"])) for _ in range(150)], (1,), "message int, artifact end, artifact_kind string"),
        "attachments": make([(some(50), some(5)) for _ in range(90)], (), "message long, attachment long"),
        "incidents": make([(some(50), some(5)) for _ in range(90)], (), "message long, incident int"),
        "members": make([(some(3), some(11)) for _ in range(20)], (0, 1), "persona end, actor end"),
        "links": make([(some(9), some(9), draw.choice([None, "linked", "related"])) for _ in range(90)], (), "a long, b int, kind string"),
        "domains": make([(some(12), draw.choice(["1", "x", None])) for _ in range(30)], (0,), "artifact end, domain string"),
        "contents": make([(draw.choice(["d", "e", None]), some(12)) for _ in range(60)], (1,), "document string, artifact end"),
    }


@pytest.mark.parametrize("whole", [True, False])
def test_all_counts_and_pages_are_those_of_the_edges(spark, tables, whole):
    made = odd(spark, whole)
    rows = lambda df: sorted(map(tuple, df.collect()))
    fewer = {k: t for k, t in made.items() if k not in ("members", "incidents", "links")}
    for given, pivots in ((made, expand.PIVOTS), (tables, expand.PIVOTS), (fewer, expand.PIVOTS), (made, expand.PIVOTS[1:2] + (expand.Pivot("x", "y", "z", "e", "uses", "thread", "container"),))):
        found = expand.edges(given, pivots)
        assert rows(expand.all_counts(given, pivots)) == rows(expand.counts(found))
        assert rows(expand.all_pages(given, 2, 1, pivots)) == rows(expand.page(found, 2, 1))
        assert expand.all_counts(given, pivots).schema.simpleString() == expand.counts(found).schema.simpleString()
        assert expand.all_pages(given, 2, 1, pivots).schema.simpleString() == expand.page(found, 2, 1).schema.simpleString()
    assert not expand.all_counts({k: t.limit(0) for k, t in made.items()}).take(1)
    for all_of in (expand.all_counts, lambda t: expand.all_pages(t, 2)):
        with pytest.raises(ValueError, match="none of the pivots"):
            all_of({})


@pytest.mark.parametrize("name", ["expansion_counts", "expansion_pages"])
def test_expansions_do_not_shuffle_every_edge(spark, name):
    """The edges of sf0.01, each shuffled, were 16 and 22 MB."""
    stages = lambda: spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    written = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages().apply(i) for i in range(stages().size()))}
    before = written()
    getattr(expanded, name)(spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    assert sum(n for stage, n in written().items() if stage not in before) < 10e6
