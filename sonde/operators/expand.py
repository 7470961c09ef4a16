"""Typed one-hop expansions between the kinds of a message graph: each pivot names what it starts from, what it reaches and how.

A pivot is two columns of a view, so a new one is a line. All pivots asked for are read in one pass over each view and made distinct by
one shuffle; pages and counts rest on the same edges.

Counts and pages of all nodes (`all_counts`, `all_pages`) do not shuffle every edge. Each message is first gathered with its distinct
rows, artifacts, attachments and incidents; that table is written once. An edge with a message at an end is distinct inside its row.
Other edges are made distinct where rows are partitioned by one of their ends, an actor or an artifact: if that is the source, they are
counted there, if not, only partial counts or the first few of a source travel. Ends travel in their own type and are spelled out after that.

Tables (a missing one gives no edges): messages (message, actor, thread, container, source, opens boolean), mentions (message,
artifact, artifact_kind), attachments (message, attachment), incidents (message, incident), members (persona, actor), links (a, b, kind
`linked` or `related`), domains (artifact, domain), contents (document, artifact). Defined results: an edge with a null end is none, repeated ones are one,
links hold both ways, and an actor isn't its own neighbour; empty tables give no edges; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.plans.lineage import materialize


@dataclass(frozen=True)
class Pivot:
    """src_kind's neighbours called name: the pairs of columns (src, dst) in a view, where `where` holds."""

    src_kind: str
    name: str
    dst_kind: str
    edge: str
    view: str
    src: str
    dst: str
    where: str | None = None


#: Kinds, names and edges of the expansions.
PIVOTS = (
    Pivot("actor", "messages", "message", "authored", "messages", "actor", "message"),
    Pivot("actor", "artifacts", "artifact", "uses_infra", "uses", "actor", "artifact"),
    Pivot("actor", "groups", "group", "active_in", "messages", "actor", "container"),
    Pivot("actor", "started", "thread", "started", "messages", "actor", "thread", "opens"),
    Pivot("actor", "replied_in", "thread", "replied_in", "messages", "actor", "thread", "not opens"),
    Pivot("actor", "linked", "actor", "linked", "links", "a", "b", "kind = 'linked' and a <> b"),
    Pivot("actor", "related", "actor", "related", "links", "a", "b", "kind = 'related' and a <> b"),
    Pivot("actor", "attachments", "attachment", "posted", "attached", "actor", "attachment"),
    Pivot("actor", "incidents", "incident", "has_incident", "flagged", "actor", "incident"),
    Pivot("actor", "source", "source", "from_source", "messages", "actor", "source"),
    Pivot("artifact", "messages", "message", "mentioned_in", "uses", "artifact", "message"),
    Pivot("artifact", "actors", "actor", "mentioned_by", "uses", "artifact", "actor"),
    Pivot("artifact", "domain", "artifact", "on_domain", "domains", "artifact", "domain", "artifact <> domain"),
    Pivot("message", "attachments", "attachment", "attached", "attached", "message", "attachment"),
    Pivot("message", "incidents", "incident", "classified_as", "flagged", "message", "incident"),
    Pivot("message", "author", "actor", "authored_by", "messages", "message", "actor"),
    Pivot("message", "container", "group", "in", "messages", "message", "container"),
    Pivot("message", "artifacts", "artifact", "mentions", "uses", "message", "artifact"),
    Pivot("message", "source", "source", "from_source", "messages", "message", "source"),
    Pivot("thread", "messages", "message", "in_thread", "messages", "thread", "message"),
    Pivot("thread", "participants", "actor", "posted_in", "messages", "thread", "actor"),
    Pivot("thread", "op", "actor", "started", "messages", "thread", "actor", "opens"),
    Pivot("thread", "incidents", "incident", "has_incident", "flagged", "thread", "incident"),
    Pivot("thread", "source", "source", "from_source", "messages", "thread", "source"),
    Pivot("group", "messages", "message", "in_group", "messages", "container", "message"),
    Pivot("group", "participants", "actor", "active_in", "messages", "container", "actor"),
    Pivot("group", "source", "source", "from_source", "messages", "container", "source"),
    Pivot("document", "artifacts", "artifact", "contains_artifact", "contents", "document", "artifact"),
    Pivot("persona", "actors", "actor", "member", "members", "persona", "actor"),
    Pivot("persona", "messages", "message", "authored", "own", "persona", "message"),
    Pivot("persona", "artifacts", "artifact", "uses_infra", "own_uses", "persona", "artifact"),
    Pivot("persona", "wallets", "artifact", "uses_infra", "own_uses", "persona", "artifact", "artifact_kind = 'wallet'"),
    Pivot("persona", "groups", "group", "active_in", "own", "persona", "container"),
)
SHAPE = ["src_kind", "src", "name", "dst_kind", "dst", "edge"]
#: What a view joins, and on which column.
VIEWS = {
    "uses": ("messages", "mentions", "message"), "attached": ("messages", "attachments", "message"), "flagged": ("messages", "incidents", "message"),
    "own": ("messages", "members", "actor"), "own_uses": ("uses", "members", "actor"),
}
COLUMNS = {
    "messages": ["message", "actor", "thread", "container", "source", "opens"], "mentions": ["message", "artifact", "artifact_kind"], "attachments": ["message", "attachment"],
    "incidents": ["message", "incident"], "members": ["persona", "actor"], "links": ["a", "b", "kind"], "domains": ["artifact", "domain"], "contents": ["document", "artifact"],
}


def _view(tables: dict[str, DataFrame], name: str) -> DataFrame | None:
    if name in VIEWS:
        left, right, on = VIEWS[name]
        a, b = _view(tables, left), _view(tables, right)
        return a.join(b, on) if a is not None and b is not None else None
    table = tables.get(name)
    if table is None:
        return None
    rows = table.select(*[F.col(c) if c == "opens" else F.col(c).cast("string").alias(c) for c in COLUMNS[name]])
    if name == "links":
        rows = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
    return rows


def _kind(p: Pivot) -> tuple[str, str, str, str]:
    return p.src_kind, p.name, p.dst_kind, p.edge


def edges(tables: dict[str, DataFrame], pivots: Iterable[Pivot] = PIVOTS) -> DataFrame:
    """SHAPE rows of all pivots, each edge once."""
    by_view: dict[str, list[Pivot]] = {}
    pivots = list(pivots)
    kinds = list(dict.fromkeys(map(_kind, pivots)))  # edges are made distinct by number, and named after that
    for p in pivots:
        by_view.setdefault(p.view, []).append(p)
    found = []
    for view, wanted in by_view.items():
        rows = _view(tables, view)
        if rows is None:
            continue
        ends = lambda p: F.struct(F.lit(kinds.index(_kind(p))).alias("pivot"), F.col(p.src).alias("src"), F.col(p.dst).alias("dst"))
        each = F.array_compact(F.array(*[F.when(F.expr(p.where), ends(p)) if p.where else ends(p) for p in wanted]))
        found.append(rows.select(F.inline(each)).where("src IS NOT NULL AND dst IS NOT NULL"))
    if not found:
        raise ValueError("none of the pivots has its tables")
    named = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("src_kind", "name", "dst_kind", "edge"), kind, strict=True)]) for kind in kinds]), F.col("pivot") + 1)
    return reduce(DataFrame.unionByName, found).distinct().withColumn("named", named).select(*[c if c in ("src", "dst") else f"named.{c}" for c in SHAPE])


def of(tables: dict[str, DataFrame], seeds: DataFrame, kind: str, pivots: Iterable[Pivot] = PIVOTS) -> DataFrame:
    """Edges that start from the seeds (id) of one kind."""
    mine = edges(tables, [p for p in pivots if p.src_kind == kind])
    return mine.join(seeds.select(F.col("id").cast("string").alias("src")).distinct(), "src", "left_semi").select(*SHAPE)


def counts(found: DataFrame) -> DataFrame:
    """(src_kind, src, name, n): how many neighbours each expansion would give."""
    return found.groupBy("src_kind", "src", "name").agg(F.count("*").alias("n"))


def page(found: DataFrame, size: int, number: int = 0) -> DataFrame:
    """The neighbours of one page of each expansion, by dst; Spark keeps no more than the pages up to it of any node before it shuffles."""
    place = F.row_number().over(W.partitionBy("src_kind", "src", "name").orderBy("dst"))
    return found.withColumn("place", place).where((F.col("place") > size * number) & (F.col("place") <= size * (number + 1)))


#: The column that each view of a message adds, and the columns of a message itself.
ADDS = {"messages": (), "uses": ("artifact",), "attached": ("attachment",), "flagged": ("incident",), "own": ("persona",), "own_uses": ("artifact", "persona")}
OWN = ("message", "actor", "thread", "container", "source", "opens")


def _home(p: Pivot) -> str | None:
    """The column by whose partitions p's edges are made distinct; None: by all of an edge."""
    if p.view in ("links", "domains"):
        return p.src
    if p.view in ("contents", "members"):
        return None
    if "message" in (p.src, p.dst) and p.src not in ("actor", "artifact"):
        return None if p.where else "message"
    return next((c for c in (p.src, p.dst) if c in ("actor", "artifact")), None)


def _gathers(pivots: list[Pivot]) -> bool:
    """Whether all edges can be had from gathered messages: kinds that are of one pivot, and views for the sake of what they add."""
    ends = all(set(ADDS.get(p.view, ())) <= {p.src, p.dst} for p in pivots)
    return ends and len(set(map(_kind, pivots))) == len(pivots)


def _narrow(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables' columns; an end is a whole number if it is one in all tables that have it, a string otherwise."""
    alike = {"b": "a"}
    whole = ("tinyint", "smallint", "int", "bigint")
    found: dict[str, set[str]] = {}
    for name, table in tables.items():
        for c in COLUMNS.get(name, ()):
            found.setdefault(alike.get(c, c), set()).add(table.schema[c].dataType.simpleString())
    kind = lambda c: "long" if found[alike.get(c, c)] <= set(whole) else "string"
    return {name: table.select(*[F.col(c) if c == "opens" else F.col(c).cast(kind(c)).alias(c) for c in COLUMNS[name]]) for name, table in tables.items() if name in COLUMNS}


def _gathered(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(message, own, uses, attached, flagged): a row for every message, with its distinct rows and the personas of their actors."""
    rows = tables.get("messages")
    if rows is None:
        return None
    if "members" in tables:
        personas = tables["members"].where("persona is not null and actor is not null").groupBy("actor").agg(F.collect_set("persona").alias("personas"))
        rows = rows.join(personas, "actor", "left").withColumn("personas", F.coalesce("personas", F.array().cast(personas.schema["personas"].dataType)))
    else:
        rows = rows.withColumn("personas", F.array().cast("array<string>"))
    rows = rows.select("message", F.struct(*OWN[1:], "personas").alias("own"))
    facts = rows
    parts = {"uses": ("mentions", "artifact", F.struct("artifact", "artifact_kind")), "attached": ("attachments", "attachment", F.col("attachment")), "flagged": ("incidents", "incident", F.col("incident"))}
    for name, (table, end, value) in parts.items():
        if table in tables:
            facts = facts.unionByName(tables[table].where(F.col(end).isNotNull()).select("message", value.alias(name)), allowMissingColumns=True)
    own = [F.collect_set(c).alias(c) for c in ("own", *parts) if c in facts.columns]
    whole = facts.where("message is not null").repartition("message").groupBy("message").agg(*own).where(F.size("own") > 0)
    # rows without a message are no message: each stays by itself
    lost = rows.where("message is null").select("message", F.array("own").alias("own"))
    return materialize(whole.unionByName(lost, allowMissingColumns=True), "messages")


def _values(c: str) -> Column:
    """All values of an end in a gathered message."""
    name = {"artifact": "uses.artifact", "attachment": "attached", "incident": "flagged", "persona": "own.personas"}.get(c, f"own.{c}")
    return F.array_distinct(F.array_compact(F.flatten(name) if c == "persona" else F.col(name)))


def _flat(gathered: DataFrame, view: str, home: str | None, needs: set[str], tasks: int) -> DataFrame:
    """A view's columns that are needed; with a home, in partitions by it: a message's other ends travel to an actor as one row, artifacts one by one."""
    wants = {"messages": [], "uses": ["uses"], "attached": ["attached"], "flagged": ["flagged"], "own": [], "own_uses": ["uses"]}[view]
    own = [F.explode("personas").alias("persona")] if "persona" in needs else []
    mine = [c for c in OWN if c in needs or c == home]
    rows = gathered.select("message", *wants, F.inline("own"))
    if home == "actor":
        rows = rows.where("actor is not null").select(*mine, *(["personas"] if own else []), *wants).repartition(tasks, "actor")
    rows = rows.select(*mine, *wants, *own)
    for c in wants:
        rows = rows.select(*[x for x in rows.columns if x != c], F.inline(c) if c == "uses" else F.explode(c).alias(ADDS[c][0]))
    rows = rows.select(*[c for c in rows.columns if c in needs or c == home])
    return rows.repartition(tasks, "artifact") if home == "artifact" else rows


def _tasks(df: DataFrame, rows: int, each: int = 500_000) -> int:
    """As many tasks as that many rows call for, so that a task's memory does not grow with the tables."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))


def _facts(gathered: DataFrame) -> int:
    """How many rows, artifacts, attachments and incidents all messages have."""
    found = gathered.agg(*[F.coalesce(F.sum(F.size(c).cast("long")), F.lit(0)) for c in gathered.columns if c != "message"]).first()
    return sum(map(int, found))


def _settled(tables: dict[str, DataFrame], pivots: list[Pivot]):
    """Frames of distinct edges with the names of their sources' and targets' columns, the gathered messages, and the pivots that those alone give."""
    tables = _narrow(tables)
    gathered = _gathered(tables) if any(p.view in ADDS for p in pivots) else None
    tasks = _tasks(gathered, _facts(gathered)) if gathered is not None else 0
    groups: dict[tuple, list[Pivot]] = {}
    for p in pivots:
        home = _home(p)
        groups.setdefault((p.view, home, home == p.src), []).append(p)
    frames, inside = [], []
    for (view, home, from_home), wanted in groups.items():
        if view in ADDS:
            have = {"uses": "uses", "own_uses": "uses", "attached": "attached", "flagged": "flagged"}.get(view, "own")
            if gathered is None or have not in gathered.columns or (view in ("own", "own_uses") and "members" not in tables):
                continue
            if home == "message":
                inside += wanted
                continue
            names = {w for p in wanted for w in (p.src, p.dst, *re.findall(r"\w+", p.where or ""))}
            rows = _flat(gathered, view, home, names, tasks)
        elif view not in tables:
            continue
        else:
            rows = tables[view]
            if view == "links":
                rows = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
            rows = rows.repartition(_tasks(rows, rows.count()), home) if home else rows
        # conditions and the other ends see strings, as in edges()
        spelled = [F.col(c) if c == "opens" else F.col(c).cast("string").alias(c) for c in rows.columns]
        rows = rows.select(*([F.col(home).alias("home")] if home else []), *spelled)
        ends = lambda p: {"other": p.dst if p.src == home else p.src} if home else {"src": p.src, "dst": p.dst}  # noqa: E731, B023
        value = lambda p: F.struct(F.lit(pivots.index(p)).alias("pivot"), *[F.col(c).alias(n) for n, c in ends(p).items()])  # noqa: E731, B023
        each = F.array_compact(F.array(*[F.when(F.expr(p.where), value(p)) if p.where else value(p) for p in wanted]))
        if home:
            found = rows.where("home is not null").select("home", F.inline(each)).where("other is not null").distinct()
            frames.append((found, "home", "other") if from_home else (found, "other", "home"))
        else:
            frames.append((rows.select(F.inline(each)).where("src is not null and dst is not null").distinct(), "src", "dst"))
    return frames, gathered, inside


def _with_names(found: DataFrame, pivots: list[Pivot], *more: str) -> DataFrame:
    named = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("src_kind", "name", "dst_kind", "edge"), _kind(p), strict=True)]) for p in pivots]), F.col("pivot") + 1)
    shape = [c for c in SHAPE if c in ("src_kind", "src", "name") or "dst" in found.columns]
    return found.withColumn("named", named).select(*[c if c in ("src", "dst") else f"named.{c}" for c in shape], *more)


def all_counts(tables: dict[str, DataFrame], pivots: Iterable[Pivot] = PIVOTS) -> DataFrame:
    """counts(edges(tables, pivots)), by less shuffling."""
    pivots = list(pivots)
    if not _gathers(pivots):
        return counts(edges(tables, pivots))
    frames, gathered, inside = _settled(tables, pivots)
    found = [f.groupBy("pivot", src).agg(F.count("*").alias("n")).select("pivot", F.col(src).cast("string").alias("src"), "n") for f, src, _ in frames]
    of = lambda p: F.struct(F.lit(pivots.index(p)).alias("pivot"), F.col("message").cast("string").alias("src"), F.size(_values(p.dst)).cast("long").alias("n"))
    rows = gathered.where("message is not null") if inside else None
    if own := [p for p in inside if p.src == "message"]:
        found.append(rows.select(F.inline(F.array(*map(of, own)))).where("n > 0"))
    if other := [p for p in inside if p.src != "message"]:
        found.append(rows.select(F.inline(_sources(pivots, other))).groupBy("pivot", "src").agg(F.count("*").alias("n")))
    if not found:
        raise ValueError("none of the pivots has its tables")
    return _with_names(reduce(DataFrame.unionByName, found), pivots, "n")


def _sources(pivots: list[Pivot], wanted: list[Pivot]) -> Column:
    """The nodes that reach a gathered message, by pivot."""
    named = lambda number: lambda x: F.struct(F.lit(number).alias("pivot"), x.cast("string").alias("src"))
    return F.concat(*[F.transform(_values(p.src), named(pivots.index(p))) for p in wanted])


def all_pages(tables: dict[str, DataFrame], size: int, number: int = 0, pivots: Iterable[Pivot] = PIVOTS) -> DataFrame:
    """page(edges(tables, pivots), size, number), by less shuffling."""
    pivots = list(pivots)
    if not _gathers(pivots):
        return page(edges(tables, pivots), size, number)
    frames, gathered, inside = _settled(tables, pivots)
    rows = gathered.where("message is not null") if inside else None
    if other := [p for p in inside if p.src != "message"]:
        frames.append((rows.select(F.inline(_sources(pivots, other)), F.col("message").alias("dst")), "src", "dst"))
    upto = (F.col("place") > size * number) & (F.col("place") <= size * (number + 1))
    found = []
    for f, src, dst in frames:
        edge = f.withColumn("by", F.col(dst).cast("string"))
        edge = edge.withColumn("place", F.row_number().over(W.partitionBy("pivot", src).orderBy("by"))).where(upto)
        found.append(edge.select("pivot", F.col(src).cast("string").alias("src"), F.col("by").alias("dst"), "place"))
    of = lambda p: F.struct(F.lit(pivots.index(p)).alias("pivot"), F.slice(F.array_sort(_values(p.dst).cast("array<string>")), size * number + 1, size).alias("dsts"))
    if own := [p for p in inside if p.src == "message"]:
        each = rows.select(F.col("message").cast("string").alias("src"), F.inline(F.array(*map(of, own))))
        found.append(each.select("pivot", "src", F.posexplode("dsts").alias("at", "dst")).select("pivot", "src", "dst", (F.col("at") + size * number + 1).alias("place")))
    if not found:
        raise ValueError("none of the pivots has its tables")
    return _with_names(reduce(DataFrame.unionByName, found), pivots, "place")
