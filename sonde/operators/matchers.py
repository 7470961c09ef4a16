"""Matchers of content rules as expressions: nested settings (VDF, a block subset of YAML), delimited lines, templates, named groups.

Nested texts are read by one pass over their tokens or lines, which carries the open keys (`functions/nested.py`). Every matcher gives
an array of records, map<string, string>, in the order of the text; the first is a rule's primary match. Texts that do not match give an empty array, null texts null.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.functions import nested
from sonde.functions.text import glob_pattern


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def delimited(text: Column, separator: str, columns: dict[int, str], min_columns: int = 1) -> Column:
    """A record for each line of at least so many columns; blank lines are none."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: F.btrim(line) != "")
    rows = F.filter(F.transform(lines, lambda line: F.split(line, re.escape(separator))), lambda r: F.size(r) >= min_columns)
    named = lambda r: F.map_from_arrays(F.array(*map(F.lit, columns.values())), F.array(*[F.get(r, F.lit(k)) for k in columns]))
    return F.transform(rows, lambda r: F.map_filter(named(r), lambda k, v: v.isNotNull()))


def template_pattern(template: str) -> str:
    """`user {name} at {host}` as a pattern of whole lines with named groups."""
    parts = re.split(r"\{(\w+)\}", template)
    return "(?m)^" + "".join(f"(?P<{p}>.+?)" if k % 2 else re.escape(p) for k, p in enumerate(parts)) + r"\r?$"


def named(text: Column, pattern: str, multiline: bool = False) -> Column:
    """A record for each match, from the pattern's named groups."""
    groups = re.compile(pattern).groupindex
    java = ("(?m)" if multiline else "") + pattern.replace("(?P<", "(?<")
    found = [F.regexp_extract_all(text, F.lit(java), F.lit(at)) for at in groups.values()]
    rows = F.arrays_zip(*[f.alias(name) for f, name in zip(found, groups, strict=True)])
    return F.transform(rows, lambda r: F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*[r[name] for name in groups])))


def key_values(text: Column, separator: str, keys: dict[str, str]) -> Column:
    """One record of `key<separator>value` lines; keys in any case, white space at the ends dropped, the first of equal keys holds."""

    def one(lines: Column, key: str) -> Column:
        held = F.filter(lines, lambda line: F.contains(line, F.lit(separator)) & (F.lower(F.btrim(F.substring_index(line, separator, 1))) == key.lower()))
        first = F.get(held, F.lit(0))
        return F.btrim(first.substr(F.instr(first, separator) + len(separator), F.length(first)))

    fields = let(F.split(text, r"\r?\n"), lambda lines: F.map_from_arrays(F.array(*map(F.lit, keys.values())), F.array(*[one(lines, k) for k in keys])))
    kept = F.map_filter(fields, lambda k, v: v.isNotNull())
    return F.when(text.isNotNull(), F.filter(F.array(kept), lambda m: F.size(m) > 0))


def match(rule: dict, text: Column) -> Column:
    """The records of a rule's match and extract parts; a required key that is missing means no match."""
    kind = rule["type"]
    if kind in ("vdf", "yaml"):
        if rule.get("strip_before"):
            at = F.instr(text, rule["strip_before"])
            text = F.when(at > 0, text.substr(at, F.length(text))).otherwise(text)
        return nested.records(text, kind, rule["paths"], rule.get("pivot"), rule.get("requires_keys", []))
    if kind == "delimiter":
        return delimited(text, rule["separator"], rule["columns"], rule.get("min_columns", 1))
    if kind == "template":
        return named(text, template_pattern(rule["template"]))
    if kind == "regex":
        return named(text, rule["pattern"], rule.get("multiline", False))
    if kind == "keyvalue":
        found = key_values(text, rule["separator"], rule["keys"])
        needed = [rule["keys"][k] for k in rule.get("requires_keys", [])]
        return F.filter(found, lambda m: reduce(lambda a, b: a & b, [F.map_contains_key(m, F.lit(k)) for k in needed], F.lit(True)))
    raise ValueError(f"unknown matcher {kind}")


def run(files: DataFrame, key: str, path: str, text: str, rules: list[dict]) -> DataFrame:
    """(key, rule_id, family, nth, fields): every record that each rule finds in the files its glob names, NUL characters escaped."""

    def of(rule: dict) -> Column:
        hit = F.regexp_like(F.col(path), F.lit(glob_pattern(rule["path_glob"])))
        found = F.transform(match(rule, F.when(hit, F.col(text))), lambda m, i: F.struct(i.alias("nth"), F.transform_values(m, lambda k, v: F.replace(v, F.lit("\0"), F.lit("\\x00"))).alias("fields")))
        return F.struct(F.lit(rule["id"]).alias("rule_id"), F.lit(rule.get("family")).cast("string").alias("family"), found.alias("found"))

    rows = files.select(key, F.explode(F.array(*map(of, rules))).alias("r"))
    return rows.select(key, "r.rule_id", "r.family", F.inline("r.found"))
