"""Records of nested settings (VDF, a block subset of YAML), read in Arrow batches: one pass over a text's tokens or lines, which carries the open keys.

Spark's own folds work every expression out anew wherever it is used, and without generated code: some 600 microseconds for a few lines of YAML.
Patterns are those of Spark's functions: ASCII classes, and Java's line ends.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ENDS = "\n\r\u0085\u2028\u2029"
BLANK, MARKS = " \t\n\r\f\v", "#\u0085\u2028\u2029"
DOT = f"[^{ENDS}]"
END = rf"(?=(?:\r\n|[{ENDS}])?\Z)"
VDF_TOKEN = re.compile(rf'//[^\n]*|"(?:[^"\\]|\\{DOT})*"|[{{}}]|[^\s{{}}"]+', re.A)
ESCAPED = re.compile(r'\\(["\\])')
YAML_ITEM = re.compile(rf"(?<!{DOT})([ ]*)-([ ]+)(\S)", re.A)
YAML_SKIP = re.compile(rf"\s*(?:#{DOT}*)?{END}", re.A)
YAML_DASH = re.compile(rf"\s*-\s*{END}", re.A)
YAML_ENTRY = re.compile(rf"""\s*(?:"([^"]*)"|'([^']*)'|([^\s#'"\[{{][^#]*?))\s*:(?:\s+({DOT}*))?{END}""", re.A)
COMMENT = re.compile(rf"(?:^|\s)#{DOT}*{END}", re.A)
QUOTED = re.compile(rf"""\s*(?:"({DOT}*)"|'({DOT}*)')\s*(?:#{DOT}*)?{END}""", re.A)
LINE = re.compile(r"\r?\n")
#: Values that stand for none.
NONE = {"~", "null", "Null", "NULL", ""}

Paths = Iterator[tuple[list[str], str | None]]


def vdf(text: str) -> Paths:
    """(path, value) of every quoted or bare value: keys, braces and // comments."""
    open_: list[str] = []
    key = None
    for t in VDF_TOKEN.findall(text):
        if t.startswith("//"):
            continue
        if t == "{":
            open_, key = [*open_, key or ""], None
        elif t == "}":
            open_, key = open_[:-1], None
        else:
            bare = ESCAPED.sub(r"\1", t[1:-1]) if t[0] == '"' else t
            if key is None:
                key = bare
            else:
                yield [*open_, key], bare
                key = None


def scalar(value: str) -> str | None:
    """A value without quotes or trailing comment; words for none are null, all others stay as they are written (NO is no boolean)."""
    quoted = QUOTED.match(value) if '"' in value or "'" in value else None
    if quoted:
        return quoted[1] if quoted[1] is not None else quoted[2].replace("''", "'")
    plain = (COMMENT.sub("", value) if "#" in value else value).strip(" ")
    return None if plain in NONE else plain


@functools.lru_cache(8192)  # settings repeat their lines
def said(line: str) -> tuple[int, bool, str | None, bool, str | None] | None:
    """(level, whether an item, key, whether it holds a value, the value) of a line; null where it says nothing."""
    bare = line.strip(BLANK)  # cheap looks first, patterns where these leave it open
    if not bare or line.startswith(("---", "...")) or (bare[0] in MARKS and YAML_SKIP.match(line)):
        return None
    item = bare == "-" or (bare[0] == "-" and YAML_DASH.match(line) is not None)
    level = 2 * (len(line) - len(line.lstrip(" "))) + item  # an item may stand as far left as the key of its list
    if item:
        return level, True, None, False, None
    entry = YAML_ENTRY.match(line) if ":" in line else None
    key = (entry[1] or "") + (entry[2] or "") + (entry[3] or "") if entry else None
    value = (entry[4] or "") if entry else line
    holds = value.strip(" ") != ""
    return level, False, key, holds, scalar(value) if holds else None


def yaml(text: str) -> Paths:
    """(path, value) of block mappings and sequences, by indentation; an item's key is its number. Anchors and flow collections stay text."""
    for _ in range(3):  # an item and what it holds go on lines of their own; a list in a list takes another turn
        text, moved = YAML_ITEM.subn(r"\1-\n\1 \2\3", text)
        if not moved:
            break
    open_: list[tuple[int, str]] = []  # levels rise
    for line in LINE.split(text):
        what = said(line)
        if what is None:
            continue
        level, item, key, holds, value = what
        before = None
        while open_ and open_[-1][0] >= level:
            at, last = open_.pop()
            before = last if at == level else None
        if item:
            key = "0" if before is None else str(int(before) + 1)
        if key is not None:
            open_.append((level, key))
        if holds:
            yield [k for _, k in open_], value


def steps(path: str) -> list[str]:
    """$.a.b[0] as its keys."""
    return [p for p in re.split(r"[.\[\]]", path.removeprefix("$")) if p]


def picked(paths: Iterable[tuple[list[str], str | None]], pick: dict[str, str], pivot: str | None = None) -> list[dict[str, str]]:
    """Fields picked by path ($key: the record's own key); with a pivot one record for each child of it, else one of the whole.

    The pairs stand in the text's order: a record ends where the next child begins. The first of equal paths holds.
    """
    top = steps(pivot) if pivot else []
    n, skip = len(top), len(top) + 1 if pivot else 0
    wanted = {tuple(steps(path)): name for name, path in reversed(pick.items()) if path != "$key"}
    keyed = [name for name, path in pick.items() if path == "$key"]
    out: list[tuple[str, dict[str, str]]] = []
    child = None
    for path, value in paths:
        if path[:n] != top:
            continue
        here = (path[n] if n < len(path) else None) if pivot else ""
        if here is None:
            child = None
            continue
        if here != child:
            child, fields = here, {}
            out.append((child, fields))
        name = wanted.get(tuple(path[skip:]))
        if name is not None and value is not None:
            fields.setdefault(name, value)
    records = (dict.fromkeys(keyed, child) | fields for child, fields in out)
    return [r for r in records if r]


def records(text: Column, kind: str, pick: dict[str, str], pivot: str | None = None, requires: list[str] = ()) -> Column:
    """The records of texts of a kind, vdf or yaml; null texts give null, those without a required top key none."""
    read = {"vdf": vdf, "yaml": yaml}[kind]

    def one(raw: str | None) -> list[list[tuple[str, str]]] | None:
        if raw is None:
            return None
        paths = list(read(raw))
        if not set(requires) <= {p[0] for p, _ in paths if p}:
            return []
        return [list(r.items()) for r in picked(paths, pick, pivot)]

    def batch(rows: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in rows.to_pylist()], pa.list_(pa.map_(pa.string(), pa.string())))

    return F.arrow_udf(batch, "array<map<string,string>>")(text)
