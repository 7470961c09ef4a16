"""Matchers on hand-written texts of the kinds that rules meet."""

import pytest
from pyspark.sql import functions as F

from sonde.functions import nested
from sonde.operators import matchers

VDF = '''
"users" // accounts
{
	"7656"  { "AccountName" "on\\"ch\\\\ie"  Auto 1  "deep" { "a" { "b" "c" } } }
	"7657"
	{
		"AccountName"	"second"
	}
}
"other" "x"
'''
YAML = """banner [t.me/x]

build:   # first
  tag: pup
  country: NO
  elevated: true
  nothing: ~
  ratio: .inf
os:
  user-name: 'It''s'
  anti-virus:
  - name: Windows Defender
    state: active
  - name: "Other: one # two"
hardware:
  gpu:
    - 'Intel(R) HD'
    -   - nested
        - list
  'quoted key': 42   # note
list:
- a: 1
"""

CASES = [
    ({"type": "vdf", "requires_keys": ["users"], "pivot": "$.users", "paths": {"id": "$key", "name": "$.AccountName", "auto": "$.Auto", "deep": "$.deep.a.b"}}, VDF,
     [{"id": "7656", "name": 'on"ch\\ie', "auto": "1", "deep": "c"}, {"id": "7657", "name": "second"}]),
    ({"type": "vdf", "requires_keys": ["missing"], "paths": {"x": "$.other"}}, VDF, []),
    ({"type": "vdf", "paths": {"x": "$.other"}}, VDF, [{"x": "x"}]),
    ({"type": "yaml", "strip_before": "build:", "requires_keys": ["build", "os"], "paths": {
        "tag": "$.build.tag", "country": "$.build.country", "elevated": "$.build.elevated", "none": "$.build.nothing", "ratio": "$.build.ratio", "user": "$.os.user-name",
        "av": "$.os.anti-virus[0].name", "state": "$.os.anti-virus[0].state", "av2": "$.os.anti-virus[1].name", "gpu": "$.hardware.gpu[0]", "inner": "$.hardware.gpu[1][1]", "q": "$.hardware.quoted key", "a": "$.list[0].a"}}, YAML,
     [{"tag": "pup", "country": "NO", "elevated": "true", "ratio": ".inf", "user": "It's", "av": "Windows Defender", "state": "active", "av2": "Other: one # two", "gpu": "Intel(R) HD", "inner": "list", "q": "42", "a": "1"}]),
    ({"type": "yaml", "pivot": "$.os.anti-virus", "paths": {"n": "$key", "name": "$.name"}}, YAML, [{"n": "0", "name": "Windows Defender"}, {"n": "1", "name": "Other: one # two"}]),
    ({"type": "delimiter", "separator": "|", "min_columns": 2, "columns": {0: "a", 2: "c"}}, "1|2|3\n\nshort\n4|5\r\n", [{"a": "1", "c": "3"}, {"a": "4"}]),
    ({"type": "template", "template": "[{pid}] {name}.exe"}, "[12] run (x).exe\nnoise\n[7] b.exe", [{"pid": "12", "name": "run (x)"}, {"pid": "7", "name": "b"}]),
    ({"type": "regex", "pattern": r"^(?P<url>https?://[^\s;]+);(?P<user>[^;\s]+);(?P<rest>\S+)$", "multiline": True}, "https://a.b/c;x;y\nhttps://d;e;f g\nhttp://h;i;j", [{"url": "https://a.b/c", "user": "x", "rest": "y"}, {"url": "http://h", "user": "i", "rest": "j"}]),
    ({"type": "regex", "pattern": r"(?m)^FORM:\s*(?P<k>[^\n]+)\nVALUE:\s*(?P<v>[^\n]+)$"}, "FORM: a\nVALUE: b\n\nnoise\nFORM: c\nVALUE: d", [{"k": "a", "v": "b"}, {"k": "c", "v": "d"}]),
    ({"type": "keyvalue", "separator": ": ", "requires_keys": ["HWID"], "keys": {"HWID": "hwid", "Build ID": "build", "C2 URL": "c2"}}, "hwid:  AB-1 \nC2 URL: https://x:8443/p\nHWID: second\nBuild  ID: no", [{"hwid": "AB-1", "c2": "https://x:8443/p"}]),
    ({"type": "keyvalue", "separator": ": ", "requires_keys": ["HWID"], "keys": {"HWID": "hwid", "IP": "ip"}}, "IP: 1.2.3.4", []),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_matchers(spark, k):
    rule, text, wanted = CASES[k]
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    found = [r[0] for r in df.select(matchers.match(rule, F.col("t"))).collect()]
    assert found[0] == wanted
    assert not found[1] and not found[2]


def test_rules_run_by_path_and_escape_nul(spark):
    rule = {"id": "r", "family": "f", "path_glob": "**/*.txt", "type": "keyvalue", "separator": ": ", "keys": {"User": "user"}}
    df = spark.createDataFrame([(1, "a/b.txt", "User: x\0y"), (2, "a/b.md", "User: z"), (3, None, None)], "k int, p string, t string")
    assert [tuple(r) for r in matchers.run(df, "k", "p", "t", [rule]).collect()] == [(1, "r", "f", 0, {"user": "x\\x00y"})]


def test_nested_texts_are_read_in_one_pass(spark):
    """No fold of Spark's over tokens or lines, which works each expression out anew wherever it is used."""
    df = spark.createDataFrame([(YAML,)], "t string")
    for kind in ("yaml", "vdf"):
        rule = {"type": kind, "pivot": "$.list", "paths": {"a": "$.a"}}
        plan = df.select(matchers.match(rule, F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan and "ArrowEvalPython" in plan


def test_line_ends_are_those_of_java():
    assert list(nested.yaml("a: 1 # x \r\nb:\n- 'it''s'\r\n-\n  c: ~\n#\n---\nlone\u0085")) == [(["a"], "1"), (["b", "0"], "it's"), (["b", "1", "c"], None), ([], "lone\u0085")]
    assert list(nested.vdf('k { a "\\\\" } // }\n} x y "un')) == [(["k", "a"], "\\"), (["x"], "y")]
