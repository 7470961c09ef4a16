"""Rules over nested and delimited texts, written of each order's lines and customers, against the tables' own values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.operators import matchers
from sonde.queries import query
from sonde.sources.tables import load

RULES = [
    {"id": "lines_vdf", "type": "vdf", "family": "nested", "path_glob": "**/*.vdf", "requires_keys": ["order"], "pivot": "$.order", "paths": {"line": "$key", "part": "$.Part", "note": "$.Note", "flag": "$.State.Flag"}},
    {"id": "lines_yaml", "type": "yaml", "family": "nested", "path_glob": "**/*.yaml", "strip_before": "order:", "pivot": "$.order.lines", "paths": {"line": "$.number", "part": "$.part.id", "note": "$.note", "flag": "$.flags[1]"}},
    {"id": "lines_tsv", "type": "delimiter", "family": "flat", "path_glob": "**/*.tsv", "separator": "\t", "min_columns": 4, "columns": {0: "line", 1: "part", 2: "note", 3: "flag"}},
    {"id": "lines_text", "type": "template", "family": "flat", "path_glob": "**/*.txt", "template": "#{line}: part {part} ({note}) is {flag}"},
]
#: A line in each form, the text around all of them, and the ending of its path.
FORMS = {
    "vdf": ("concat('\"', l_linenumber, '\" { \"Part\" \"', l_partkey, '\" // \"x\" \"y\"\\n \"Note\" \"say \\\\\"', l_linestatus, '\\\\\"\" State { Flag ', l_returnflag, ' } }\\n')", "concat('\"order\"\\n{\\n', body, '}')"),
    "yaml": ("concat('  - number: ', l_linenumber, '\\n    part:\\n      id: ', l_partkey, ' # key\\n    note: ''say \"', l_linestatus, '\"''\\n    flags:\\n    - no\\n    - ', l_returnflag, '\\n')", "concat('a banner [x]\\n\\norder:\\n  lines:\\n', body)"),
    "tsv": ("concat(l_linenumber, '\\t', l_partkey, '\\tsay \"', l_linestatus, '\"\\t', l_returnflag, '\\r\\n')", "concat('too\\tshort\\n\\n', body)"),
    "txt": ("concat('#', l_linenumber, ': part ', l_partkey, ' (say \"', l_linestatus, '\") is ', l_returnflag, '\\n')", "concat('lines of an order\\n', body)"),
}


@query(
    """
SELECT CASE l_orderkey % 4 WHEN 0 THEN 'lines_vdf' WHEN 1 THEN 'lines_yaml' WHEN 2 THEN 'lines_tsv' ELSE 'lines_text' END AS rule_id, CASE WHEN l_orderkey % 4 < 2 THEN 'nested' ELSE 'flat' END AS family,
       l_orderkey, l_linenumber::VARCHAR AS line, l_partkey::VARCHAR AS part, 'say "' || l_linestatus || '"' AS note, l_returnflag AS flag
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1
"""
)
def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's lines, written in one of four forms and read back by rules that know only the form."""
    one = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_returnflag", "l_linestatus"))
    # dealt by order once: the window and the groups find their rows where they are
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").repartition("l_orderkey").withColumn("rn", one).where("rn = 1")
    names = list(FORMS)

    def form(of) -> Column:
        """The value of the order's form; the other forms are not worked out."""
        return reduce(lambda case, k: case.when(F.col("l_orderkey") % 4 == k, of(names[k])), range(1, 4), F.when(F.col("l_orderkey") % 4 == 0, of(names[0])))

    texts = lines.select("l_orderkey", "l_linenumber", form(lambda n: F.expr(FORMS[n][0])).alias("line")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))).alias("lines"))
    texts = texts.select("l_orderkey", F.array_join("lines.line", "").alias("body"))
    files = texts.select("l_orderkey", F.concat(F.lit("dir/sub/order."), form(F.lit)).alias("path"), form(lambda n: F.expr(FORMS[n][1])).alias("text"))
    found = matchers.run(files, "l_orderkey", "path", "text", RULES)
    return found.select("rule_id", "family", "l_orderkey", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in ("line", "part", "note", "flag")])

