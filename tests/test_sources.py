"""Sources and sinks round trip."""

from pyspark.sql import functions as F

from sonde.sources import files


def test_messages(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"actor_key":"a","platform_groupid":"g","platform_msgid":"1","body":"hi","sent_at_source":"2024-01-01T00:00:00Z"}\nnot json\n')
    assert [r["body"] for r in files.read_messages(spark, str(tmp_path / "m.jsonl")).collect()] == ["hi"]


def test_audit(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_text("<html>x</html>")
    (tmp_path / "b.pdf").write_text("%PDF-1.4")
    assert sorted(r["kind"] for r in files.audit(spark, str(tmp_path)).collect()) == ["html", "pdf"]


def test_sinks(spark, tmp_path):
    df = spark.range(4).withColumn("p", F.col("id") % 2)
    files.write_records(df, str(tmp_path / "r"), "p")
    files.write_records(df, str(tmp_path / "r"), "p")
    assert spark.read.parquet(str(tmp_path / "r")).distinct().count() == 4
    files.write_features(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4
    files.write_labels(df, spark.range(2), "id", str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
