"""Readers, file reports, sinks, sampling and merging, in new folders."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import normalise_names
from plumbline.sources import files, sinks


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, delimiter):
    path = tmp_path / "d.csv"
    path.write_text(f"col1{delimiter}col2{delimiter}col3\nval1{delimiter}val2{delimiter}val3\n")
    report = files.file_report(spark, str(path)).first()
    assert report.is_valid and report.delimiter == delimiter and report.column_count == 3 and report.row_count == 1
    assert files.read_csv(spark, str(path)).first()[:] == ("val1", "val2", "val3")


def test_malformed_empty_and_absent_files(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b,c\n1,2\n1,2,3,4\n")
    report = files.file_report(spark, str(bad), ",").first()
    assert not report.is_valid and "column count" in report.errors
    empty = tmp_path / "empty.csv"
    empty.touch()
    assert "empty" in files.file_report(spark, str(empty)).first().errors
    with pytest.raises(FileNotFoundError):
        files.file_report(spark, str(tmp_path / "none.csv"))


def test_types_null_words_and_names(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Id, Total Value($) ,Flag,Code,Size,id\n1, 2.5,true,10d,NULL,9\n2,n/a,false,20,3,9\n,,,,,\n")
    df = files.read_csv(spark, str(path))
    assert df.dtypes == [("id", "bigint"), ("total_value___", "double"), ("flag", "boolean"), ("code", "string"), ("size", "bigint")]
    assert df.count() == 2 and df.filter("size IS NULL").count() == 1
    assert normalise_names([" A  b!", "C"]) == ["a_b_", "c"]


def test_latin1_file(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes("id,name\n1,José\n".encode("latin-1"))
    assert files.choose_encoding(spark, str(path)) == "ISO-8859-1"
    assert files.read_csv(spark, str(path)).first().name == "José"


def test_schema_and_inference_mean_the_same(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("id,qty,note\n1234567890123456789, 3 ,N/A\n1234567890123456788,oops,a b\n7,,null\n")
    schema = "id bigint, qty int, note string"
    rows = files.read_csv(spark, str(path), schema=schema, errors="unread").orderBy("id").collect()
    assert [tuple(r)[:3] for r in rows] == [(7, None, None), (1234567890123456788, None, "a b"), (1234567890123456789, 3, None)]
    assert [r.unread for r in rows] == [{}, {"qty": "oops"}, {}]
    with pytest.raises(Exception, match="oops"):
        files.read_csv(spark, str(path), schema=schema).collect()
    found = files.read_csv(spark, str(path))
    assert dict(found.dtypes) == {"id": "decimal(38,0)", "qty": "string", "note": "string"}
    assert {int(r.id) for r in found.collect()} == {1234567890123456789, 1234567890123456788, 7}
    (tmp_path / "m.csv").write_text("v\n1.5\n1234567890123456789\n")
    assert files.read_csv(spark, str(tmp_path / "m.csv")).dtypes == [("v", "string")]


def test_every_file_is_judged_by_itself(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;name\n1;Zoë\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("id,name\n2,Zoë\n".encode())
    (tmp_path / "c.csv").write_bytes("id|name\n3|Zoë – “q”\n".encode("windows-1252"))
    (tmp_path / "late.csv").write_bytes(b"id,name\n" + b"4,plain\n" * 300 + "5,Zoë\n".encode("latin-1"))
    paths = [str(tmp_path / f"{n}.csv") for n in ("a", "b", "c", "late")]
    assert files.judge_files(spark, paths) == [(";", "ISO-8859-1"), (",", "UTF-8"), ("|", "windows-1252"), (",", "ISO-8859-1")]
    names = {r.id: r.name for r in files.read_csv(spark, paths).where("id <> 4").collect()}
    assert names == {1: "Zoë", 2: "Zoë", 3: "Zoë – “q”", 5: "Zoë"}


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,note\n1,"two\nlines"\n2,one\n')
    assert {tuple(r) for r in files.read_csv(spark, str(path), multi_line=True).collect()} == {(1, "two\nlines"), (2, "one")}


def test_file_facts(spark, tmp_path):
    for name in ("One.csv", "two.csv"):
        (tmp_path / name).write_text("a,b\n1,2\n")
    facts = files.file_facts(spark, str(tmp_path))
    assert {r.content_hash for r in facts.collect()} == {hashlib.sha256(b"a,b\n1,2\n").hexdigest()}
    assert files.duplicate_uploads(facts).first().copies == 2
    assert facts.filter("file_name = 'One.csv'").first().dataset_id.startswith("one_")


def test_json_forms_and_suffixes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_any(spark, str(tmp_path / "a.json"), array=True).count() == 2
    (tmp_path / "b.tsv").write_text("a\tb\n1\tx\n")
    assert files.read_any(spark, str(tmp_path / "b.tsv")).first()[:] == (1, "x")


def test_fixed_sample_equals_brute_force(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    want = sorted(range(500), key=lambda k: (hashlib.md5(f"42-{k}".encode()).hexdigest(), k))[:50]
    got = [r.k for r in files.fixed_sample(df.repartition(5), "k", 50).collect()]
    assert sorted(got) == sorted(want)
    assert files.fixed_sample(df, "k", 1000).count() == 500


def test_staging_replaces_only_given_days(spark, tmp_path):
    def days(*rows):
        return spark.createDataFrame(rows, "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))

    root = str(tmp_path)
    sinks.stage_by_day(days((1, "2024-01-01 05:00:00"), (2, "2024-01-02 05:00:00")), root, "t", "ts")
    path = sinks.stage_by_day(days((3, "2024-01-02 23:59:59")), root, "t", "ts")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]
    assert [r.id for r in sinks.read_incremental(spark, path, "ts", "2024-01-02").collect()] == [3]


def test_upsert_keeps_and_clears(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, since string, v string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "z")], "k long, since string, v string")
    got = sorted(tuple(r) for r in sinks.upsert(old, new, ["k"], keep=["since"]).collect())
    assert got == [(1, "a", "x"), (2, "b", None), (3, "d", "z")]


def test_incremental_range_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = sinks.changed_on(df, "o_orderdate", "1998-10-03")
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
