import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import values
from lodeworks.plans.governance import FIELDS, Pipeline, Step, tagged
from lodeworks.sources import readers, sinks
from lodeworks.sources.shared import settle


def test_zipped_csv_with_line_breaks_and_missing_columns(spark, tmp_path):
    for kind, head, row in (("psc", "id,name", '1,"two\nlines, ""quoted"""'), ("naics", "name,other", "x,y")):
        with zipfile.ZipFile(tmp_path / f"pull_{kind}.zip", "w") as z:
            z.writestr(f"{kind}_prime.csv", f"{head}\n{row}\n")
            z.writestr("readme.txt", "no")
    got = sorted((r.id or "", r["name"], r.member, r.tag) for r in readers.zipped_csv(spark, str(tmp_path), ["id", "name"], r"pull_(\w+)\.zip").collect())
    assert got == [("", "x", "naics_prime.csv", "naics"), ("1", 'two\nlines, "quoted"', "psc_prime.csv", "psc")]


def test_zipped_csv_of_odd_rows(spark, tmp_path):
    """Rows of other numbers of fields, a byte order mark, long fields, blank files and quoted blanks."""
    long = "x" * 300_000
    with zipfile.ZipFile(tmp_path / "pull_a.zip", "w") as z:
        z.writestr("a.csv", "\ufeffid,name,note\n1,short\n2,much,too,long\n3,whole,ok\n4,\"\",\n" + f"5,{long},y\n")
        z.writestr("b.csv", "")
        z.writestr("c.csv", "id,name\n")
    got = sorted(tuple(r) for r in readers.zipped_csv(spark, str(tmp_path), ["id", "name", "note"]).select("id", "name", "note").collect())
    assert got == [("1", "short", None), ("2", "much", "too"), ("3", "whole", "ok"), ("4", None, None), ("5", long, "y")]


def test_routed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x\n1,"a\nb"\n2,oops\n')
    (tmp_path / "b.csv").write_text("id,x\n3,c\n")
    df = readers.routed(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")}, "id int, x string", "pull")
    assert sorted((r.id, r.x, r.pull) for r in df.collect()) == [(1, "a\nb", "a"), (2, "oops", "a"), (3, "c", "b")]


def test_fixed_width(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes("AB  12\n      \nÉ    7\n".encode("latin-1"))
    assert sorted(tuple(r) for r in readers.fixed_width(spark, str(tmp_path / "f.txt"), {"name": (1, 3), "n": (4, 3)}).collect()) == [("AB", "12"), ("É", "7")]


def test_delimited_fails_on_another_number_of_fields(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("a, b\nc,d\n")
    assert sorted(tuple(r) for r in readers.delimited(spark, str(tmp_path / "ok.csv"), ["x", "y"]).collect()) == [("a", "b"), ("c", "d")]
    (tmp_path / "bad.csv").write_text("a,b\nc\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.delimited(spark, str(tmp_path / "bad.csv"), ["x", "y"]).collect()


def test_snapshots_of_changing_columns(spark, tmp_path):
    (tmp_path / "d1.csv").write_text("disk,age,failed\na,1,0\nb,2,1\n")
    (tmp_path / "d2.csv").write_text("failed,note,disk\n0,x,c\n")
    (tmp_path / "d3.csv").write_text("disk,age\nd,1\n")
    (tmp_path / "d4.csv").write_text("")
    got = sorted((r.disk, r.age, r.failed, r.member) for r in readers.snapshots(spark, str(tmp_path), ["disk", "age", "failed"], ["disk", "failed"]).collect())
    assert got == [("a", "1", "0", "d1.csv"), ("b", "2", "1", "d1.csv"), ("c", None, "0", "d2.csv")]


def test_annual_facts_and_ratio(spark):
    fact = lambda s, e, v, filed, form="10-K", fp="FY": dict(start=s, end=e, val=v, filed=filed, form=form, fp=fp)
    rev = [fact("2020-01-01", "2020-12-31", 10, "2021-02-01"), fact("2020-01-01", "2020-12-31", 12, "2022-02-01"), fact("2021-01-01", "2021-12-31", 20, "2022-02-01"), fact("2021-10-01", "2021-12-31", 5, "2022-02-01", "10-Q", "Q4"), fact(None, "2021-12-31", 5, "2022-02-01")]
    doc = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": rev}}, "GrossProfit": {"units": {"USD": [fact("2021-01-01", "2021-12-31", 8, "2022-02-01")]}}}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "j string")
    r = readers.annual_facts(df, "j", "Revenues")
    assert [(x.end, x.value) for x in r.collect()] == [("2021-12-31", 20.0), ("2020-12-31", 12.0)]
    assert [(x.end, x.ratio) for x in readers.period_ratio(r, readers.annual_facts(df, "j", "GrossProfit"), 6).collect()] == [("2021-12-31", 0.4)]


def test_narrative_figures(spark):
    df = spark.createDataFrame([("<p>Backlog of&nbsp;<b>$1,250</b>\n million</p>",), ("nothing",), (None,)], "h string")
    assert [tuple(r) for r in df.select(*readers.narrative_figures(F.col("h"), {"backlog": r"Backlog of \$([\d,]+) million"})).collect()] == [(1250.0,), (None,), (None,)]


def test_landed(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "b.zip").write_bytes(b"<!DOCTYPE html><html>error")
    got = {r.path.rsplit("/", 1)[1]: (r.is_kind, r.looks_html, r.bytes) for r in readers.landed(spark, str(tmp_path)).collect()}
    assert got == {"a.zip": (True, False, 8), "b.zip": (False, True, 26)}


def test_windows_are_clamped():
    assert readers.pull_windows(2016, 2020, 3, date(2016, 1, 1), date(2019, 12, 31)) == [(date(2016, 1, 1), date(2018, 9, 30)), (date(2018, 10, 1), date(2019, 12, 31))]


def test_json_is_safe(spark):
    df = spark.createDataFrame([(float("nan"), 0.12345650001, date(2020, 1, 2), None)], "a double, b double, c date, d string")
    assert json.loads(sinks.json_lines(df).first().value) == {"a": None, "b": 0.123457, "c": "2020-01-02", "d": None}
    assert sinks.as_json({"x": [float("inf"), 1.23456789, datetime(2020, 1, 2)]}) == {"x": [None, 1.234568, "2020-01-02"]}
    assert "</" not in sinks.for_script({"x": "</script>"})


def test_sinks(spark, tmp_path):
    df, path = spark.range(5).toDF("id"), f"file://{tmp_path}/t"
    assert sinks.write_parquet(df, path) and not sinks.write_parquet(df.limit(1), path, force=False)
    assert spark.read.parquet(path).count() == 5
    sinks.write_csv(df, f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 5
    sinks.write_report(df, {"n": 5, "bad": float("nan")}, f"file://{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 5, "bad": None}
    assert sinks.section(df, [F.desc("id")], 2) == {"rows": [{"id": 4}, {"id": 3}], "total": 5, "capped": True}
    a, b = sinks.manifest(df).first(), sinks.manifest(df.repartition(3)).first()
    assert a == b and a.rows == 5


def test_texts(spark):
    amounts = spark.createDataFrame([(None,), (0.0,), (950.0,), (1000.0,), (999_949.0,), (1234567.0,), (-2e9,), (5e12,)], "x double")
    assert [r[0] for r in amounts.select(values.short_dollars(F.col("x"))).collect()] == ["n/a", "$0", "$950", "$1.0k", "$999.9k", "$1.2m", "$-2.0bn", "$5,000.0bn"]
    assert [r[0] for r in spark.createDataFrame([(0.1234,), (None,)], "x double").select(values.percent(F.col("x"), 1)).collect()] == ["12.3%", "n/a"]
    assert sinks.digest({"a": {"b": 1}, "c": 2}, {"x": "a.b", "y": "a.b.c", "z": "c"}) == {"x": 1, "y": None, "z": 2}
    assert sinks.injected("a <!-- m -->old<!-- /m --> b", "m", "new") == "a <!-- m -->\nnew\n<!-- /m --> b"
    with pytest.raises(ValueError):
        sinks.injected("none", "m", "x")
    assert sinks.markdown([{"a": "x|y"}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| x\\|y |  |"


def test_pipeline_and_tags(spark):
    def boom(_):
        raise RuntimeError("no")

    p = Pipeline([Step("a", lambda s: 1), Step("b", boom, critical=False), Step("c", lambda s: s["a"] + 1)])
    assert p.run({}) == {"a": 1, "c": 2} and p.failed == {"b": "RuntimeError: no"}
    assert Pipeline([Step("a", lambda s: 1), Step("c", lambda s: 5)]).run({}, start="c") == {"c": 5}
    with pytest.raises(RuntimeError):
        Pipeline([Step("b", boom)]).run({})
    assert tagged(spark.createDataFrame([(1,)], "account_id int"), "accounts").schema["account_id"].metadata["provenance"].startswith("SOURCED")
    assert len({(t, f) for t, f, *_ in FIELDS}) == len(FIELDS)


def test_settled_tables_end_their_lineage(spark):
    df = settle(spark.range(3).withColumn("x", F.col("id") * 2))
    assert df.count() == 3 and "Range" not in df._jdf.queryExecution().toString()
