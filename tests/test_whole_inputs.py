"""Queries that must take every row of their input."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_line_is_joined(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert lines and entry.queries()["j4_every_line"](spark, SF).count() == lines


def test_direction_of_age(spark):
    from lodeworks.operators import survival

    rows = [("a", float(i), int(i < 20)) for i in range(60)] + [("b", float(i % 10), int(i >= 50)) for i in range(60)]
    rows += [("few", float(i), i % 2) for i in range(49)] + [("none", float(i), 0) for i in range(60)]
    aucs = survival.age_auc(spark.createDataFrame(rows, "cutoff string, age double, label int"))
    assert sorted(map(tuple, aucs.collect())) == [("a", 60, 20, 0.0, True), ("b", 60, 10, 0.5, False)]
    assert tuple(survival.age_direction(aucs).first()) == (2, 1, "oldest_first")
    assert survival.age_direction(aucs.where("inverted")).first()["direction"] == "youngest_first"


def test_doubled_hazard_is_not_the_floor(spark):
    from lodeworks.operators import curves

    curve = spark.createDataFrame([(b, 200, y) for b, y in enumerate([0.1, 0.15, 0.2, 0.4])], "bucket int, exposure long, yearly double")
    assert tuple(curves.rising_from(curve, 100).first()) == (0.1, 2.0)
    assert tuple(curves.rising_from(curve.where("bucket < 2"), 100).first()) == (0.1, 5.0)
    assert "a22_doubled_from" in entry.queries()
