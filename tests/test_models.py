"""Edges of the models that queries over test tables don't have: nulls, ties, nothing at all."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import values
from lodeworks.operators import accounts, episodes, generate, resolve, rules, sessions
from lodeworks.plans import governance
from lodeworks.sources import readers
from lodeworks.sources.shared import Files, scope, settle

T0 = datetime(2020, 1, 1)


def test_names_under_several_keys(spark):
    rows = [("n", "k1"), ("n", "k2"), ("n", "k2"), ("m", "k1"), (None, "k3"), ("n", None)]
    df = spark.createDataFrame(rows, "name string, key string")
    assert [tuple(r) for r in resolve.conflicts(df, "name", "key").collect()] == [("n", 2, "k2;k1", "2;1")]
    assert [tuple(r) for r in resolve.shared_forms(df, "name", "key").collect()] == [("n", 2, "k1;k2")]
    assert resolve.conflicts(df.limit(0), "name", "key").count() == 0


def test_grading_counts_known_pairs_only(spark):
    parents = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "P"), ("d", "Q"), ("e", None)], "k string, p string")
    flagged = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "d"), ("a", "e")], "a string, b string")
    r = resolve.graded(flagged, parents, "k", "p").first()
    assert (r.flagged, r.tp, r.fp, r.fn, r.families, r.true_pairs) == (3, 1, 1, 2, 1, 3) and r.precision == 0.5 and r.recall == pytest.approx(1 / 3)
    none = resolve.graded(flagged.limit(0), parents.limit(0), "k", "p").first()
    assert (none.tp, none.precision, none.recall) == (0, 0.0, 0.0)


def test_first_seen(spark):
    df = spark.createDataFrame([("c", "late", 2), ("c", "first", 1), ("d", None, 1), (None, "x", 0)], "k string, v string, o int")
    assert sorted(tuple(r) for r in resolve.first_seen(df, "k", "v", "o", "d").collect()) == [("c", "first"), ("d", None)]


def test_retention_by_hand(spark):
    at = lambda y, m: datetime(y, m, 1)
    rows = [("a", at(2020, 1)), ("a", at(2020, 11)), ("b", at(2020, 2)), ("b", at(2023, 1)), (None, at(2020, 1)), ("c", None)]
    got = sorted(tuple(r) for r in accounts.retention(spark.createDataFrame(rows, "k string, t timestamp_ntz"), "k", "t", date(2023, 6, 1)).collect())
    assert got == [(2020, 2, 1, 2020, 2, 1.0), (2020, 2, 1, 2021, 1, 0.5), (2020, 2, 1, 2023, 1, 0.5)]


def test_sides_default_to_zero(spark):
    acc = spark.createDataFrame([("a",), ("b",)], "k string")
    covered = spark.createDataFrame([("a", True), ("a", False)], "k string, covered boolean")
    renewals = spark.createDataFrame([("a", "x", 5.0, T0, 2), ("a", "x", None, T0, 2)], "k string, key string, amount double, end timestamp_ntz, cluster_size int")
    gaps = spark.createDataFrame([("a",)], "k string")
    a, b = accounts.with_sides(acc, "k", covered, renewals, gaps).orderBy("k").collect()
    assert tuple(a) == ("a", 2, 1, 1, 0.5, 1, 5.0, T0.date(), True, 1) and tuple(b) == ("b", 0, 0, 0, None, 0, 0.0, None, False, 0)


def test_rates_fall_back_to_the_mean(spark):
    gaps = spark.createDataFrame([(5.0, 1), (6.0, 0), (50.0, 1)], "duration double, event int")
    at = spark.createDataFrame([(1, 3), (2, 20), (3, 500), (4, None)], "id int, x int")
    got = {r.id: r.rate for r in episodes.rate_at(at, "x", gaps, [0, 10, 40, 100]).collect()}
    assert got == pytest.approx({1: 0.5, 2: 2 / 3, 3: 2 / 3, 4: 2 / 3})


def test_right_closed_bands(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,), (None,)], "x double")
    assert [r[0] for r in df.select(values.bucket(F.col("x"), [0, 1, 2], ["a", "b"], right=True)).collect()] == [None, "a", "b", "b", None, None]


def test_reordered(spark):
    df = spark.createDataFrame([(i, float(i), float(-i), None) for i in range(20)], "k int, x double, y double, z double")
    got = {r.variant: (r.positive, r.shared, r.spearman) for r in rules.reordered(df, "k", F.col("x"), {"same": F.col("x"), "turned": F.col("y"), "none": F.col("z")}, 5).collect()}
    assert got["same"] == (19, 5, pytest.approx(1.0)) and got["turned"] == (0, 0, pytest.approx(-1.0)) and got["none"][:2] == (0, 0)


def test_generated_times_and_health(spark):
    g = spark.range(20_000).select(generate.gamma(3, 2, F.lit(7.0), F.col("id")).alias("x")).agg(F.avg("x"), F.var_samp("x"), F.min("x")).first()
    assert g[0] == pytest.approx(14, rel=0.03) and g[1] == pytest.approx(98, rel=0.06) and g[2] >= 0
    p = spark.range(5_000).select(generate.poisson(3, F.lit(400.0), F.col("id")).alias("x"), generate.poisson(3, F.lit(0.0), F.col("id")).alias("z")).agg(F.avg("x"), F.var_samp("x"), F.max("z")).first()
    assert p[0] == pytest.approx(400, rel=0.01) and p[1] == pytest.approx(400, rel=0.1) and p[2] == 0
    keys = spark.createDataFrame([(f"k{i}", None if i % 5 == 0 else i / 50, i % 2 == 0) for i in range(50)], "k string, level double, idle boolean")
    make = lambda df: {r.k: (r.score, r.band) for r in generate.health(df, "k", F.col("level"), F.lit(None), F.lit(None), F.lit(9), F.lit(1.0), F.col("idle"), 4).collect()}
    a = make(keys)
    assert a == make(keys.repartition(5)) and len(a) == 50 and all(0 <= s <= 100 and b in generate.BANDS for s, b in a.values())


def test_sessions_of_minutes(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "a", "b", None]), rnd.choice([None, T0 + timedelta(seconds=rnd.randrange(40_000), microseconds=rnd.randrange(3))])) for _ in range(300)]
    want = []
    for k in "ab":
        times = sorted(t for e, t in data if e == k and t)
        group = [times[0]]
        for t in [*times[1:], None]:
            if t is None or t - group[-1] > timedelta(minutes=5):
                want.append((k, group[0], group[-1], (group[-1] - group[0]).total_seconds(), len(group)))
                group = []
            group.append(t)
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(data, f"k string, at {kind}")
        for chunk in (timedelta(minutes=1), timedelta(hours=6)):
            got = sorted(tuple(r) for r in sessions.sessions_within_days(df, "k", "at", timedelta(minutes=5), chunk).collect())
            assert got == sorted(want)
    assert sessions.sessions_within_days(df.limit(0), "k", "at", timedelta(minutes=5)).count() == 0


def test_steps_that_are_skipped_or_forced():
    p = governance.Pipeline([governance.Step("a", lambda s: 1), governance.Step("b", lambda s: 2)])
    assert p.run({"a": 9}) == {"a": 9, "b": 2} and p.run({"a": 9}, force=True) == {"a": 1, "b": 2} and p.run({}, skip=("b",)) == {"a": 1}


def test_anchored_assumption(spark):
    reg = governance.assumptions(spark)
    data = spark.createDataFrame([(0.5, "2021"), (0.7, "2023"), (None, "2024")], "x double, at string")
    row = governance.anchored(reg, "R-6", data, "x", "at", "filing").where("id = 'R-6'").first()
    assert (row.value, row.basis) == (0.7, "filing, 2023")
    assert sorted(governance.anchored(reg, "R-6", data.limit(0), "x", "at", "filing").collect()) == sorted(reg.collect())


def test_document_that_is_absent(spark, tmp_path):
    assert readers.json_document(spark, f"{tmp_path}/none", "a int").count() == 0
    assert readers.json_document(spark, f"{tmp_path}/none", "a int", default='{"a": 7}').first().a == 7


def test_settled_tables_go_with_their_scope(spark):
    with scope(spark):
        df = settle(spark.range(3))
        place = df.inputFiles()[0].rsplit("/", 1)[0]
        assert Files(spark, place).exists(place)
    assert not Files(spark, place).exists(place)
