import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeworks.operators.asof import known_at

EVENTS = "id int, acct string, at timestamp_ntz, version_id string"
VERSIONS = "version_id bigint, acct string, eff timestamp_ntz, rec timestamp_ntz, region string"
T0 = datetime(2020, 1, 1)


def run(spark, events, versions, **how):
    df = known_at(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), "acct", "at", "eff", "rec", "version_id", ["region"], prefix="known_", **how)
    return {r.id: (r.known_version_id, r.known_region) for r in df.collect()}, df


def brute(events, versions):
    out = {}
    for i, a, t, _ in events:
        ok = [x for x in versions if a is not None and t is not None and x[1] == a and x[2] is not None and x[3] is not None and x[2] <= t and x[3] <= t]
        best = max(ok, key=lambda x: (x[2], x[3], -1 if x[0] is None else x[0]), default=None)
        out[i] = (best[0], best[4]) if best else (None, None)
    return out


def test_against_brute_force(spark):
    rnd = random.Random(1)
    day = lambda: T0 + timedelta(hours=rnd.randrange(0, 24 * 400))
    versions = [(i, rnd.choice("ABC"), day(), day(), rnd.choice(["N", "S", None])) for i in range(80)]
    versions += versions[:10] + [(900, None, day(), day(), "x"), (901, "A", None, day(), "x"), (902, "A", day(), None, "x")]
    events = [(i, rnd.choice(["A", "A", "A", "B", "C", "D", None]), rnd.choice([day(), day(), None, versions[3][2]]), "clash") for i in range(300)]
    for chunk in (0.125, 1, 64, 5000):
        got, df = run(spark, events, versions, chunk_days=chunk)
        assert got == brute(events, versions)
        assert df.count() == len(events)


def test_a_version_entered_at_the_very_moment_counts_and_a_later_one_does_not(spark):
    versions = [(1, "A", T0, T0, "first"), (2, "A", T0, T0 + timedelta(microseconds=1), "late")]
    got, _ = run(spark, [(1, "A", T0, None), (2, "A", T0 + timedelta(days=900), None)], versions)
    assert got == {1: (1, "first"), 2: (2, "late")}


def test_clashing_names_repeated_rows_and_empty_tables(spark):
    events = spark.createDataFrame([(1, "A", T0, "x")] * 3, "k int, acct string, at timestamp_ntz, region string")
    versions = spark.createDataFrame([(5, "A", T0, T0, "N")], VERSIONS)
    df = known_at(events, versions, "acct", "at", "eff", "rec", "version_id", ["region"])
    assert df.columns == ["k", "acct", "at", "region", "version_id", "_region"]
    assert [tuple(r) for r in df.collect()] == [(1, "A", T0, "x", 5, "N")] * 3
    assert known_at(events.limit(0), versions, "acct", "at", "eff", "rec", "version_id", []).count() == 0
    assert known_at(events, versions.limit(0), "acct", "at", "eff", "rec", "version_id", []).where("version_id is null").count() == 3


KINDS = ["date", "timestamp_ntz", "timestamp"]


@pytest.mark.parametrize("event_kind", KINDS)
@pytest.mark.parametrize("version_kind", KINDS)
def test_types_of_time_on_either_side(spark, event_kind, version_kind):
    """A day is its midnight: what was recorded later that day is not known at it."""
    rnd = random.Random(8)
    at = lambda kind: (lambda t: t if kind != "date" else datetime(t.year, t.month, t.day))(T0 + timedelta(days=rnd.randrange(40), hours=rnd.choice([0, 18])))
    events = [(i, rnd.choice("AB"), at(event_kind), "clash") for i in range(60)]
    versions = [(i, rnd.choice("AB"), at(version_kind), at(version_kind), f"r{i}") for i in range(40)]
    e = spark.createDataFrame(events, EVENTS).withColumn("at", F.col("at").cast(event_kind))
    v = spark.createDataFrame(versions, VERSIONS).withColumn("eff", F.col("eff").cast(version_kind)).withColumn("rec", F.col("rec").cast(version_kind))
    df = known_at(e, v, "acct", "at", "eff", "rec", "version_id", ["region"], prefix="known_")
    assert {r.id: (r.known_version_id, r.known_region) for r in df.collect()} == brute(events, versions)
    assert df.schema["at"].dataType.simpleString() == event_kind


def test_a_version_of_later_that_day_is_not_known_on_a_date(spark):
    e = spark.createDataFrame([(1, "A", T0.date())], "id int, acct string, at date")
    v = spark.createDataFrame([(7, "A", T0, T0 + timedelta(hours=18), "late")], VERSIONS)
    assert known_at(e, v, "acct", "at", "eff", "rec", "version_id", []).first().version_id is None


def test_a_million_times_of_one_account_in_one_day(spark):
    """Hours share them out; every event gets the version of its own second."""
    e = spark.range(1_000_000).select("id", F.lit("A").alias("acct"), F.timestamp_micros(F.lit(1577836800000000) + F.col("id") * 86_000).alias("at"))
    v = spark.range(0, 86_400, 600).select(F.col("id").alias("version_id"), F.lit("A").alias("acct"), F.timestamp_seconds(F.lit(1577836800) + F.col("id")).alias("eff"))
    df = known_at(e, v.withColumn("rec", F.col("eff")), "acct", "at", "eff", "rec", "version_id", [])
    want = F.floor(F.col("id") * 86_000 / 600_000_000) * 600
    got = df.agg(F.count("*").alias("n"), F.sum((F.col("version_id") == want).cast("int")).alias("right")).first()
    assert tuple(got) == (1_000_000, 1_000_000)
