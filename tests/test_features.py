import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodeworks.operators import features

SCHEMA = "a string, type string, at timestamp_ntz, x double, entity int"
ARGS = ("a", "type", "at", "x")
T0 = datetime(2020, 1, 1)


def brute(data):
    out = {}
    for a, t, at, x, _ in data:
        if a is not None:
            k = (t or "").strip(" ").upper() or None
            n, s, d = out.get((a, k), (0, 0.0, None))
            day = (at - datetime(1970, 1, 1)).days if at else None
            good = x is not None and x == x and abs(x) != float("inf")
            out[a, k] = (n + 1, round(s + (x if good else 0), 6), max(filter(lambda v: v is not None, [d, day]), default=None))
    return out


def table(df):
    return {(r.entity, r.type): (r.n, float(r.total), r.last_day) for r in df.collect()}


def rows(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice(["A", "A", "B", None]), rnd.choice(["p", " P ", "q", "", None]), rnd.choice([None, T0 + timedelta(days=rnd.randrange(9))]), rnd.choice([None, float("nan"), float("inf"), -3.25, 0.1, 2.0]), i) for i in range(n)]


def test_retractions_equal_a_fresh_build(spark):
    for seed in range(4):
        data, rnd = rows(120, seed), random.Random(seed)
        gone = [r for r in data if rnd.random() < 0.4]
        new = rows(30, seed + 50)
        left = [r for r in data if r not in gone] + new
        make = lambda d, s=1: features.changes(spark.createDataFrame(d, SCHEMA), *ARGS, sign=s)  # noqa: E731, B023
        start = features.built(make(data))
        assert table(start) == brute(data)
        after = features.maintained(start, make(gone, -1).unionByName(make(new)), make(left))
        assert table(after) == brute(left)


def test_rows_of_features(spark):
    df = features.per_entity(features.built(features.changes(spark.createDataFrame(rows(200, 7), SCHEMA), *ARGS)), F.lit(20_000))
    for r in df.collect():
        assert len(r.types) == len(r.counts) == len(r.days_since) == len(r.totals) and r.types == sorted(r.types)
    only = features.changes(spark.createDataFrame([("A", None, None, None, 1)], SCHEMA), *ARGS)
    (r,) = features.per_entity(features.built(only), F.lit(0)).collect()
    assert (r.entity, r.events, r.types) == ("A", 1, [])
    assert features.per_entity(features.built(only.limit(0)), F.lit(0)).count() == 0
