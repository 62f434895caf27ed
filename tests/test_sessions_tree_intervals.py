import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.operators import intervals, sessions, tree

T0 = datetime(2020, 1, 1)
DAY0 = 18262


def test_sessions_against_brute_force(spark):
    rnd = random.Random(2)
    data = [(rnd.choice(["A", "A", "A", "B", None]), rnd.choice([None, T0 + timedelta(days=rnd.randrange(4000), hours=rnd.randrange(24))]), "x") for _ in range(400)]
    want = set()
    for a in "AB":
        days = sorted({(t - T0).days + DAY0 for k, t, _ in data if k == a and t})
        n = {d: sum(1 for k, t, _ in data if k == a and t and (t - T0).days + DAY0 == d) for d in days}
        group = [days[0]]
        for d in [*days[1:], None]:
            if d is None or d - group[-1] > 45:
                want.add((a, group[0], group[-1], group[-1] - group[0] + 1, sum(n[x] for x in group)))
                group = []
            group.append(d)
    df = spark.createDataFrame(data, "k string, at timestamp_ntz, entity string")
    for chunk in (1, 7, 365, 100_000):
        assert {tuple(r) for r in sessions.sessions(df, "k", "at", 45, chunk).collect()} == want
    assert sessions.sessions(df.limit(0), "k", "at").count() == 0


def test_a_gap_of_exactly_the_limit_does_not_end_a_session(spark):
    at = lambda d: ("A", T0 + timedelta(days=d))
    df = spark.createDataFrame([at(0), at(45), at(91)], "k string, at timestamp_ntz")
    assert sorted((r.first_day - DAY0, r.last_day - DAY0) for r in sessions.sessions(df, "k", "at", 45).collect()) == [(0, 45), (91, 91)]


@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_tree_totals(spark, fan_in):
    rnd = random.Random(5)
    data = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice(["u", None]), rnd.choice([1.5, -2.25, None, float("nan")]), rnd.choice([None, T0 + timedelta(days=rnd.randrange(50))]), "n") for _ in range(500)]
    df = spark.createDataFrame(data, "a string, b string, x double, at timestamp_ntz, node string").repartition(13)
    got = {(r.field_name, r.key_value): (r.n, r.total, r.first_at, r.last_at) for r in tree.key_totals(df, ["a", "b"], "x", "at", fan_in).collect()}
    want = {}
    for i, f in enumerate(("a", "b")):
        for key in {d[i] for d in data}:
            g = [d for d in data if d[i] == key]
            t = [d[3] for d in g if d[3]]
            want[f, key] = (len(g), sum(d[2] for d in g if d[2] is not None and d[2] == d[2]), min(t, default=None), max(t, default=None))
    assert got == want
    heavy = {(r.field_name, r.key_value) for r in tree.heavy_keys(tree.key_totals(df, ["a", "b"], "x", "at", fan_in), df, 0.2).collect()}
    assert heavy == {k for k, v in want.items() if k[1] is not None and v[0] > 0.2 * len(data)}
    empty = df.limit(0)
    assert tree.key_totals(empty, ["a"], "x", "at").count() == 0 and tree.heavy_keys(tree.key_totals(empty, ["a"], "x", "at"), empty).count() == 0


def test_rounds():
    assert [tree.rounds_of(n, 4) for n in (0, 1, 4, 5, 16, 17)] == [1, 1, 1, 2, 2, 3]


def test_a_key_comes_once_whatever_the_plan_becomes(spark):
    """A join whose pruned side is broadcast runs in more partitions than the plan has at first."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 25_000)
    try:
        rows = spark.range(0, 200_000, 1, 40).withColumn("k", F.col("id") % 5)
        small = spark.range(5).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 20_000).alias("wide"))
        df = rows.join(small, "k")
        for how in ({}, {"fan_in": 2}, {"fan_in": 2, "rounds": 4}, {"rounds": 1}):
            got = tree.tree_aggregate(df, ["k"], {"n": F.count("*")}, {"n": F.sum}, **how).collect()
            assert sorted(tuple(r) for r in got) == [(k, 40_000) for k in range(5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def days_of(periods):
    return {(int(e), d) for e, s, t in periods for d in range(int(s), int(t) + 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 300), st.integers(0, 90)), max_size=40))
def test_dyadic_union(items):
    e, s = np.array([i[0] for i in items], np.int64), np.array([i[1] for i in items], np.int64)
    t = s + np.array([i[2] for i in items], np.int64)
    blocks = intervals.blocks_of(e, s, t)
    assert days_of(zip(blocks[0], blocks[2] << blocks[1], ((blocks[2] + 1) << blocks[1]) - 1)) == days_of(zip(e, s, t))
    merged = intervals.siblings_merged(*intervals.without_covered(*blocks))
    spans = list(zip(merged[0], merged[2] << merged[1], ((merged[2] + 1) << merged[1]) - 1))
    assert sum(b - a + 1 for _, a, b in spans) == len(days_of(spans)) == len(days_of(zip(e, s, t)))  # disjoint
    assert not {(x, lv, i ^ 1) for x, lv, i in zip(*map(np.ndarray.tolist, merged))} & set(zip(*map(np.ndarray.tolist, merged)))  # no pair of siblings is left
    periods = list(zip(*map(np.ndarray.tolist, intervals.united(e, s, t))))
    assert days_of(periods) == days_of(zip(e, s, t)) and periods == sorted(periods)
    assert all(a[0] != b[0] or b[1] > a[2] + 1 for a, b in zip(periods, periods[1:]))


def test_periods_and_gaps(spark):
    d = lambda n: datetime(2020, 1, 1) + timedelta(days=n)
    data = [("A", d(0), d(3)), ("A", d(4), d(5)), ("A", d(9), d(9)), ("A", d(9), d(9)), ("A", d(5), d(1)), (None, d(0), d(1)), ("A", None, d(1)), ("A", d(1), None), ("B", d(0), d(40_000))]
    df = spark.createDataFrame([(*r, "x") for r in data], "a string, s timestamp_ntz, t timestamp_ntz, kind string")
    got = sorted((r.entity, r.kind, r.day_from - DAY0, r.day_to - DAY0) for r in intervals.periods_and_gaps(df, "a", "s", "t").collect())
    assert got == [("A", "gap", 6, 8), ("A", "period", 0, 5), ("A", "period", 9, 9), ("B", "period", 0, 40_000)]
    assert intervals.periods_and_gaps(df.limit(0), "a", "s", "t").count() == 0


def test_entities_across_batches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(intervals, "BATCH_ROWS", 5)
    rnd = random.Random(1)
    rows = sorted((rnd.choice("ABCD"), s := rnd.randrange(200), s + rnd.randrange(9)) for _ in range(90))
    batches = [pa.RecordBatch.from_pydict({"k": [r[0] for r in rows[i : i + 4]], "s": [r[1] for r in rows[i : i + 4]], "t": [r[2] for r in rows[i : i + 4]]}) for i in range(0, 90, 4)]
    out = [r for b in intervals._final(iter(batches)) for r in b.to_pylist()]
    got = [(r["k"], r["s"], r["t"]) for r in out if r["kind"] == "period"]
    assert len(got) == len(set(got)) and {(k, d) for k, s, t in got for d in range(s, t + 1)} == {(k, d) for k, s, t in rows for d in range(s, t + 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20_000), st.integers(0, 14_000)), min_size=1, max_size=20))
def test_cells_put_together_are_the_intervals(items):
    s = np.array([a for a, _ in items])
    t = s + np.array([n for _, n in items])
    at, cell, lo, hi = intervals.by_cell(s, t)
    for i in range(len(s)):
        parts = sorted(zip(lo[at == i], hi[at == i]))
        assert parts[0][0] == s[i] and parts[-1][1] == t[i] and all(b[0] == a[1] + 1 for a, b in zip(parts, parts[1:])) and len(parts) <= 3
    size = 1 << intervals.CELL
    assert all(a // size == b // size == c if c >= 0 else a % size == 0 and (b + 1) % size == 0 for a, b, c in zip(lo, hi, cell))


@pytest.mark.parametrize("rows", [7, 200_000])
@pytest.mark.parametrize("fan_in", [2, 1024])
def test_long_lives_of_a_hot_entity(spark, monkeypatch, rows, fan_in):
    monkeypatch.setattr(intervals, "BATCH_ROWS", rows)
    rnd = random.Random(rows)
    data = [(rnd.choice(["hot"] * 5 + ["a", "b"]), s := rnd.randrange(-30_000, 90_000), s + rnd.choice([0, 1, 30, 5_000, 20_000][: rnd.choice([3, 3, 3, 5])])) for _ in range(400)]
    day = F.date_from_unix_date
    df = spark.createDataFrame(data, "k string, s int, t int").repartition(9).select("k", day("s").alias("s"), day("t").alias("t"))
    got = sorted(tuple(r) for r in intervals.periods_and_gaps(df, "k", "s", "t", fan_in).collect())
    want = []
    for k in ("a", "b", "hot"):
        open_ = None
        for s, t in [*sorted((s, t) for e, s, t in data if e == k), (10**9, 10**9)]:
            if open_ and s <= open_[1] + 1:
                open_ = (open_[0], max(open_[1], t))
                continue
            if open_:
                want.append((k, "period", *open_))
                if s < 10**9:
                    want.append((k, "gap", open_[1] + 1, s - 1))
            open_ = (s, t)
    assert got == sorted(want)


def test_no_amount_is_zero(spark):
    (r,) = tree.key_totals(spark.createDataFrame([("a", None, None)], "a string, x double, at timestamp_ntz"), ["a"], "x", "at").select(F.col("total"), "first_at").collect()
    assert r.total == 0.0 and r.first_at is None
