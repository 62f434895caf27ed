import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import accounts, conform, coverage, curves, episodes, flows, generate, metrics, ordered, resolve, rules, survival

T0 = datetime(2020, 1, 1)
at = lambda d: T0 + timedelta(days=d)


def test_join_many_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "p")], "k int, y string")
    assert sorted((r.x, r.y) for r in conform.join_many_to_one(left, right, ["k"]).collect()) == [("a", "p"), ("b", None), ("c", None)]
    with pytest.raises(Exception, match="not unique"):
        conform.join_many_to_one(left, right.union(right), ["k"]).collect()


def test_keep_latest_ties_and_nulls(spark):
    rows = [(1, "k", at(1)), (2, "k", at(2)), (3, "k", at(2)), (4, "k", None), (5, None, at(9)), (6, "n", None)]
    df = spark.createDataFrame(rows, "id bigint, key string, at timestamp_ntz")
    assert sorted(r.id for r in conform.keep_latest(df, F.col("key"), "at", "id").collect()) == [2, 6]


def test_missingness_counts_null_groups_apart_from_the_total(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (None, None)], "fy int, c string")
    got = {(r.fy, r.overall): (r.rows, r.null_rate) for r in conform.missingness(df, ["c"], "fy").collect()}
    assert got == {(1, False): (1, 1.0), (None, False): (2, 0.5), (None, True): (3, 2 / 3)}


def test_optional_existing_and_suffixed(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert conform.only_existing(df, ["b", "z"]).columns == ["b"]
    assert conform.suffixed(df, ["a"], "_cx").columns == ["a_cx", "b"]
    assert conform.optional_table(spark, "/nowhere", "a int").count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 200])
def test_ordered(spark, n):
    rnd = random.Random(n)
    data = [(i, rnd.choice([None, 1, 2, 3, 9])) for i in range(n)]
    df = spark.createDataFrame(data, "id int, v int").repartition(5)
    key = lambda r: (-(r[1] if r[1] is not None else -1), r[0])
    want = {r[0]: i for i, r in enumerate(sorted(data, key=key), 1)}
    assert {r.id: r.rank for r in ordered.ranked(df, ["-v", "id"]).collect()} == want
    vals = sorted(r[1] for r in data if r[1] is not None)
    avg = {x: sum(i for i, y in enumerate(vals, 1) if y == x) / vals.count(x) for x in set(vals)}
    assert {r.id: r.avg_rank for r in ordered.average_ranks(df, "v").collect()} == {i: avg.get(x) for i, x in data}
    bins = ordered.equal_count_bins(df.select("id"), ["id"], 5).collect()
    assert {r.id: r.bin for r in bins} == {i: max(1, math.ceil(i * 5 / (n - 1))) if n > 1 else 1 for i in range(n)}


def test_coverage_against_brute_force(spark):
    rnd = random.Random(8)
    data = [(i, rnd.choice(["A", "B", None]), rnd.choice([None, at(rnd.randrange(3000))]), rnd.choice("mh")) for i in range(250)]
    df = spark.createDataFrame(data, "id int, a string, at timestamp_ntz, kind string")
    got = {r.id: r.covered for r in coverage.covered(df, ["a"], "at", F.col("kind") == "m", F.col("kind") == "h", 40, "covered").collect()}
    want = {i: any(x[1] == a and x[3] == "m" and x[2] and abs((x[2] - t).days) <= 40 for x in data) if a and t else False for i, a, t, k in data if k == "h"}
    assert got == want


def test_anchored_clusters_against_brute_force(spark):
    rnd = random.Random(9)
    data = [(i, rnd.choice("ABC"), at(rnd.randrange(900))) for i in range(120)]
    got = {r.id: r.cluster for r in coverage.anchored_clusters(spark.createDataFrame(data, "id int, a string, at timestamp_ntz"), "a", "at", 90).collect()}
    for a in "ABC":
        c, anchor = 0, None
        for i, _, t in sorted((r for r in data if r[1] == a), key=lambda r: (r[2], r[0])):
            if anchor is None or (t - anchor).days > 90:
                c, anchor = c + 1, t
            assert got[i] == c


def test_distinct_so_far(spark):
    rnd = random.Random(10)
    data = [(f"k{i:03}", rnd.choice("AB"), at(rnd.randrange(60)), float(i), rnd.choice(["v", "w", "x", None])) for i in range(80)]
    eps = episodes.episodes(spark.createDataFrame(data, "id string, a string, at timestamp_ntz, x double, vendor string"), "a", "at", "x", {}, ["vendor"], "id")
    rows = episodes.running_features(eps, [], ["vendor"], date(2020, 2, 1)).orderBy("account", "day").collect()
    for a in "AB":
        seen = set()
        for r in (r for r in rows if r.account == a):
            first = min((d for d in data if d[1] == a and d[2].date() == r.day and d[4]), default=(0,) * 5)[4]
            seen |= {first} - {0}
            assert r.vendor_so_far == len(seen)


def test_gaps_are_censored_at_the_boundary(spark):
    eps = spark.createDataFrame([("A", date(2020, 1, 1)), ("A", date(2020, 1, 11)), ("A", date(2021, 1, 1)), ("B", date(2020, 3, 1))], "account string, day date")
    got = sorted((r.account, r.day.isoformat(), r.duration, r.event) for r in episodes.gaps(eps, date(2020, 3, 1)).collect())
    assert got == [("A", "2020-01-01", 10.0, 1), ("A", "2020-01-11", 50.0, 0), ("B", "2020-03-01", 0.5, 0)]


def test_lookups_on_a_curve(spark):
    curve = spark.createDataFrame([(10.0, 1.0), (20.0, 2.0), (100.0, 4.0)], "t double, v double")
    df = spark.createDataFrame([(x,) for x in [None, 0.0, 10.0, 15.0, 60.0, 100.0, 500.0]], "x double")
    step = [r.v for r in curves.step_lookup(df, "x", curve, "t", "v", 0.0, "v").orderBy("x").collect()]
    line = [r.v for r in curves.interpolated(df, "x", curve, "t", "v", 0.0, "v").orderBy("x").collect()]
    assert step == [None, 0.0, 1.0, 1.0, 2.0, 4.0, 4.0] and line == [None, 0.0, 1.0, 1.5, 3.0, 4.0, 4.0]


def test_nelson_aalen_by_hand(spark):
    g = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (3.0, 1)], "duration double, event int")
    got = [(r.t, r.events, r.at_risk, round(r.cumulative, 6)) for r in curves.nelson_aalen(g).orderBy("t").collect()]
    assert got == [(1.0, 1, 4, 0.25), (2.0, 1, 3, 0.583333), (3.0, 1, 1, 1.583333)]


def test_metrics_on_edges(spark):
    empty = spark.createDataFrame([], "y int, p double, id int")
    assert metrics.auc(empty, "y", "p").first().auc is None
    ones = spark.createDataFrame([(1, 0.5, 1), (1, 0.6, 2)], "y int, p double, id int")
    assert metrics.auc(ones, "y", "p").first().auc is None and metrics.spearman(ones, "y", "p").first().spearman is None
    rnd = random.Random(3)
    data = [(rnd.randrange(2), rnd.choice([0.1, 0.2, 0.3, 0.7]), i) for i in range(60)]
    pairs = [(p > q) + (p == q) / 2 for y, p, _ in data if y for z, q, _ in data if not z]
    assert metrics.auc(spark.createDataFrame(data, "y int, p double, id int"), "y", "p").first().auc == pytest.approx(sum(pairs) / len(pairs))


def numeric_cox(t, d, x, e, ridge, ties):
    """(coefficient, variance) by Newton with plain loops, one standardised feature."""
    z, b = (x - x.mean()) / x.std(), 0.0
    for _ in range(50):
        g, h = -ridge * len(t) * b, ridge * len(t)
        for u in sorted(set(t[d > 0])):
            r, own = (t >= u) & ((e < u) if e is not None else True), (t == u) & (d > 0)
            w, k = np.exp(b * z), own.sum()
            for step in range(k):
                v = w * (r - (step / k) * own) if ties == "efron" else w * r
                m = (v * z).sum() / v.sum()
                h += (v * z**2).sum() / v.sum() - m * m
                g -= m
            g += z[own].sum()
        b += g / h
    return b, 1 / h


@pytest.mark.parametrize("ties", ["efron", "breslow"])
@pytest.mark.parametrize("late", [False, True])
def test_cox_against_plain_loops(spark, late, ties):
    rng = np.random.default_rng(4)
    n = 60
    x = rng.normal(size=n)
    t = np.ceil(rng.exponential(np.exp(-0.8 * x)) * 20) + 1
    d = (rng.random(n) < 0.7).astype(int)
    e = np.floor(t * rng.random(n) * 0.6) if late else None
    rows = [(float(a), int(b), float(c), float(f) if late else None) for a, b, c, f in zip(t, d, x, e if late else t)]
    df = spark.createDataFrame(rows, "t double, d int, x double, e double")
    model = survival.fit_cox(df, "t", "d", ["x"], entry="e" if late else None, penalty=0.01, ties=ties)
    beta, variance = numeric_cox(t, d, x, e, 0.01, ties)
    assert model.beta[0] == pytest.approx(beta, abs=1e-6) and model.variance[0, 0] == pytest.approx(variance, rel=1e-5)
    assert model.beta[0] > 0.3 and (np.diff(model.hazard) >= 0).all()
    row = model.coefficients(spark).first()
    assert row.low < row.beta_raw < row.high and row.z == pytest.approx(row.beta_raw / row.se) and 0 <= row.p < 0.1


@pytest.mark.parametrize("late", [False, True])
def test_robust_errors_against_plain_loops(spark, late):
    rng = np.random.default_rng(9)
    n = 50
    x = rng.normal(size=n)
    t = rng.permutation(n) + 2.0  # no ties
    d = (rng.random(n) < 0.6).astype(int)
    e = np.floor(t * rng.random(n) * 0.5) if late else np.zeros(n)
    df = spark.createDataFrame([(float(a), int(b), float(c), float(f)) for a, b, c, f in zip(t, d, x, e)], "t double, d int, x double, e double")
    how = dict(entry="e" if late else None, penalty=0.0)
    plain, model = survival.fit_cox(df, "t", "d", ["x"], **how), survival.fit_cox(df, "t", "d", ["x"], robust=True, **how)
    z, b = (x - x.mean()) / x.std(), plain.beta[0]
    w = np.exp(b * z)
    meat = 0.0
    for i in range(n):
        total = 0.0
        for j in np.flatnonzero(d):
            r = (t >= t[j]) & (e < t[j])
            m = (w * z * r).sum() / (w * r).sum()
            total += (z[i] - m) * ((i == j) - (w[i] / (w * r).sum() if r[i] else 0.0))
        meat += total**2
    assert model.variance[0, 0] == pytest.approx(plain.variance[0, 0] ** 2 * meat, rel=1e-6)


@pytest.mark.parametrize("blocks", [2, 5, 64])
@pytest.mark.parametrize("kind", ["ties", "fine", "hot"])
def test_concordance_against_pairs(spark, blocks, kind):
    rnd = random.Random(6)
    draw = {"ties": lambda: (float(rnd.randrange(1, 20)), rnd.choice([0.1, 0.2, 0.3])), "fine": lambda: (rnd.random(), rnd.random()), "hot": lambda: (rnd.choice([5.0, 5.0, rnd.random() * 9]), rnd.choice([0.5, 0.5, rnd.random()]))}[kind]
    data = [(t, rnd.randrange(2), s) for _ in range(150) for t, s in [draw()]] + [(None, 1, 0.5), (3.0, None, 0.5), (3.0, 1, None)]
    whole = [x for x in data if None not in x]
    pairs = [(p, q) for t, d, p in whole if d for u, c, q in whole if u > t or u == t and not c]
    r = survival.concordance(spark.createDataFrame(data, "t double, d int, s double"), "t", "d", "s", blocks).first()
    assert (r.pairs, r.right, r.tied) == (len(pairs), sum(p > q for p, q in pairs), sum(p == q for p, q in pairs))


def test_concordance_of_nothing(spark):
    assert survival.concordance(spark.createDataFrame([], "t double, d int, s double"), "t", "d", "s").collect() == [(0, 0, 0, None)]


def test_which_score_is_used(spark):
    rows = [(i, int(i % 3 == 0), 0.9 if i % 3 == 0 else 0.1, 0.5 + (i % 7) / 100) for i in range(60)]
    r = survival.preferred(spark.createDataFrame(rows, "k int, y int, p double, q double"), "y", "p", "q", "k").first()
    assert (r.auc_model, r.by_brier, r.by_error) == (1.0, "model", "model") and r.mean_error == pytest.approx(abs(22 / 60 - 20 / 60), abs=0.05)
    none = survival.preferred(spark.createDataFrame([], "k int, y int, p double, q double"), "y", "p", "q", "k").first()
    assert (none.by_brier, none.by_error) == ("baseline", "baseline")


def test_lifetimes_reasons_in_order(spark):
    d = lambda y: datetime(y, 1, 1)
    rows = [(1, None, d(2000)), (2, d(2000), d(1999)), (3, d(1960), d(1970)), (4, d(2010), None), (5, d(1960), d(2000)), (6, d(2030), None), (7, d(2000), d(2040))]
    got = {r.k: (r.drop_reason, r.event, r.left_truncated) for r in survival.lifetimes(spark.createDataFrame(rows, "k int, i timestamp_ntz, r timestamp_ntz"), "k", "i", "r", date(1975, 1, 1), date(2026, 1, 1)).collect()}
    assert got == {1: ("no_install", None, None), 2: ("removed_before_install", None, None), 3: ("removed_before_window", None, None), 4: (None, 0, False), 5: (None, 1, True), 6: ("no_time_observed", None, None), 7: (None, 0, False)}


def test_lifetimes_known_at_a_cutoff(spark):
    d = lambda y: datetime(y, 1, 1)
    life = survival.lifetimes(spark.createDataFrame([(1, d(2000), d(2020)), (2, d(2019), None), (3, d(2000), d(2005))], "k int, i timestamp_ntz, r timestamp_ntz"), "k", "i", "r", date(1975, 1, 1), date(2026, 1, 1))
    got = {r.k: (round(r.seen_until), r.seen_gone) for r in survival.cut_at(life, "i", "r", date(2010, 1, 1)).collect()}
    assert got == {1: (10, 0), 3: (5, 1)}
    assert survival.prefer_model({"auc": 0.9, "brier": 0.1}, {"auc": 0.8, "brier": 0.2}) == "model"
    assert survival.prefer_model({"auc": 0.9, "brier": 0.3}, {"auc": 0.8, "brier": 0.2}) == "baseline"


def test_resolver_outcomes(spark):
    known = spark.createDataFrame([(1, "ACME ROCKETS", "E1"), (2, "ZENITH PUMPS", "E2"), (3, "ZENITH PUMPS", "E3"), (4, "NORTHERN LIGHT STEEL", "E4"), (5, "NORTHERN LIGHTS STEEL", "E5")], "id bigint, norm string, entity string")
    asked = spark.createDataFrame([(11, "ACME ROCKETS"), (12, "ZENITH PUMPS"), (13, "ACME ROCKET ROCKETS"), (14, "NORTHERN STEEL LIGHT LIGHTS"), (15, "QUITE OTHER")], "id bigint, norm string")
    got = {r.id: (r.entity, r.outcome) for r in resolve.match_names(asked, known).collect()}
    assert got == {11: ("E1", "exact"), 12: (None, "ambiguous"), 13: ("E1", "fuzzy"), 14: (None, "ambiguous"), 15: (None, "unresolved")}


def test_misspelled_and_common_words_get_candidates(spark):
    """An unknown word meets rare ones a letter away; names of common words meet by the two rarest, unknown words or not."""
    known = [(i, "SYSTEMS GROUP") for i in range(6)] + [(10, "ACME SYSTEMS"), (11, "GLOBAL SYSTEMS GROUP"), (12, "ZENITH")]
    asked = [(100, "ACMEE SYSTEMS"), (101, "QXWZK SYSTEMS GROUP"), (102, "ZENIT"), (103, "NOTHING LIKE IT"), (104, "ACM")]
    got = {tuple(r) for r in resolve.candidates(spark.createDataFrame(asked, "id int, norm string"), spark.createDataFrame(known, "id int, norm string"), most=3).collect()}
    assert got == {(100, 10), (102, 12)} | {(101, i) for i in range(6)}


def test_rules_and_actions(spark):
    c = spark.createDataFrame([("A", f"id{i:02}", float(i)) for i in range(20)] + [("B", "x", 5.0), (None, "y", 1.0)], "acct string, id string, x double")
    mk = lambda code, pri, trig, tag="DERIVED": rules.Rule(code, pri, c, "acct", trig, "id", F.col("x"), F.lit("a long enough text"), tag)
    plays = rules.all_fired([mk("LATE", 5, F.col("x") > 3), mk("FIRST", 1, F.col("x") > 15), mk("MADE_UP", 0, F.lit(True), "SYNTHETIC")])
    late = plays.where("code = 'LATE' and entity = 'A'").first()
    assert late.evidence_count == 16 and len(late.evidence.split(";")) == 12 and late.value == sum(range(4, 20))
    acts = {r.entity: (r.action, r.codes, r.fired) for r in rules.actions(spark.createDataFrame([("A",), ("B",), ("C",)], "acct string"), "acct", plays).collect()}
    assert acts == {"A": ("FIRST", "MADE_UP;FIRST;LATE", 3), "B": ("LATE", "MADE_UP;LATE", 2), "C": ("NO_ACTION", "", 0)}
    newest = rules.fired(rules.Rule("NEWEST", 1, c.union(c), "acct", F.col("x") > 3, "id", F.col("x"), F.concat(F.col("evidence_count"), F.lit(" ids")), order=-F.col("x"), most=3)).where("entity = 'A'").first()
    assert (newest.evidence, newest.evidence_count, newest.value, newest.detail) == ("id19;id18;id17", 16, 2.0 * sum(range(4, 20)), "16 ids")
    assert {r.code: r.low_information for r in rules.selectivity(plays, 3).collect()} == {"LATE": False, "FIRST": False, "MADE_UP": False}


def test_quantiles_are_exact(spark):
    rnd = random.Random(2)
    data = [(rnd.choice([None, float(rnd.randrange(6))]), rnd.random() * 9, None) for _ in range(333)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = conform.quantiles(df, {"x": ("a", 0.5), "y": ("b", 0.9), "z": ("b", 0.0), "w": ("c", 0.5)}).first()
    for name, (c, q) in {"x": (0, 0.5), "y": (1, 0.9), "z": (1, 0.0)}.items():
        assert got[name] == pytest.approx(float(np.quantile([d[c] for d in data if d[c] is not None], q)))
    assert got.w is None


def test_lookups_by_several_columns(spark):
    left = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), (None, 1, 0)], "x string, y int, v int")
    table = spark.createDataFrame([("a", 1, "p"), ("a", 1, "o"), (None, 1, "n")], "k string, l int, v string")
    other = spark.createDataFrame([(2, "q")], "m int, v string")
    df = conform.first_match(left, [(table, ["x", "y"], ["k", "l"]), (other, ["y"], ["m"])], "v", "found")
    assert df.columns == ["x", "y", "v", "found"] and sorted((r.x or "", r.y, r.found) for r in df.collect()) == [("", 1, None), ("a", 1, "o"), ("a", 2, "q")]
    keys = spark.createDataFrame([(" a ", 1), (None, 2), (None, None), (" ", None)], "x string, y int").select(conform.joined_key(F.col("x"), F.col("y")))
    assert [r[0] for r in keys.collect()] == ["a|1", "|2", None, None]


def test_flows(spark):
    subs = spark.createDataFrame([("p", 10.0, "s1", "u1"), ("p", 30.0, "s2", "u2"), ("q", 5.0, None, None), (None, 1.0, "s", "u1"), ("gone", 1.0, "s", "u1")], "key string, x double, name string, uei string")
    primes = spark.createDataFrame([("p", 10.0), ("q", 0.0)], "key string, own double")
    labels = spark.createDataFrame([("u1", True), ("u2", False)], "uei string, label boolean")
    got = {r.key: (r.subs, r.names, r.flow, r.passthrough, r.true_share) for r in flows.prime_flows(subs, primes, "key", "x", "name", "own", labels, "uei", "label").collect()}
    assert got == {"p": (2, 2, 40.0, 3.0, 0.25), "q": (1, 0, 5.0, None, None)}


def test_generated_values_follow_from_key_and_seed(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string")
    make = lambda df, seed: {(r.k, r.month): r.utilisation for r in generate.telemetry(df, "k", F.lit(0.5), date(2023, 10, 1), 36, seed).collect()}
    a, b, other = make(keys, 1), make(keys.repartition(7), 1), make(keys, 2)
    assert a == b != other and len(a) == 50 * 36 and all(0.05 <= x <= 0.99 for x in a.values())
    n = spark.range(20_000).select(generate.poisson(5, F.lit(3.0), F.col("id")).alias("n"), generate.normal(5, F.col("id")).alias("z")).agg(F.avg("n"), F.var_samp("n"), F.avg("z"), F.var_samp("z")).first()
    assert n == pytest.approx((3, 3, 0, 1), abs=0.1)


def test_last_n_limits_each_account(spark):
    df = spark.createDataFrame([("A", i) for i in range(9)] + [(None, 1), ("B", 1)], "a string, x int")
    assert sorted((r.a, r.x) for r in accounts.last_n(df, "a", [F.desc("x")], 2).collect()) == [("A", 7), ("A", 8), ("B", 1)]
