"""Time-to-event models: lifetimes with late entry, proportional hazards, concordance, conditional probabilities.

Proportional hazards are fitted by Newton's method on the partial likelihood, ties as Efron or Breslow have them, with a
ridge term. Each step is one aggregate by distinct time of sums over rows; sums over risk sets are reverse cumulative sums of
those, entries taken off again. What reaches the driver is a table of distinct times (days or ages, so a few thousand rows), never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.metrics import auc, brier
from lodeworks.sources.shared import settle


#: Half the width of a 95 % interval in standard errors.
NORMAL_95 = 1.959963984540054


@dataclass(frozen=True)
class Cox:
    """A fitted model: coefficients of standardised features, and the baseline cumulative hazard at distinct times."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    times: np.ndarray
    hazard: np.ndarray
    steps: int
    log_likelihood: float
    #: of the coefficients of standardised features
    variance: np.ndarray

    def score(self) -> Column:
        """The log hazard ratio of a row."""
        total = F.lit(0.0)
        for f, m, s, b in zip(self.features, self.mean, self.scale, self.beta):
            total = total + (F.col(f) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(b))
        return total

    def coefficients(self, spark) -> DataFrame:
        """(feature, beta, beta_raw, se, z, p, low, high): of standardised and, from ``beta_raw`` on, of raw features; the bounds hold 95 %."""
        rows = []
        for f, b, s, v in zip(self.features, self.beta, self.scale, np.diag(self.variance)):
            raw, se = b / s, math.sqrt(max(v, 0.0)) / s
            z = raw / se if se > 0 else None
            rows.append((f, float(b), float(raw), float(se), None if z is None else float(z), None if z is None else math.erfc(abs(z) / math.sqrt(2)), float(raw - NORMAL_95 * se), float(raw + NORMAL_95 * se)))
        return spark.createDataFrame(rows, "feature string, beta double, beta_raw double, se double, z double, p double, low double, high double")

    def baseline(self, spark) -> DataFrame:
        """(t, survival) of the baseline."""
        return spark.createDataFrame([(float(t), float(np.exp(-h))) for t, h in zip(self.times, self.hazard)], "t double, survival double")


def fit_cox(df: DataFrame, duration: str, event: str, features: list[str], entry: str | None = None, penalty: float = 0.1, steps: int = 25, tolerance: float = 1e-7, max_times: int = 100_000, ties: str = "efron", robust: bool = False) -> Cox:
    """Fit on rows with no null among the columns used; ``entry`` is when a row comes under observation (late entry).

    ``penalty`` is the ridge weight per row; ``ties`` is ``efron`` or ``breslow``. The variance is the inverse of the
    penalised information, or with ``robust`` the sandwich of it around the rows' score residuals (one more pass). Raises if
    there are more than ``max_times`` distinct times: round them first.
    """
    p = len(features)
    rows = df.select(F.col(duration).cast("double").alias("t"), (F.col(entry).cast("double") if entry else F.lit(None).cast("double")).alias("e"), F.col(event).cast("double").alias("d"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).where(F.col("t").isNotNull() & F.col("d").isNotNull())
    for i in range(p):
        rows = rows.where(F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}"))
    if entry:
        rows = rows.where("e is not null and e < t")
    m = rows.agg(F.count("*").alias("n"), F.count_distinct("t").alias("k"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(p)]).first()
    if m["k"] > max_times:
        raise ValueError(f"{m['k']} distinct times; round them to at most {max_times}")
    mean = np.array([m[f"m{i}"] or 0.0 for i in range(p)])
    scale = np.array([m[f"s{i}"] or 1.0 for i in range(p)])
    z = [(F.col(f"x{i}") - F.lit(float(mean[i]))) / F.lit(float(scale[i])) for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    base = settle(rows.select("t", "e", "d", *[c.alias(f"z{i}") for i, c in enumerate(z)]), "training")  # read once a step

    def sums(by: str, beta: np.ndarray) -> pd.DataFrame:
        eta = F.lit(0.0)
        for i, b in enumerate(beta):
            eta = eta + F.col(f"z{i}") * F.lit(float(b))
        w = F.exp(eta)
        aggregates = [F.sum(w).alias("s0"), *[F.sum(w * F.col(f"z{i}")).alias(f"a{i}") for i in range(p)], *[F.sum(w * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"b{i}_{j}") for i, j in pairs]]
        if by == "t":
            dw = F.col("d") * w
            aggregates += [F.sum("d").alias("d"), F.sum(F.col("d") * eta).alias("de"), *[F.sum(F.col("d") * F.col(f"z{i}")).alias(f"c{i}") for i in range(p)]]
            aggregates += [F.sum(dw).alias("es0"), *[F.sum(dw * F.col(f"z{i}")).alias(f"ea{i}") for i in range(p)], *[F.sum(dw * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"eb{i}_{j}") for i, j in pairs]]
        return base.groupBy(by).agg(*aggregates).toPandas().sort_values(by).reset_index(drop=True)

    names = ["s0", *[f"a{i}" for i in range(p)], *[f"b{i}_{j}" for i, j in pairs]]

    def state(beta: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """By distinct time: sums of its events, and of its risk set; and the distinct times of entry."""
        g = sums("t", beta)
        risk = g[names].to_numpy()[::-1].cumsum(0)[::-1]
        if not entry:
            return g, risk, np.empty(0)
        e = sums("e", beta)
        late = np.vstack([e[names].to_numpy()[::-1].cumsum(0)[::-1], np.zeros((1, len(names)))])
        return g, risk - late[np.searchsorted(e["e"].to_numpy(), g["t"].to_numpy(), side="left")], e["e"].to_numpy()

    beta, n, done, last, info = np.zeros(p), m["n"], 0, 0.0, np.eye(p)
    for done in range(1, steps + 1):
        g, risk, _ = state(beta)
        d = g["d"].to_numpy()
        own = g[["e" + c for c in names]].to_numpy() if ties == "efron" else np.zeros_like(risk)
        a0, a1, b0, b1, b2, logs = tie_sums(d, np.maximum(risk[:, 0], 1e-300), own[:, 0])
        s1, e1 = risk[:, 1 : 1 + p], own[:, 1 : 1 + p]
        gradient = g[[f"c{i}" for i in range(p)]].to_numpy().sum(0) - (a0[:, None] * s1 - a1[:, None] * e1).sum(0) - penalty * n * beta
        info = np.zeros((p, p))
        for k, (i, j) in enumerate(pairs):
            second = a0 * risk[:, 1 + p + k] - a1 * own[:, 1 + p + k]
            square = b0 * s1[:, i] * s1[:, j] - b1 * (s1[:, i] * e1[:, j] + e1[:, i] * s1[:, j]) + b2 * e1[:, i] * e1[:, j]
            info[i, j] = info[j, i] = (second - square).sum()
        info += penalty * n * np.eye(p)
        last = float(g["de"].sum() - logs.sum() - penalty * n / 2 * (beta**2).sum())
        move = np.linalg.solve(info + 1e-9 * np.eye(p), gradient)
        beta = beta + move
        if np.abs(move).max() < tolerance:
            break
    g, risk, entries = state(beta)
    times, d, s0 = g["t"].to_numpy(), g["d"].to_numpy(), np.maximum(risk[:, 0], 1e-300)
    hit = d > 0
    variance = np.linalg.inv(info + 1e-9 * np.eye(p))
    if robust:
        variance = variance @ _score_spread(base, p, beta, times, d, s0, risk[:, 1 : 1 + p], entries) @ variance
    return Cox(tuple(features), mean, scale, beta, times[hit], np.cumsum(d[hit] / s0[hit]), done, last, variance)


def tie_sums(d: np.ndarray, s0: np.ndarray, e0: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each time with d events, over l = 0 .. d - 1 with u = l / d and D = s0 - u * e0: the sums of 1/D, u/D, 1/D^2, u/D^2,
    u^2/D^2 and log D. Without ``e0`` (all zero) these are Breslow's."""
    d = d.astype(np.int64)
    out = np.zeros((6, len(d)))
    ends = np.cumsum(d)
    at = 0
    while at < len(d):  # some million terms at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000, side="right")))
        k = np.repeat(np.arange(at, to), d[at:to])
        if len(k):
            u = (np.arange(len(k)) - (ends - d)[k] + (ends - d)[at]) / d[k]
            den = np.maximum(s0[k] - u * e0[k], 1e-300)
            for row, term in enumerate((1 / den, u / den, 1 / den**2, u / den**2, u**2 / den**2, np.log(den))):
                out[row, at:to] = np.bincount(k - at, term, to - at)
        at = to
    return tuple(out)


def _score_spread(base: DataFrame, p: int, beta: np.ndarray, times: np.ndarray, d: np.ndarray, s0: np.ndarray, s1: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the rows' score residuals. Rows meet the cumulative sums at their end, and at their entry
    those up to it, by an equi-join on the distinct times."""
    xbar = s1 / s0[:, None]
    h = np.cumsum(d / s0)
    gsum = np.cumsum((d / s0)[:, None] * xbar, 0)
    spark = base.sparkSession
    columns = lambda prefix, k: ", ".join(f"{prefix}{i} double" for i in range(k))
    ends = spark.createDataFrame([(float(t), float(a), *map(float, x), *map(float, y)) for t, a, x, y in zip(times, h, gsum, xbar)], f"t double, h double, {columns('g', p)}, {columns('m', p)}")
    rows = base.join(ends, "t")
    before = [F.lit(0.0)] * (p + 1)
    if len(entries):
        at = np.searchsorted(times, entries, side="right")
        h0, g0 = np.append(0.0, h), np.vstack([np.zeros((1, p)), gsum])
        starts = spark.createDataFrame([(float(e), float(h0[k]), *map(float, g0[k])) for e, k in zip(entries, at)], f"e double, h_in double, {columns('g_in', p)}")
        rows, before = rows.join(starts, "e"), [F.col("h_in"), *[F.col(f"g_in{i}") for i in range(p)]]
    eta = F.lit(0.0)
    for i, b in enumerate(beta):
        eta = eta + F.col(f"z{i}") * F.lit(float(b))
    part = lambda i: F.col("d") * (F.col(f"z{i}") - F.col(f"m{i}")) - F.exp(eta) * (F.col(f"z{i}") * (F.col("h") - before[0]) - (F.col(f"g{i}") - before[i + 1]))
    residuals = rows.select(*[part(i).alias(f"r{i}") for i in range(p)])
    got = residuals.agg(*[F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"x{i}_{j}") for i in range(p) for j in range(p)]).first()
    return np.array([[got[f"x{i}_{j}"] or 0.0 for j in range(p)] for i in range(p)])


def event_within(baseline_at: Column, baseline_later: Column, score: Column) -> Column:
    """Chance of the event by the later time, given none so far; within [0, 1]."""
    p = 1 - F.try_divide(F.pow(baseline_later, F.exp(score)), F.pow(baseline_at, F.exp(score)))
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def _dominated(group: np.ndarray, order: np.ndarray, score: np.ndarray, events: np.ndarray, rows: np.ndarray) -> tuple[int, int, int]:
    """(pairs, right, tied): over cells i, j of one group with order_i < order_j, events_i * rows_j, and of it where score_i is
    greater, or equal. Two orders first differ at one binary digit; for each digit one sort and one look-up count all pairs."""
    if not len(order):
        return 0, 0, 0
    level_of = np.unique(score, return_inverse=True)[1].astype(np.int64)
    levels = int(level_of.max()) + 1
    order = order.astype(np.int64)
    group = np.unique(group, return_inverse=True)[1].astype(np.int64)
    pairs = right = tied = 0
    for bit in range(int(order.max()).bit_length()):
        box = np.unique(group * (int(order.max() >> (bit + 1)) + 1) + (order >> (bit + 1)), return_inverse=True)[1].astype(np.int64)
        later = (order >> bit) & 1 == 1
        sooner = ~later & (events > 0)
        if not later.any() or not sooner.any():
            continue
        place = box[later] * levels + level_of[later]
        by = np.argsort(place, kind="stable")
        place, total = place[by], np.append(0, np.cumsum(rows[later][by]))
        upto = lambda x, side="left": total[np.searchsorted(place, x, side=side)]  # noqa: E731, B023
        start, own, d = box[sooner] * levels, box[sooner] * levels + level_of[sooner], events[sooner]
        pairs += int((d * (upto(start + levels) - upto(start))).sum())
        right += int((d * (upto(own) - upto(start))).sum())
        tied += int((d * (upto(own, "right") - upto(own))).sum())
    return pairs, right, tied


def concordance(df: DataFrame, duration: str, event: str, score: str, blocks: int = 64) -> DataFrame:
    """One row: pairs that can be compared, those in the right order, ties in score, and the index (null without pairs).

    A pair counts if the shorter duration ended in an event; of equal durations, an event comes before a row that was censored.
    A greater score should mean a shorter duration. Rows with a null among the three don't count. The counts are exact.

    Scale: durations and scores are each cut into ``blocks`` ranges. Pairs in two ranges of both are counted from the table of
    the ranges (``3 * blocks**2`` cells at most); pairs within a range of durations and those within a range of scores in one
    task for each range, from folded cells. A duration or a score that very many rows share has a range of its own, in which
    there is nothing to compare, or folds to few cells.
    """
    rows = df.where(F.col(duration).isNotNull() & F.col(event).isNotNull() & F.col(score).isNotNull()).select(F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(score).cast("double").alias("s"))
    cells = rows.groupBy("t", "e", "s").agg(F.count("*").alias("n"))
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    cuts = settle(rows.agg(F.percentile_approx("t", shares, F.lit(10_000)).alias("ts"), F.percentile_approx("s", shares, F.lit(10_000)).alias("ss")), "cuts").first()
    literal = lambda xs: F.array(*[F.lit(float(x)) for x in sorted(set(xs or []))]) if xs else F.array().cast("array<double>")
    passed = lambda xs, c: F.filter(literal(xs), lambda b: b <= c)
    below = passed(cuts["ts"], F.col("t"))
    at_cut = F.coalesce(F.try_element_at(below, F.lit(-1)) == F.col("t"), F.lit(False))
    tb = F.size(below) * 3 + F.when(at_cut, F.lit(1) - F.col("e")).otherwise(2)  # at a cut: events, then censored rows; beyond it the rest
    cells = settle(cells.select("*", tb.alias("tb"), F.size(passed(cuts["ss"], F.col("s"))).alias("sb"), (F.col("e") * F.col("n")).alias("d")), "cells")

    count = "pairs bigint, right bigint, tied bigint"
    made = lambda p, r, t: pd.DataFrame({"pairs": [p], "right": [r], "tied": [t]})

    def within_durations(g: pd.DataFrame) -> pd.DataFrame:
        at = np.unique(g["t"].to_numpy(), return_inverse=True)[1] * 2 + (1 - g["e"].to_numpy())
        return made(*_dominated(np.zeros(len(g)), at, g["s"].to_numpy(), g["d"].to_numpy(), g["n"].to_numpy()))

    def within_scores(g: pd.DataFrame) -> pd.DataFrame:
        _, right, tied = _dominated(np.zeros(len(g)), g["tb"].to_numpy(), g["s"].to_numpy(), g["d"].to_numpy(), g["n"].to_numpy())
        return made(0, right, tied)

    same_time = cells.where(F.col("tb") % 3 == 2).groupBy("tb").applyInPandas(within_durations, count)
    same_score = cells.groupBy("sb", "tb", "s").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).groupBy("sb").applyInPandas(within_scores, count)
    table = cells.groupBy("tb", "sb").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).toPandas()
    spark = df.sparkSession
    far = [0, 0]
    if len(table):
        shape = (int(table["tb"].max()) + 1, int(table["sb"].max()) + 1)
        d, n = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        d[table["tb"], table["sb"]], n[table["tb"], table["sb"]] = table["d"], table["n"]
        later = n.sum(0) - np.cumsum(n, 0)  # of later ranges of durations, by range of scores
        lower = np.cumsum(later, 1) - later
        far = [int((d * later.sum(1, keepdims=True)).sum()), int((d * lower).sum())]
    parts = same_time.unionByName(same_score).unionByName(spark.createDataFrame([(far[0], far[1], 0)], count))
    total = parts.agg(*[F.sum(c).alias(c) for c in ("pairs", "right", "tied")])
    return total.withColumn("index", F.try_divide(F.col("right") + F.col("tied") / 2, F.col("pairs")))


def lifetimes(df: DataFrame, key: str, installed: str, removed: str, window_start: date, as_of: date) -> DataFrame:
    """Each row with ``drop_reason`` (null if it stays), ``event``, ``entry_age`` and ``exit_age`` in years.

    Reasons in order: no install date; removed before installed; removed before the window opened; no time under
    observation. A removal after ``as_of`` is none yet. Observation starts at the later of installation and
    ``window_start`` (late entry).
    """
    i, r, lo, now = F.to_date(installed), F.to_date(removed), F.lit(window_start), F.lit(as_of)
    gone = F.coalesce(r <= now, F.lit(False))
    end = F.when(gone, r).otherwise(now)
    start = F.greatest(i, lo)
    reason = F.when(i.isNull(), "no_install").when(r < i, "removed_before_install").when(gone & (r < lo), "removed_before_window").when(end <= start, "no_time_observed")
    age = lambda d: F.greatest(F.datediff(d, i) / F.lit(365.25), F.lit(0.0))
    keep = F.col("drop_reason").isNull()
    out = df.select(key, F.col(installed), F.col(removed), reason.alias("drop_reason"), gone.cast("int").alias("event"), age(start).alias("entry_age"), age(end).alias("exit_age"), (i < lo).alias("left_truncated"))
    return out.withColumns({c: F.when(keep, F.col(c)) for c in ("event", "entry_age", "exit_age", "left_truncated")})


def cut_at(life: DataFrame, installed: str, removed: str, cutoff: date) -> DataFrame:
    """Lifetimes as they were known at ``cutoff``: later removals become censored, later installations leave."""
    age = F.datediff(F.lit(cutoff), F.to_date(installed)) / F.lit(365.25)
    known = life.where("drop_reason is null").withColumns({"seen_until": F.least(F.col("exit_age"), age), "seen_gone": ((F.col("event") == 1) & (F.to_date(removed) <= F.lit(cutoff))).cast("int")})
    return known.where(F.col("seen_until") > F.col("entry_age"))


def at_risk(life: DataFrame, installed: str, removed: str, cutoffs: list[date], horizon_days: int) -> DataFrame:
    """(cutoff, key..., age, label): rows in place at each cutoff, and whether they went within the horizon after it."""
    c = F.explode(F.array(*[F.lit(x) for x in cutoffs])).alias("cutoff")
    rows = life.where("drop_reason is null").select("*", c)
    r = F.to_date(removed)
    there = (F.to_date(installed) <= F.col("cutoff")) & (r.isNull() | (r > F.col("cutoff")))
    return rows.where(there).withColumn("age", F.datediff("cutoff", F.to_date(installed)) / F.lit(365.25)).withColumn("label", F.coalesce((r <= F.date_add("cutoff", horizon_days)), F.lit(False)).cast("int"))


def age_auc(windows: DataFrame, least: int = 50) -> DataFrame:
    """(cutoff, n, events, auc, inverted) of each window of ``at_risk``: how well age ranks what goes within the horizon.

    Windows of fewer than ``least`` rows or without an event are left out; ``auc`` is null where all went. Rows fold to
    distinct ages first, of which whole days leave few, so the running sums of a window run over those.
    """
    ages = windows.groupBy("cutoff", "age").agg(F.count("*").alias("n"), F.sum("label").alias("d"))
    younger = Window.partitionBy("cutoff").orderBy("age").rowsBetween(Window.unboundedPreceding, -1)
    under = F.coalesce(F.sum(F.col("n") - F.col("d")).over(younger), F.lit(0))
    right = F.col("d") * (under + (F.col("n") - F.col("d")) / 2)
    g = ages.withColumn("right", right).groupBy("cutoff").agg(F.sum("n").alias("n"), F.sum("d").alias("events"), F.sum("right").alias("right")).where((F.col("n") >= least) & (F.col("events") > 0))
    auc = F.try_divide(F.col("right"), F.col("events") * (F.col("n") - F.col("events")))
    return g.select("cutoff", "n", "events", auc.alias("auc"), F.coalesce(auc < 0.5, F.lit(False)).alias("inverted"))


def age_direction(aucs: DataFrame) -> DataFrame:
    """One row: windows that count, how many are inverted, and ``youngest_first`` if more than half are, else ``oldest_first``."""
    g = aucs.agg(F.count("*").alias("windows"), F.count_if("inverted").alias("inverted"))
    return g.withColumn("direction", F.when(F.col("inverted") * 2 > F.col("windows"), "youngest_first").otherwise("oldest_first"))


def prefer_model(model: dict[str, float], baseline: dict[str, float]) -> str:
    """``model`` only if it ranks better and errs less than the baseline, both on held-out rows; else ``baseline``."""
    return "model" if model["auc"] > baseline["auc"] and model["brier"] < baseline["brier"] else "baseline"


def preferred(scored: DataFrame, label: str, model: str, baseline: str, tie: str, most_error: float = 0.05) -> DataFrame:
    """One row on held-out rows: AUC and Brier score of both scores, the model's mean error, and two rules on which is used.

    ``by_brier``: the model if it ranks better and its Brier score is lower. ``by_error``: the model if it ranks better and
    predicts within ``most_error`` of the observed rate on average. Rows with a null don't count; without rows, the baseline.
    """
    rows = scored.where(F.col(label).isNotNull() & F.col(model).isNotNull() & F.col(baseline).isNotNull()).select(tie, label, model, baseline)
    cell = lambda df, c: df.select(c).scalar()
    b1, b2 = brier(rows, label, model), brier(rows, label, baseline)
    one = scored.sparkSession.range(1).select(cell(auc(rows, label, model), "auc").alias("auc_model"), cell(auc(rows, label, baseline), "auc").alias("auc_baseline"), cell(b1, "brier").alias("brier_model"), cell(b2, "brier").alias("brier_baseline"), F.abs(cell(b1, "predicted") - cell(b1, "observed")).alias("mean_error"))
    ranks = F.col("auc_model") > F.col("auc_baseline")
    said = lambda c: F.when(ranks & c, "model").otherwise("baseline")
    return one.withColumns({"by_brier": said(F.col("brier_model") < F.col("brier_baseline")), "by_error": said(F.col("mean_error") <= most_error)})
