"""Account-level models: rollups, dormancy, shares, cohorts, peers, concentration."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.columns import exact, exact_sum
from lodeworks.functions.values import mode, ratio


def months_idle(last: Column, as_of: date, month_days: float = 30.4375) -> Column:
    """Months from ``last`` to ``as_of``, half-even to one decimal."""
    return F.bround(F.datediff(F.lit(as_of), F.to_date(last)) / F.lit(month_days), 1)


def rollup(df: DataFrame, account: str, when: str, amount: str, modes: list[str], distinct: dict[str, str], masks: dict[str, Column], as_of: date) -> DataFrame:
    """One row per non-null account: modes, dates, totals, distinct counts, totals under masks, recency.

    Totals are exact and 0.0 where nothing is summed. A mode is the smallest among equals and null where all are null.

    Scale: no row is expanded. Each distinct count folds to (account, value) first, and the modes and totals are one aggregate;
    the sides, one row an account each, then meet by account.
    """
    rows = df.where(F.col(account).isNotNull())
    out = rows.groupBy(account).agg(
        *[mode(F.col(m)).alias(m) for m in modes],
        F.min(F.to_date(when)).alias("first_day"),
        F.max(F.to_date(when)).alias("last_day"),
        F.count("*").alias("awards"),
        exact_sum(F.col(amount)).alias("total"),
        *[exact_sum(F.when(m, F.col(amount))).alias(n) for n, m in masks.items()],
    )
    for n, c in distinct.items():
        out = out.join(rows.select(account, c).distinct().groupBy(account).agg(F.count(c).alias(n)), account)
    idle = months_idle(F.col("last_day"), as_of)
    return out.withColumn("months_idle", idle).withColumn("dormant", idle >= 24).withColumn("tenure_years", F.bround(F.datediff("last_day", "first_day") / F.lit(365.25), 2)).withColumn("mean_amount", ratio(F.col("total"), F.col("awards")))


def scopes(df: DataFrame, account: str, when: str, masks: dict[str, Column], as_of: date, thresholds: tuple[int, ...] = (12, 18, 24, 36)) -> DataFrame:
    """(scope, accounts, median_idle, share_N...) of each mask: how dormant accounts look if only its rows count.

    A row is unfolded to the scopes it is in; then one aggregate by (scope, account) and one by scope."""
    tagged = F.explode(F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]))).alias("scope")
    last = df.where(F.col(account).isNotNull() & F.col(when).isNotNull()).select(tagged, F.col(account).alias("a"), F.to_date(when).alias("d")).groupBy("scope", "a").agg(F.max("d").alias("d"))
    idle = last.withColumn("idle", months_idle(F.col("d"), as_of))
    return idle.groupBy("scope").agg(F.count("*").alias("accounts"), F.median("idle").alias("median_idle"), *[F.avg((F.col("idle") >= t).cast("int")).alias(f"share_{t}") for t in thresholds])


def share_shift(df: DataFrame, account: str, when: str, amount: str, part: Column, counted: Column, as_of: date, window_days: int, least: float) -> DataFrame:
    """(account, recent_share, prior_share, delta, shifted, direction): the share of ``part`` in ``counted`` amounts in the last
    ``window_days`` and before. Shifted if the shares lie on two sides of a half and differ by ``least`` or more; null shares don't shift."""
    age = F.datediff(F.lit(as_of), F.to_date(when))
    recent = counted & (age <= window_days) & (age >= 0)
    prior = counted & (age > window_days)
    total = lambda m: F.coalesce(F.sum(F.when(m, exact(F.col(amount)))).cast("double"), F.lit(0.0))
    g = df.where(F.col(account).isNotNull()).groupBy(account).agg(total(recent & part).alias("rp"), total(recent).alias("r"), total(prior & part).alias("pp"), total(prior).alias("p"))
    g = g.select(account, ratio(F.col("rp"), F.col("r")).alias("recent_share"), ratio(F.col("pp"), F.col("p")).alias("prior_share")).where("recent_share is not null and prior_share is not null")
    delta = F.col("recent_share") - F.col("prior_share")
    crossed = (F.col("recent_share") >= 0.5) != (F.col("prior_share") >= 0.5)
    return g.withColumn("delta", delta).withColumn("shifted", crossed & (F.abs(delta) >= least)).withColumn("direction", F.when(F.col("shifted"), F.when(delta > 0, "towards").otherwise("away")).otherwise("none"))


def cohorts(df: DataFrame, account: str, when: str, amount: str, as_of: date, years: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(cohort_fy, accounts, total, year_n, eligible, active, rate): accounts by fiscal year of their first day.

    ``active`` are accounts with an event in the n-th year after their first day, among those ``eligible`` whose n-th year is
    over by ``as_of``; cells without eligible accounts are left out."""
    from lodeworks.functions.values import fiscal_year

    days = df.where(F.col(account).isNotNull() & F.col(when).isNotNull()).groupBy(F.col(account).alias("a"), F.to_date(when).alias("d")).agg(F.sum(exact(F.col(amount))).alias("x"))
    first = days.groupBy("a").agg(F.min("d").alias("f"), F.sum("x").alias("x")).withColumn("cohort_fy", fiscal_year(F.col("f")))
    sizes = first.groupBy("cohort_fy").agg(F.count("*").alias("accounts"), F.coalesce(F.sum("x").cast("double"), F.lit(0.0)).alias("total"))
    year = F.explode(F.array(*[F.lit(y) for y in years])).alias("year_n")
    edge = lambda n: F.date_add("f", (n * F.lit(365)).cast("int"))
    cells = first.select("a", "cohort_fy", "f", year).where(edge(F.col("year_n")) <= F.lit(as_of))
    hit = days.select("a", "d").join(first.select("a", "f"), "a").select("a", F.ceil(F.datediff("d", "f") / 365.0).cast("int").alias("year_n")).where(F.col("year_n").isin(*years)).distinct()
    table = cells.join(hit.withColumn("hit", F.lit(1)), ["a", "year_n"], "left").groupBy("cohort_fy", "year_n").agg(F.count("*").alias("eligible"), F.count("hit").alias("active"))
    return sizes.join(table, "cohort_fy").select("cohort_fy", "accounts", "total", "year_n", "eligible", "active", (F.col("active") / F.col("eligible")).alias("rate"))


def retention(df: DataFrame, account: str, when: str, as_of: date, dormant_months: float = 24) -> DataFrame:
    """(cohort_fy, accounts, dormant, fy, active, rate): of each cohort how many accounts are dormant, and in each fiscal year from
    its own on that anyone of it was active in, how many were."""
    from lodeworks.functions.values import fiscal_year

    days = df.where(F.col(account).isNotNull() & F.col(when).isNotNull()).groupBy(F.col(account).alias("a"), fiscal_year(F.col(when)).alias("fy")).agg(F.min(F.to_date(when)).alias("f"), F.max(F.to_date(when)).alias("l"))
    first = days.groupBy("a").agg(fiscal_year(F.min("f")).alias("cohort_fy"), months_idle(F.max("l"), as_of).alias("idle"))
    sizes = first.groupBy("cohort_fy").agg(F.count("*").alias("accounts"), F.sum((F.col("idle") >= dormant_months).cast("bigint")).alias("dormant"))
    active = days.join(first, "a").groupBy("cohort_fy", "fy").agg(F.count("*").alias("active"))
    return sizes.join(active, "cohort_fy").select("cohort_fy", "accounts", "dormant", "fy", "active", (F.col("active") / F.col("accounts")).alias("rate"))


def with_sides(accounts: DataFrame, account: str, covered: DataFrame, renewals: DataFrame, gaps: DataFrame) -> DataFrame:
    """``accounts`` with what other tables say of each: covered assets (account, covered), expiring contracts (account, key, amount,
    end, cluster_size) and gaps against peers (account). Each is folded by account first; where it says nothing there are zeros."""
    cov = covered.groupBy(account).agg(F.count("*").alias("assets"), F.sum(F.col("covered").cast("bigint")).alias("covered_assets"))
    ren = renewals.groupBy(account).agg(F.countDistinct("key").alias("expiring"), exact_sum(F.col("amount")).alias("expiring_value"), F.min(F.to_date("end")).alias("next_expiry"), F.max(F.col("cluster_size") > 1).alias("in_cluster"))
    gap = gaps.groupBy(account).agg(F.count("*").alias("gaps"))
    out = accounts
    for side in (cov, ren, gap):
        out = out.join(side, account, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*accounts.columns, zero("assets"), zero("covered_assets"), (F.coalesce("assets", F.lit(0)) - F.coalesce("covered_assets", F.lit(0))).alias("uncovered_assets"), ratio(F.col("covered_assets"), F.col("assets")).alias("coverage_rate"), zero("expiring"), F.coalesce("expiring_value", F.lit(0.0)).alias("expiring_value"), "next_expiry", F.coalesce("in_cluster", F.lit(False)).alias("in_cluster"), zero("gaps"))


def pace_against_cohort(df: DataFrame, account: str, when: str, as_of: date) -> DataFrame:
    """(account, cohort_fy, per_year, cohort_median, pace): events a year, and that divided by the median of the cohort."""
    from lodeworks.functions.values import fiscal_year

    g = df.where(F.col(account).isNotNull() & F.col(when).isNotNull()).groupBy(account).agg(F.count("*").alias("n"), F.min(F.to_date(when)).alias("f"))
    years = F.greatest(F.datediff(F.lit(as_of), "f") / F.lit(365.25), F.lit(0.5))
    g = g.select(account, fiscal_year(F.col("f")).alias("cohort_fy"), (F.col("n") / years).alias("per_year"))
    medians = g.groupBy("cohort_fy").agg(F.median("per_year").alias("cohort_median"))
    return g.join(medians, "cohort_fy").select(account, "cohort_fy", "per_year", "cohort_median", ratio(F.col("per_year"), F.col("cohort_median")).alias("pace"))


def peer_gaps(bought: DataFrame, groups: DataFrame, account: str, item: str, group: str, floor: float) -> DataFrame:
    """(account, group, item, adopters, adoption): items that a share of ``floor`` or more of an account's group has, and it has not.

    ``bought`` may repeat (account, item); ``groups`` has one row per account. Candidates are items over the floor, of which a
    group of n members has at most n / floor times the items a member has: an equi-join, then an anti join."""
    pairs = bought.where(F.col(account).isNotNull() & F.col(item).isNotNull()).select(account, item).distinct()
    members = groups.where(F.col(group).isNotNull()).select(account, group)
    sizes = members.groupBy(group).agg(F.count("*").alias("members"))
    common = pairs.join(members, account).groupBy(group, item).agg(F.count("*").alias("adopters")).join(sizes, group).withColumn("adoption", F.col("adopters") / F.col("members")).where(F.col("adoption") >= floor)
    return members.join(common.select(group, item, "adopters", "adoption"), group).join(pairs, [account, item], "left_anti").select(account, group, item, "adopters", "adoption")


def concentration(df: DataFrame, account: str, part: str, amount: str) -> DataFrame:
    """(account, top_part, top_total, total, share, rows): the part with the greatest total, the smallest name among equals."""
    g = df.where(F.col(account).isNotNull() & F.col(part).isNotNull()).groupBy(account, part).agg(F.coalesce(F.sum(exact(F.col(amount))), F.lit(0).cast("decimal(38,6)")).alias("x"), F.count("*").alias("n"))
    w = F.struct((-F.col("x")).alias("x"), F.col(part).alias("p"))
    top = g.groupBy(account).agg(F.min(w).alias("m"), F.sum("x").alias("t"), F.sum("n").alias("rows"))
    return top.select(account, F.col("m.p").alias("top_part"), (-F.col("m.x")).cast("double").alias("top_total"), F.col("t").cast("double").alias("total"), ratio((-F.col("m.x")).cast("double"), F.col("t").cast("double")).alias("share"), "rows")


def acceleration(df: DataFrame, account: str, when: str, as_of: date, window_days: int = 730) -> DataFrame:
    """(account, recent_pace, prior_pace): events a year in the last ``window_days`` and before them (half a year at least)."""
    d = F.datediff(F.lit(as_of), F.to_date(when))
    g = df.where(F.col(account).isNotNull() & F.col(when).isNotNull()).groupBy(account).agg(F.sum(((d >= 0) & (d <= window_days)).cast("int")).alias("r"), F.sum((d > window_days).cast("int")).alias("p"), F.max(d).alias("span"))
    return g.select(account, (F.col("r") / F.lit(window_days / 365.0)).alias("recent_pace"), (F.col("p") / F.greatest((F.col("span") - window_days) / F.lit(365.0), F.lit(0.5))).alias("prior_pace"))


def last_n(df: DataFrame, account: str, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each non-null account in the order (descending, ties broken); Spark limits groups before it shuffles."""
    w = Window.partitionBy(account).orderBy(*order)
    return df.where(F.col(account).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def instability(df: DataFrame, entity: str, label: str, amount: str, ignore: str = "unknown") -> DataFrame:
    """(entities, unstable, share, amount_share): entities that bear more than one label, by number and by amount."""
    g = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.countDistinct(F.when(F.col(label) != ignore, F.col(label))).alias("k"), F.sum(exact(F.col(amount))).alias("x"))
    u = (F.col("k") > 1).cast("int")
    return g.agg(F.count("*").alias("entities"), F.sum(u).alias("unstable"), F.avg(u).alias("share"), ratio(F.sum(F.when(u == 1, F.col("x"))).cast("double"), F.sum("x").cast("double")).alias("amount_share"))


def peer_groups(accounts: DataFrame, account: str, segment: str, size: str) -> DataFrame:
    """``accounts`` with ``size_band`` XS to XL in fifths of their order by size, and ``peer_group``."""
    from lodeworks.operators.ordered import equal_count_bins

    out = equal_count_bins(accounts, [size, account], 5, "band")
    band = F.element_at(F.array(*[F.lit(b) for b in ("XS", "S", "M", "L", "XL")]), F.col("band"))
    return out.withColumn("size_band", band).withColumn("peer_group", F.concat_ws(" / ", segment, "size_band")).drop("band")
