"""Irregular series of account days: episodes, running features, gaps, state at a date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.columns import exact


def episodes(df: DataFrame, account: str, when: str, amount: str, flags: dict[str, Column], firsts: list[str], row_id: str) -> DataFrame:
    """One row per (account, day): rows, exact total, whether any row has each flag, and of each column in ``firsts`` its value
    in the row with the smallest ``row_id`` that has one. Null accounts and days are left out."""
    base = df.where(F.col(account).isNotNull() & F.col(when).isNotNull())
    return base.groupBy(F.col(account).alias("account"), F.to_date(when).alias("day")).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(exact(F.col(amount))), F.lit(0).cast("decimal(38,6)")).cast("decimal(28,6)").alias("total"),
        *[F.max(F.coalesce(m, F.lit(False)).cast("int")).alias(n) for n, m in flags.items()],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(row_id))).alias(c) for c in firsts],
    )


def running_features(eps: DataFrame, flags: list[str], firsts: list[str], cutoff: date) -> DataFrame:
    """Episodes with what was known on their day: ordinal, running totals and shares, tenure, gap before, mean gap so far,
    distinct values so far. The mean gap of a first episode is the median of the mean gaps up to ``cutoff``.

    An account has one row a day, so its window is bounded by the calendar. A distinct count so far is the running sum of
    first occurrences.
    """
    along = Window.partitionBy("account").orderBy("day")
    until = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = eps.withColumns({
        "ordinal": F.row_number().over(along),
        "running_total": F.sum("total").over(until).cast("double"),
        "first_day": F.min("day").over(Window.partitionBy("account")),
        "gap_before": F.datediff("day", F.lag("day").over(along)),
        **{f"{f}_sum": F.sum(f).over(until) for f in flags},
        **{f"{c}_new": F.when(F.col(c).isNotNull() & (F.row_number().over(Window.partitionBy("account", c).orderBy("day")) == 1), 1).otherwise(0) for c in firsts},
    })
    out = out.withColumns({f"{c}_so_far": F.sum(f"{c}_new").over(until) for c in firsts})
    out = out.withColumn("tenure_years", F.datediff("day", "first_day") / F.lit(365.25)).withColumn("mean_gap", F.try_divide(F.datediff("day", "first_day"), F.col("ordinal") - 1))
    typical = out.where(F.col("day") <= F.lit(cutoff)).agg(F.median("mean_gap").alias("m"))
    out = out.withColumn("mean_gap", F.coalesce("mean_gap", typical.scalar()))
    shares = {f"{f}_share": F.col(f"{f}_sum") / F.col("ordinal") for f in flags}
    return out.withColumns(shares).withColumn("log_total", F.log10(F.greatest("running_total", F.lit(1.0)))).drop(*[f"{c}_new" for c in firsts], *[f"{f}_sum" for f in flags])


def gaps(eps: DataFrame, boundary: date) -> DataFrame:
    """(account, day, duration, event): days to the account's next episode, or to ``boundary`` if there is none by then
    (event 0). Only episodes up to the boundary count; a duration is half a day at least."""
    w = Window.partitionBy("account").orderBy("day")
    known = eps.where(F.col("day") <= F.lit(boundary)).withColumn("next", F.lead("day").over(w))
    days = F.datediff(F.coalesce("next", F.lit(boundary)), "day")
    return known.withColumn("duration", F.greatest(days.cast("double"), F.lit(0.5))).withColumn("event", F.col("next").isNotNull().cast("int")).drop("next")


def state_at(eps: DataFrame, as_of: date, columns: list[str]) -> DataFrame:
    """(account, day, columns, elapsed): each account's last episode up to ``as_of`` and the days since: one aggregate."""
    last = eps.where(F.col("day") <= F.lit(as_of)).groupBy("account").agg(F.max_by(F.struct("day", *columns), "day").alias("s"))
    return last.select("account", "s.*").withColumn("elapsed", F.datediff(F.lit(as_of), "day"))


def rate_at(df: DataFrame, at: str, gap_rows: DataFrame, edges: list[float], name: str = "rate") -> DataFrame:
    """``df`` with the rate of the bucket that ``at`` falls into; the mean of all gaps where that bucket has none or there is none."""
    from lodeworks.functions.values import bucket

    rates = rate_by_bucket(gap_rows, edges).select(F.col("bucket").alias("_b"), F.col("rate").alias("_r"))
    mean = gap_rows.agg(F.avg("event").alias("m")).scalar()
    found = df.withColumn("_b", bucket(F.col(at), edges)).join(rates, "_b", "left")
    return found.select(*df.columns, F.coalesce("_r", mean).alias(name))


def rate_by_bucket(gap_rows: DataFrame, edges: list[float]) -> DataFrame:
    """(bucket, n, rate): share of gaps that ended in an event, by duration bucket [edge, next edge)."""
    from lodeworks.functions.values import bucket

    return gap_rows.withColumn("bucket", bucket(F.col("duration"), edges)).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.avg("event").alias("rate"))
