"""Curves over time: hazards, cumulative hazards, lookups on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hazard(df: DataFrame, bucket: Column, exposure: Column, failure: Column, days: float = 365.25) -> DataFrame:
    """(bucket, exposure, failures, daily, yearly): failures by exposure, and the chance of one within ``days``. Partial sums
    form in each task, so daily snapshots fold as they are read."""
    g = df.groupBy(bucket.alias("bucket")).agg(F.sum(exposure).alias("exposure"), F.sum(failure).alias("failures")).where("bucket is not null")
    daily = F.try_divide(F.col("failures"), F.col("exposure"))
    return g.withColumn("daily", daily).withColumn("yearly", 1 - F.pow(1 - daily, F.lit(days)))


def rising_from(curve: DataFrame, least_exposure: float, factor: float = 2.0, fallback: float = 5.0) -> DataFrame:
    """One row: the lowest yearly hazard among buckets with enough exposure, and the first bucket at ``factor`` times it."""
    firm = curve.where((F.col("exposure") > least_exposure) & F.col("yearly").isNotNull())
    floor = firm.agg(F.min("yearly").alias("m"))
    return firm.agg(F.min("yearly").alias("floor"), F.coalesce(F.min(F.when(F.col("yearly") >= factor * floor.scalar(), F.col("bucket").cast("double"))), F.lit(fallback)).alias("threshold"))


def nelson_aalen(gap_rows: DataFrame, duration: str = "duration", event: str = "event") -> DataFrame:
    """(t, events, at_risk, cumulative): by distinct duration, of which whole days leave few; the windows run over those."""
    g = gap_rows.where(F.col(duration).isNotNull()).groupBy(F.col(duration).alias("t")).agg(F.sum(event).alias("events"), F.count("*").alias("n"))
    later = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sooner = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = g.withColumn("at_risk", F.sum("n").over(later))
    return risk.withColumn("cumulative", F.sum(F.col("events") / F.col("at_risk")).over(sooner)).select("t", "events", "at_risk", "cumulative")


def segments(curve: DataFrame, t: str, value: str, cell: float) -> DataFrame:
    """(t0, t1, v0, v1, cell) of neighbouring points, one row for each cell of time that the segment touches."""
    w = Window.orderBy("t0")
    pts = curve.where(F.col(t).isNotNull()).select(F.col(t).cast("double").alias("t0"), F.col(value).cast("double").alias("v0"))
    segs = pts.withColumns({"t1": F.lead("t0").over(w), "v1": F.lead("v0").over(w)}).where("t1 is not null")
    at = lambda c: F.floor(F.col(c) / cell)
    return segs.withColumn("_cell", F.explode(F.sequence(at("t0"), at("t1"))))


def step_lookup(df: DataFrame, at: str, curve: DataFrame, t: str, value: str, before: float, name: str, cell: float = 30.0) -> DataFrame:
    """``df`` with the curve's last value at or before ``at``, ``before`` ahead of its first point; null where ``at`` is.

    The curve has one row per distinct time. Rows and segments meet by an equi-join on cells of time of width ``cell``,
    which holds the range condition to the few segments of a cell."""
    return _on_curve(df, at, curve, t, value, name, before, cell, F.col("v0"))


def interpolated(df: DataFrame, at: str, curve: DataFrame, t: str, value: str, before: float, name: str, cell: float = 30.0) -> DataFrame:
    """``df`` with the curve's value at ``at``, linear between points and level after the last; otherwise as ``step_lookup``."""
    lerp = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("_x") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return _on_curve(df, at, curve, t, value, name, before, cell, lerp)


def _on_curve(df: DataFrame, at: str, curve: DataFrame, t: str, value: str, name: str, before: float, cell: float, read: Column) -> DataFrame:
    end = curve.where(F.col(t).isNotNull()).agg(F.max(F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"))).alias("m"))
    end_t, end_v = end.select("m.t").scalar(), end.select("m.v").scalar()
    x = df.withColumn("_x", F.col(at).cast("double")).withColumn("_cell", F.floor(F.col("_x") / cell))
    hit = x.alias("x").join(segments(curve, t, value, cell).alias("s"), (F.col("x._cell") == F.col("s._cell")) & (F.col("_x") >= F.col("t0")) & (F.col("_x") < F.col("t1")), "left")
    found = F.when(F.col("_x") >= end_t, end_v).otherwise(F.coalesce(read, F.lit(before)))
    return hit.withColumn(name, F.when(F.col("_x").isNotNull(), found)).select(*[F.col(f"x.{c}") for c in df.columns], name)
