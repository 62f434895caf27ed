"""Batch folds that also run over streams (an extension: the batch operators are `curves.hazard` and `episodes.episodes`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.columns import exact


def hazard_so_far(stream: DataFrame, bucket: Column, exposure: Column, failure: Column) -> DataFrame:
    """(bucket, exposure, failures): running sums of a stream, for output mode ``complete``; state is one row a bucket."""
    return stream.groupBy(bucket.alias("bucket")).agg(F.sum(exposure).alias("exposure"), F.sum(failure).alias("failures")).where("bucket is not null")


def daily_episodes(stream: DataFrame, account: str, when: str, amount: str, delay: str = "30 days") -> DataFrame:
    """(account, day, rows, total) of each day that the watermark has passed, for output mode ``append``.

    Rows more than ``delay`` behind the latest event time are dropped by Spark; null accounts and times don't count."""
    rows = stream.where(F.col(account).isNotNull() & F.col(when).isNotNull()).select(F.col(account).alias("account"), F.col(when).cast("timestamp").alias("at"), exact(F.col(amount)).alias("x"))
    days = rows.withWatermark("at", delay).groupBy(F.window("at", "1 day").alias("w"), "account").agg(F.count("*").alias("rows"), F.coalesce(F.sum("x").cast("double"), F.lit(0.0)).alias("total"))
    return days.select("account", F.to_date("w.start").alias("day"), "rows", "total")
