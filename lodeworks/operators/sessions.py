"""Sessions of activity separated by gaps of inactivity."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from lodeworks.functions.columns import day_number


def sessions(events: DataFrame, entity: str, event_time: str, gap_days: int = 45, chunk_days: int = 365) -> DataFrame:
    """(entity, first_day, last_day, days, events): a session ends where the entity's next day is more than ``gap_days`` later.

    Days are day numbers; ``days`` counts both ends. Rows with null entity or time don't count; rows on one day are all
    counted as events. An empty table gives no sessions. Other columns, whatever their names, play no part.

    Scale: rows are counted by (entity, day) on the map side. Local sessions are built for each (entity, chunk of time),
    so at most ``chunk_days`` rows stand together; then only the partial sessions, of which a chunk has few, are laid
    side by side and merged where the gap across them is small enough.
    """
    days = events.select(F.col(f"`{entity}`").alias("entity"), day_number(F.col(f"`{event_time}`")).alias("d"))
    s = _sessions(days, gap_days, chunk_days)
    return s.select("entity", F.col("a").alias("first_day"), F.col("b").alias("last_day"), (F.col("b") - F.col("a") + 1).alias("days"), F.col("n").alias("events"))


def sessions_within_days(events: DataFrame, entity: str, event_time: str, gap: timedelta, chunk: timedelta = timedelta(hours=6)) -> DataFrame:
    """(entity, first_at, last_at, seconds, events): as ``sessions``, but by the time itself, to the microsecond: a session ends where
    the entity's next event is more than ``gap`` later.

    Times come back in the type they have; a date counts as its midnight. Scale: events at one time are counted together; what
    stands together in a task is what one entity does in one ``chunk``, which can be as short as needed, then its partial sessions.
    """
    kind = events.schema[event_time].dataType
    at = F.col(f"`{event_time}`")
    micros = F.unix_micros(at.cast("timestamp")) if isinstance(kind, TimestampType) else day_number(at) * F.lit(86_400_000_000) + (F.timestamp_diff("MICROSECOND", F.to_date(at).cast("timestamp_ntz"), at.cast("timestamp_ntz")))
    tick = timedelta(microseconds=1)
    s = _sessions(events.select(F.col(f"`{entity}`").alias("entity"), micros.alias("d"), at.alias("t")), gap // tick, chunk // tick, ["t"])
    return s.select("entity", F.col("ta").alias("first_at"), F.col("tb").alias("last_at"), ((F.col("b") - F.col("a")) / 1e6).alias("seconds"), F.col("n").alias("events"))


def _sessions(events: DataFrame, gap: int, chunk: int, shown: list[str] = ()) -> DataFrame:
    """(entity, a, b, n, ta, tb) of (entity, d, t): sessions over whole numbers ``d``, with the first and last ``t`` if it is shown."""
    k, d = "entity", "d"
    ends = [F.min("t").alias("ta"), F.max("t").alias("tb")] if shown else []
    again = [F.min("ta").alias("ta"), F.max("tb").alias("tb")] if shown else []
    at = events.where("entity is not null and d is not null").groupBy(k, d, *shown).agg(F.count("*").alias("n")).withColumn("c", F.floor(F.col(d) / F.lit(chunk)))
    inside = Window.partitionBy(k, "c").orderBy(d)
    starts = (F.col(d) - F.lag(d).over(inside)) > gap
    local = at.withColumn("new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("s", F.sum("new").over(inside)).groupBy(k, "c", "s").agg(F.min(d).alias("a"), F.max(d).alias("b"), F.sum("n").alias("n"), *ends)
    along = Window.partitionBy(k).orderBy("a")
    parted = (F.col("a") - F.lag("b").over(along)) > gap
    return local.withColumn("new", F.coalesce(parted, F.lit(True)).cast("int")).withColumn("s", F.sum("new").over(along)).groupBy(k, "s").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), *again)
