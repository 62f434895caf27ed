"""Per-entity features of many event types, kept up to date by signed changes.

The table has one row per (entity, type) with a count, an exact total and the day of the latest event. A change is a row
with sign +1 (insert) or -1 (retract). Counts and totals are added up; a maximum can only be raised by inserts, so it is
worked out anew only for those (entity, type) whose latest day a retraction touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.columns import day_number, exact, tidy_key

KEYS = ["entity", "type"]


def changes(df: DataFrame, entity: str, event_type: str, event_time: str, amount: str, sign: int = 1) -> DataFrame:
    """Rows as signed changes (entity, type, day, x, sign).

    Types are compared without outer blanks and letter case; a null or blank type stays null: such a row counts for the
    entity but for no type. Rows with null entity are left out. A null, NaN or infinite amount adds nothing; a null time
    is no latest event.
    """
    return df.select(F.col(f"`{entity}`").alias("entity"), tidy_key(F.col(f"`{event_type}`")).alias("type"), day_number(F.col(f"`{event_time}`")).alias("day"), exact(F.col(f"`{amount}`")).alias("x"), F.lit(sign).alias("sign")).where("entity is not null")


def _folded(deltas: DataFrame) -> DataFrame:
    """One row per (entity, type): signed count and total, latest inserted and latest retracted day. Combined on the map side."""
    return deltas.groupBy(*KEYS).agg(
        F.sum("sign").alias("n"),
        F.coalesce(F.sum(F.col("x") * F.col("sign")), F.lit(0).cast("decimal(38,6)")).cast("decimal(38,6)").alias("total"),
        F.max(F.when(F.col("sign") > 0, F.col("day"))).alias("put_day"),
        F.max(F.when(F.col("sign") < 0, F.col("day"))).alias("cut_day"),
    )


def built(deltas: DataFrame) -> DataFrame:
    """The feature table (entity, type, n, total, last_day) of inserts alone."""
    return _folded(deltas).select(*KEYS, "n", "total", F.col("put_day").alias("last_day"))


def maintained(table: DataFrame, deltas: DataFrame, live: DataFrame) -> DataFrame:
    """The feature table after ``deltas``; ``live`` has the inserts that hold after them (as made by ``changes``).

    Rows whose count falls to 0 leave the table. ``live`` is only read for the (entity, type) whose latest day a
    retraction reaches: all else follows from the old row and the change. Retracting what was never inserted is an error
    of the caller and shows as a negative count.
    """
    change = _folded(deltas).select(*KEYS, F.col("n").alias("dn"), F.col("total").alias("dt"), "put_day", "cut_day")
    same = (F.col("t.entity") == F.col("c.entity")) & F.col("t.type").eqNullSafe(F.col("c.type"))
    both = table.alias("t").join(change.alias("c"), same, "full").select(
        F.coalesce("t.entity", "c.entity").alias("entity"),
        F.coalesce("t.type", "c.type").alias("type"),
        (F.coalesce("t.n", F.lit(0)) + F.coalesce("c.dn", F.lit(0))).alias("n"),
        (F.coalesce(F.col("t.total"), F.lit(0)) + F.coalesce(F.col("c.dt"), F.lit(0))).cast("decimal(38,6)").alias("total"),
        F.greatest("t.last_day", "c.put_day").alias("last_day"),
        F.col("c.cut_day").alias("cut_day"),
    ).where("n <> 0")
    stale = F.coalesce(F.col("cut_day") >= F.col("last_day"), F.lit(False))
    kept = both.where(~stale).select(*KEYS, "n", "total", "last_day")
    open_ = both.where(stale).select(*KEYS, "n", "total")
    again = (live["entity"] == open_["entity"]) & live["type"].eqNullSafe(open_["type"])
    latest = live.join(open_, again, "left_semi").groupBy(*KEYS).agg(F.max("day").alias("last_day"))
    redone = open_.alias("o").join(latest.alias("l"), (F.col("o.entity") == F.col("l.entity")) & F.col("o.type").eqNullSafe(F.col("l.type")), "left").select("o.entity", "o.type", "o.n", "o.total", "l.last_day")
    return kept.unionByName(redone)


def per_entity(table: DataFrame, as_of_day: Column) -> DataFrame:
    """One row per entity: number of events, and aligned arrays over its types in order of the type.

    (entity, events, types, counts, days_since, totals). ``days_since`` is null where no event of the type has a time, and
    negative for an event after ``as_of_day``. An entity with untyped events only has empty arrays. An array has at most
    as many members as there are types, so an entity's row is bounded however many events it has.
    """
    item = F.when(F.col("type").isNotNull(), F.struct("type", "n", (as_of_day - F.col("last_day")).alias("d"), F.col("total").cast("double").alias("x")))
    rows = table.groupBy("entity").agg(F.sum("n").alias("events"), F.array_sort(F.collect_list(item)).alias("f"))
    return rows.select("entity", "events", F.col("f.type").alias("types"), F.col("f.n").alias("counts"), F.col("f.d").alias("days_since"), F.col("f.x").alias("totals"))
