"""Attributes as they were known when an event happened.

Events and attribute versions are put on one line per entity, sorted by the time a version became usable, versions before
events at the same time, and the best version so far is carried forward. A line is cut into chunks of time so that no
entity's whole history stands in one task; what a chunk inherits comes from a running maximum over chunk summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

from lodeworks.functions.columns import day_number

CARRIED, VERSION, EVENT = 0, 1, 2  # order at equal times
DAY = 86_400


def finest(*kinds: DataType) -> DataType:
    """The type in which times of these types are compared: a day is its midnight, and a time without zone is one of the
    session's zone as soon as another has a zone."""
    for kind in (TimestampType(), TimestampNTZType()):
        if kind in kinds:
            return kind
    return kinds[0]


def _second_of_day(c: Column, kind: DataType) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c)) if isinstance(kind, (TimestampType, TimestampNTZType)) else F.lit(0)


def _chunk(c: Column, kind: DataType, seconds: Column) -> Column:
    """The chunk of a time, of so many seconds; it never falls as time goes on, whatever the session's zone does to clocks."""
    at = F.unix_seconds(c) if isinstance(kind, TimestampType) else day_number(c) * F.lit(DAY) + _second_of_day(c, kind)
    return F.floor(at / seconds)


def _day_at_or_after(c: Column, kind: DataType) -> Column:
    """The first midnight at or after a time."""
    return F.when(c == F.to_date(c).cast(kind), c).otherwise(F.date_add(F.to_date(c), 1).cast(kind))


def known_at(events: DataFrame, versions: DataFrame, entity: str, event_time: str, effective: str, recorded: str, tie: str, attributes: list[str], prefix: str = "", chunk_days: float | None = None) -> DataFrame:
    """``events`` with ``attributes`` of the version of the same entity that was in effect and already recorded.

    Usable versions have ``effective <= event_time`` and ``recorded <= event_time``; of those the greatest
    (effective, recorded, tie) counts, null ``tie`` being smallest. ``tie`` is always returned too.

    Times may be dates or timestamps with or without zone, on either side, and are compared in the finest of the types, so a
    day is its midnight and a version of later that day is not known yet.

    Every event stays, once for each of its rows. An event with null entity or time, and one without a usable version,
    gets nulls. Versions with null entity, effective or recorded never count; repeated versions change nothing. Empty
    tables are fine. An attribute whose name (after ``prefix``) an event column has already is returned with leading
    underscores. Attributes need an orderable type.

    Scale: the state is worked out once for each distinct (entity, event time), which collapses hot entities before the
    first shuffle; the ordered pass is by (entity, chunk of time). Where every event time is a midnight a chunk is 64 days,
    and versions fold to the first midnight at which they are known, so a task's share of an entity is bounded by the calendar.
    Where times are finer a chunk is an hour (``chunk_days`` sets another length), so it is bounded by what one entity does in an
    hour, and the running maximum over chunk summaries by the hours that it lived. Which of the two holds is a subquery over
    the event times alone. The join back is on (entity, time), where AQE can split a hot pair.
    """
    attributes = [tie] + [a for a in attributes if a != tie]
    kind = finest(*[df.schema[c].dataType for df, c in ((events, event_time), (versions, effective), (versions, recorded))])
    names, taken = [], {c.lower() for c in events.columns}
    for a in attributes:
        name = prefix + a
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)

    whole = events.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("e"), F.col(f"`{entity}`").alias("k"), F.col(f"`{event_time}`").cast(kind).alias("t"))
    usable = F.col("k").isNotNull() & F.col("t").isNotNull()
    times = whole.where(usable).select("k", "t").distinct()

    at = events.select(F.col(f"`{event_time}`").cast(kind).alias("t"))
    fine = at.agg(F.coalesce(F.max(F.col("t") != F.to_date("t").cast(kind)), F.lit(False)).alias("fine")).scalar()
    seconds = F.lit(float(chunk_days * DAY)) if chunk_days else F.when(fine, F.lit(3600.0)).otherwise(F.lit(64.0 * DAY))
    chunk = lambda c: _chunk(c, kind, seconds)

    best = F.struct("f", "r", *[f"a{i}" for i in range(len(attributes))])
    v = versions.select(F.col(f"`{entity}`").alias("k"), F.col(f"`{effective}`").cast(kind).alias("f"), F.col(f"`{recorded}`").cast(kind).alias("r"), *[F.col(f"`{a}`").alias(f"a{i}") for i, a in enumerate(attributes)]).where("k is not null and f is not null and r is not null")
    known = F.greatest("f", "r")
    v = v.select("k", F.when(fine, known).otherwise(_day_at_or_after(known, kind)).alias("t"), best.alias("s"))
    v = v.groupBy("k", chunk(F.col("t")).alias("c"), "t").agg(F.max("s").alias("s"))

    none = F.lit(None).cast(v.schema["s"].dataType)
    lived = times.select("k", chunk(F.col("t")).alias("c")).distinct().withColumn("s", none)
    earlier = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    carried = v.select("k", "c", "s").unionByName(lived).groupBy("k", "c").agg(F.max("s").alias("s")).select("k", "c", F.max("s").over(earlier).alias("s")).where("s is not null")

    line = (
        carried.select("k", "c", F.lit(None).cast(kind).alias("t"), F.lit(CARRIED).alias("p"), "s")
        .unionByName(v.select("k", "c", "t", F.lit(VERSION).alias("p"), "s"))
        .unionByName(times.select("k", chunk(F.col("t")).alias("c"), "t", F.lit(EVENT).alias("p"), none.alias("s")))
    )
    so_far = Window.partitionBy("k", "c").orderBy(F.col("t").asc_nulls_first(), "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = line.select("k", "t", "p", F.max("s").over(so_far).alias("s")).where(F.col("p") == EVENT).where("s is not null").select("k", "t", "s")

    found = whole.where(usable).join(state, ["k", "t"], "left").select("e", "s")
    lost = whole.where(~usable).select("e", none.alias("s"))
    return found.unionByName(lost).select("e.*", *[F.col(f"s.a{i}").alias(n) for i, n in enumerate(names)])
