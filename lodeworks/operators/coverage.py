"""Coverage by nearby events, and clusters of expiries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.columns import day_number, exact


def covered(df: DataFrame, keys: list[str], when: str, is_anchor: Column, is_asked: Column, days: int, name: str) -> DataFrame:
    """``coverages`` with one flag."""
    return coverages(df, {name: keys}, when, is_anchor, is_asked, days)


def coverages(df: DataFrame, by: dict[str, list[str]], when: str, is_anchor: Column, is_asked: Column, days: int) -> DataFrame:
    """The asked rows of ``df`` with a flag for each of ``by``: is there an anchor row of the same keys within ``days`` either
    way, ends included?

    Rows with a null key or time are not covered. Anchors and asked rows are folded to distinct (keys, day) before one
    window by range of days, so what meets in a task for a key is bounded by the calendar; the flags then go back by an
    equi-join that AQE can split. Every set of keys is one fold; asked rows are read once for all flags.
    """
    base = df.withColumn("_d", day_number(F.col(when))).withColumn("_asked", F.coalesce(is_asked, F.lit(False)))
    out = base.where("_asked")
    for name, keys in by.items():
        usable = F.col("_d").isNotNull()
        for k in keys:
            usable = usable & F.col(k).isNotNull()
        by_day = base.where(usable).groupBy(*keys, "_d").agg(F.max(F.coalesce(is_anchor, F.lit(False)).cast("int")).alias("_anchor"), F.max(F.col("_asked").cast("int")).alias("_any"))
        w = Window.partitionBy(*keys).orderBy("_d").rangeBetween(-days, days)
        flags = by_day.withColumn("_near", F.max("_anchor").over(w)).where("_any = 1").select(*keys, "_d", (F.col("_near") == 1).alias(name))
        out = out.join(flags, [*keys, "_d"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select(*df.columns, *by)


def anchored_clusters(df: DataFrame, account: str, when: str, span_days: int, name: str = "cluster") -> DataFrame:
    """``df`` with the number, from 1, of the row's cluster within its account: a cluster takes all days up to ``span_days``
    after its first; the next day opens the next one.

    The fold runs over the distinct days of an account, which the calendar bounds; rows with null account or time are left out.
    """
    base = df.where(F.col(account).isNotNull() & F.col(when).isNotNull()).withColumn("_d", day_number(F.col(when)))
    days = base.groupBy(account).agg(F.array_sort(F.collect_set("_d")).alias("ds"))
    start = F.struct(F.lit(0).alias("c"), F.lit(None).cast("int").alias("a"), F.array().cast("array<struct<d:int,c:int>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        new = acc["a"].isNull() | (d - acc["a"] > span_days)
        c = F.when(new, acc["c"] + 1).otherwise(acc["c"])
        return F.struct(c.alias("c"), F.when(new, d).otherwise(acc["a"]).alias("a"), F.concat(acc["out"], F.array(F.struct(d.alias("d"), c.alias("c")))).alias("out"))

    numbered = days.select(account, F.explode(F.aggregate("ds", start, step, lambda acc: acc["out"])).alias("x")).select(account, F.col("x.d").alias("_d"), F.col("x.c").alias(name))
    return base.join(numbered, [account, "_d"]).drop("_d")


def cluster_summary(df: DataFrame, account: str, cluster: str, when: str, amount: str, vendor: str) -> DataFrame:
    """One row per cluster: size, distinct vendors, total, first and last day, span in days."""
    g = df.groupBy(account, cluster).agg(F.count("*").alias("size"), F.countDistinct(vendor).alias("vendors"), F.coalesce(F.sum(exact(F.col(amount))).cast("double"), F.lit(0.0)).alias("total"), F.min(F.to_date(when)).alias("first_day"), F.max(F.to_date(when)).alias("last_day"))
    return g.withColumn("span_days", F.datediff("last_day", "first_day"))
