"""Ranks and running totals over a whole table, without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.sources.shared import settle


#: An order: column names, with a leading minus for descending. Nulls come first when ascending, last when descending.
Order = list[str]


def _keys(order: Order) -> list[Column]:
    return [F.col(o[1:]).desc_nulls_last() if o[0] == "-" else F.col(o).asc_nulls_first() for o in order]


def running(df: DataFrame, order: Order, totals: dict[str, Column], before: bool = False) -> DataFrame:
    """``df`` with running totals in ``order`` (which should have no ties), up to and with the row, or ``before`` it.

    The table is split into ranges of the order; each range adds up its own rows, and what the ranges before it hold comes
    from a table of one row a range, whose number is that of the shuffle partitions.
    """
    ranged = df.withColumns({f"_v{n}": c for n, c in totals.items()})
    keys = _keys(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(ranged.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    sums = ranged.groupBy("_part").agg(*[F.sum(f"_v{n}").alias(f"_s{n}") for n in totals])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_s{n}").over(earlier), F.lit(0)).alias(f"_b{n}") for n in totals])
    out = ranged.withColumns({f"_w{n}": F.coalesce(F.sum(f"_v{n}").over(w), F.lit(0)) for n in totals}).join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, *[(F.col(f"_w{n}") + F.col(f"_b{n}")).alias(n) for n in totals])


def ranked(df: DataFrame, order: Order, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based position in ``order``; ties must be broken by the order."""
    return running(df, order, {name: F.lit(1).cast("bigint")})


def average_ranks(df: DataFrame, value: str, name: str = "avg_rank") -> DataFrame:
    """``df`` with the average of the 1-based positions of its ``value``; null values have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    below = running(counts, [value], {"_below": F.col("_n")}, before=True)
    ranks = below.select(value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, value, "left")


def equal_count_bins(df: DataFrame, order: Order, k: int, name: str = "bin") -> DataFrame:
    """``df`` with bins 1..k of equal size by position, edges as quantiles of the positions have them: not ``ntile``."""
    pos = ranked(df, order, "_pos")
    n = df.agg(F.count("*").alias("n"))
    exact = F.ceil((F.col("_pos") - 1) * k / F.nullif(n.scalar() - 1, F.lit(0)))
    return pos.withColumn(name, F.greatest(F.lit(1), F.coalesce(exact, F.lit(1))).cast("int")).drop("_pos")
