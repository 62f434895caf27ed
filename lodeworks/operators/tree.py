"""Per-key aggregates where a few keys hold most rows.

Every input chunk (a partition, whose size ``spark.sql.files.maxPartitionBytes`` fixes for a scan) combines its own rows;
the states are then merged in rounds, ``fan_in`` nodes at a time, so that a reducer gets at most ``fan_in`` states of a key
however many chunks there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.columns import exact, free_name


def chunks_of(df: DataFrame) -> int:
    """How many chunks the plan's sources make, by their sizes: read off the plan, nothing runs. A source of unknown size
    counts as one chunk a core. Rounds are laid out by it; no result depends on it."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [float(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    chunk = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(math.ceil(sum(n for n in sizes if n < 2.0**60) / chunk), spark.sparkContext.defaultParallelism)


def rounds_of(chunks: int, fan_in: int) -> int:
    """Merge rounds until one node is left."""
    rounds = 1
    while fan_in**rounds < chunks:
        rounds += 1
    return rounds


def tree_aggregate(df: DataFrame, keys: list[str], leaf: dict[str, Column], merge: dict[str, Callable[[Column], Column]], fan_in: int = 16, rounds: int | None = None) -> DataFrame:
    """One row per key with the states that ``leaf`` makes of rows and ``merge`` of states.

    ``leaf`` names an aggregate over rows, ``merge`` the function that aggregates the column of states of that name. Null
    keys form a key. An empty table gives no rows. The last of the ``rounds`` (by the size of the sources, if not given)
    goes by the keys alone, so there is one row a key whatever partitions the plan has when it runs; should there be more of
    them than the rounds were laid out for, a node takes more than ``fan_in`` states and nothing else changes.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    rounds = rounds or rounds_of(chunks_of(df), fan_in)
    (node,) = free_name(df, "node")
    state = df.withColumn(node, F.spark_partition_id())
    for r in range(rounds):
        nodes = fan_in ** (rounds - 1 - r)
        by = [F.pmod(F.floor(F.col(node) / fan_in), F.lit(nodes)).cast("int").alias(node)] if nodes > 1 else []
        state = state.groupBy(*keys, *by).agg(*[(leaf[n] if r == 0 else merge[n](F.col(n))).alias(n) for n in leaf])
    return state


def key_totals(df: DataFrame, fields: list[str], amount: str, when: str, fan_in: int = 4, rounds: int | None = None) -> DataFrame:
    """(field_name, key_value, n, total, first_at, last_at) of every value of every field, null included.

    ``total`` sums non-null amounts exactly (NaN and infinities count as null) and is 0.0 where there are none; the dates
    are null where all are. The fields are unfolded within each task, so the table is read once.
    """
    folded = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("key_value")) for f in fields])).alias("kv"), exact(F.col(f"`{amount}`")).alias("x"), F.col(f"`{when}`").alias("t")).select("kv.field_name", "kv.key_value", "x", "t")
    states = tree_aggregate(
        folded,
        ["field_name", "key_value"],
        {"n": F.count("*"), "total": F.sum("x"), "first_at": F.min("t"), "last_at": F.max("t")},
        {"n": F.sum, "total": F.sum, "first_at": F.min, "last_at": F.max},
        fan_in,
        rounds,
    )
    return states.withColumn("total", F.coalesce(F.col("total").cast("double"), F.lit(0.0)))


def heavy_keys(totals: DataFrame, rows: DataFrame, share: float = 0.02) -> DataFrame:
    """(field_name, key_value) of the non-null values in more than ``share`` of all ``rows``. No rows, no keys. The number of
    all rows comes from the files' footers, as no column is read for it."""
    everything = rows.select(F.lit(1).alias("one")).agg(F.count("*").alias("rows"))
    return totals.where("key_value is not null").where(F.col("n") > F.lit(share) * everything.scalar()).select("field_name", "key_value")
