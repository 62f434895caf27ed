"""Flows between primes and subs, as an edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.columns import exact
from lodeworks.functions.values import clip, ratio


def prime_flows(subs: DataFrame, primes: DataFrame, key: str, sub_amount: str, sub_name: str, prime_amount: str, labels: DataFrame | None = None, label_key: str = "", label: str = "", distinct: dict[str, str] | None = None, carried: list[str] | None = None) -> DataFrame:
    """One row per prime with subs: number of subs and of distinct names, total, share of the prime's own amount within
    [0, 3], and, of subs with a label, the share that goes to those labelled true. ``distinct`` names further counts of distinct
    values of subs, ``carried`` columns of the prime that come along.

    ``subs`` are folded by key before they meet ``primes``, so a prime with many subs is one row in the join."""
    rows = subs.where(F.col(key).isNotNull())
    yes = F.lit(None).cast("boolean")
    if labels is not None:
        rows = rows.join(labels.select(F.col(label_key), F.col(label).alias("_l")), label_key, "left")
        yes = F.col("_l")
    total = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    x = exact(F.col(sub_amount))
    g = rows.groupBy(key).agg(F.count("*").alias("subs"), F.countDistinct(sub_name).alias("names"), total(x).alias("flow"), total(F.when(yes, x)).alias("to_true"), total(F.when(yes.isNotNull(), x)).alias("labelled"), *[F.countDistinct(c).alias(n) for n, c in (distinct or {}).items()])
    joined = g.join(primes.select(key, F.col(prime_amount).alias("own"), *(carried or [])), key)
    return joined.select(key, "subs", "names", "flow", "own", clip(ratio(F.col("flow"), F.col("own")), 0.0, 3.0).alias("passthrough"), ratio(F.col("to_true"), F.col("labelled")).alias("true_share"), *(distinct or {}), *(carried or []))


def edges(subs: DataFrame, source: str, target: str, amount: str, key: str, day: Column) -> DataFrame:
    """(source, target, rows, awards, total, first_day, last_day) of each pair of parties, both known."""
    return subs.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(source, target).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("awards"), F.coalesce(F.sum(exact(F.col(amount))).cast("double"), F.lit(0.0)).alias("total"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
