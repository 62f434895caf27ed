"""Generated series that hang on real keys; every value follows from the key and a seed."""

from __future__ import annotations

import math
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.values import bucket


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that the parts and the seed determine, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number (Box-Muller) that the parts and the seed determine."""
    u, v = uniform(seed, F.lit("u"), *parts), uniform(seed, F.lit("v"), *parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(F.lit(2 * math.pi) * v)


def poisson(seed: int, mean: Column, *parts: Column) -> Column:
    """A Poisson count: the number of steps that a uniform number exceeds of the distribution, by folding its terms.

    A number in [0, 1) of 53 binary digits exceeds no step that is more than ten deviations and 40 above the mean, so the fold
    ends there. Means above 700, whose first term a double can't hold, give null.
    """
    u = uniform(seed, F.lit("p"), *parts)
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), F.lit(0).alias("k"))
    step = lambda a, i: F.struct((a["term"] * mean / i).alias("term"), (a["sum"] + a["term"] * mean / i).alias("sum"), (a["k"] + (u > a["sum"]).cast("int")).alias("k"))
    most = F.ceil(mean + 10 * F.sqrt(mean) + 40).cast("int")
    return F.when(mean <= 700, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["k"]))


def gamma(seed: int, shape: int, scale: Column, *parts: Column) -> Column:
    """A gamma number of a whole shape that the parts and the seed determine: the sum of so many exponential ones."""
    logs = [F.log(1 - uniform(seed, F.lit(f"g{i}"), *parts)) for i in range(shape)]
    return -scale * reduce(lambda a, b: a + b, logs)


def month_frame(keys: DataFrame, key: str, first: date, months: int) -> DataFrame:
    """(key, month) for the distinct non-null keys and so many month starts: an explode, not a join."""
    last = F.add_months(F.lit(first), months - 1)
    return keys.where(F.col(key).isNotNull()).select(key).distinct().select(key, F.explode(F.sequence(F.lit(first), last, F.expr("interval 1 month"))).alias("month"))


def telemetry(keys: DataFrame, key: str, level: Column, first: date, months: int, seed: int) -> DataFrame:
    """(key, month, utilisation): a level, a random walk and a yearly wave, within [0.05, 0.99]. Marked GENERATED."""
    frame = month_frame(keys, key, first, months).join(keys.select(key, level.alias("_level")).groupBy(key).agg(F.max("_level").alias("_level")), key)
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = F.sum(normal(seed, F.col(key), F.col("month")) * F.lit(0.02)).over(w)
    wave = F.lit(0.018) * F.sin(F.lit(2 * math.pi / 12) * (F.month("month") - 7))
    return frame.withColumn("_walk", walk).select(key, "month", F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.col("_level") + F.col("_walk") + wave)).alias("utilisation"), F.lit("GENERATED").alias("provenance"))


def cases(keys: DataFrame, key: str, mean: Column, severities: dict[str, float], seed: int, slow: tuple[str, ...] = (), scales: tuple[float, float] = (18.0, 7.0)) -> DataFrame:
    """(key, case_no, severity, hours): a Poisson number of cases a key, each with a severity by its share and the hours that it
    took, of a gamma distribution of shape 2 whose scale is greater for the ``slow`` severities."""
    n = keys.select(key, poisson(seed, mean, F.col(key)).alias("n")).where("n > 0")
    out = n.select(key, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("case_no"))
    u, edge, sev = uniform(seed, F.lit("s"), F.col(key), F.col("case_no")), 0.0, None
    for name, share in severities.items():
        edge += share
        sev = F.when(u < edge, name) if sev is None else sev.when(u < edge, name)
    out = out.withColumn("severity", sev.otherwise(name))
    scale = F.when(F.col("severity").isin(*slow), scales[0]).otherwise(scales[1]) if slow else F.lit(scales[1])
    return out.withColumn("hours", F.round(gamma(seed, 2, scale, F.col(key), F.col("case_no")), 1))


#: Bands of health, each up to and with its upper edge.
BANDS = {"at_risk": 40.0, "watch": 60.0, "stable": 80.0, "strong": 100.0}


def health(accounts: DataFrame, key: str, level: Column, trend: Column, load: Column, severe: Column, coverage: Column, dormant: Column, seed: int) -> DataFrame:
    """(key, score, band, provenance): a composite within [0, 100] of generated use and cases and of real coverage and dormancy,
    with noise that the key determines. Missing parts count as their neutral value. Marked GENERATED."""
    within = lambda c, reach: F.greatest(F.lit(-reach), F.least(F.lit(reach), c)) / F.lit(reach)
    or_zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    parts = [
        F.lit(62.0), within(F.coalesce(level, F.lit(0.5)) - 0.5, 0.4) * 12, within(or_zero(trend), 0.15) * 14, F.least(or_zero(load), F.lit(4.0)) * -6,
        F.least(or_zero(severe), F.lit(8.0)) * -1.6, (or_zero(coverage) - 0.5) * 26, F.when(F.coalesce(dormant, F.lit(False)), -16.0).otherwise(4.0), normal(seed, F.lit("h"), F.col(key)) * 4,
    ]
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), reduce(lambda a, b: a + b, parts))), 1)
    band = bucket(F.col("score"), [-0.1, *BANDS.values()], list(BANDS), right=True)
    return accounts.select(key, score.alias("score")).withColumn("band", band).withColumn("provenance", F.lit("GENERATED"))
