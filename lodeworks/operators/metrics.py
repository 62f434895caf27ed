"""How good labels, scores and probabilities are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.values import ratio
from lodeworks.operators.ordered import average_ranks, equal_count_bins


def confusion(df: DataFrame, said: Column, true: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, n, accuracy, precision, recall, base_rate, majority and whether the rule beats it. Rows where either is null don't count."""
    rows = df.withColumn("_s", said).withColumn("_t", true).where("_s is not null and _t is not null")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    s, t = F.col("_s"), F.col("_t")
    g = rows.groupBy(*(by or [])).agg(n(s & t).alias("tp"), n(s & ~t).alias("fp"), n(~s & t).alias("fn"), n(~s & ~t).alias("tn"), F.count("*").alias("n"))
    base = ratio(F.col("tp") + F.col("fn"), F.col("n"))
    g = g.withColumns({"accuracy": ratio(F.col("tp") + F.col("tn"), F.col("n")), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "base_rate": base, "majority": F.greatest(base, 1 - base)})
    return g.withColumn("beats_majority", F.col("accuracy") > F.col("majority"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row with ``auc`` from average ranks; null where a class is empty. Null scores and labels don't count."""
    r = average_ranks(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(score).alias("s")), "s", "r")
    g = r.agg(F.sum("y").alias("n1"), F.count("*").alias("n"), F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("r1"))
    return g.select(F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * (F.col("n") - F.col("n1"))).alias("auc"))


def calibration(df: DataFrame, label: str, score: str, tie: str, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, observed, gap) of bins of equal count by score."""
    b = equal_count_bins(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(tie, F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("p")), ["p", tie], bins)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed")).withColumn("gap", F.col("observed") - F.col("predicted"))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: n, mean squared error, mean prediction, mean outcome."""
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    return df.where(y.isNotNull() & p.isNotNull()).agg(F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


def calibration_error(table: DataFrame) -> DataFrame:
    """One row with the gap of a calibration table, absolute and weighted by bin size."""
    return table.agg(F.try_divide(F.sum(F.col("n") * F.abs("gap")), F.sum("n")).alias("ece"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row with the rank correlation; null where either side is constant. Rows with a null don't count."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    r = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    g = r.agg(F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.covar_pop("rx", "ry").alias("c"))
    return g.select(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")).alias("spearman"))


def top_overlap(df: DataFrame, key: str, a: str, b: str, n: int) -> DataFrame:
    """One row: how many of the top ``n`` by ``a`` are among the top ``n`` by ``b``, and the share. A top-k report on each side."""
    top = lambda c: df.where(F.col(c).isNotNull()).orderBy(F.desc(c), key).limit(n).select(key)
    return top(a).join(top(b), key, "left_semi").agg(F.count("*").alias("shared")).withColumn("overlap", F.col("shared") / F.lit(float(n)))


def pair_sets(found: DataFrame, true: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall of two sets of pairs; a pair that stands twice counts once."""
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(true.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    f, t = F.col("f").isNotNull(), F.col("t").isNotNull()
    g = both.agg(n(f & t).alias("tp"), n(f & ~t).alias("fp"), n(~f & t).alias("fn"))
    return g.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
