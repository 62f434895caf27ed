"""Conforming extracts: unions, keep-latest, profiles, validated lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeworks.operators.ordered import running
from lodeworks.sources.shared import Files


def only_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that the table has, in the wanted order."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in have])


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts by column name; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def keep_latest(df: DataFrame, key: Column, latest: str, row_id: str) -> DataFrame:
    """One whole row per non-null key: greatest ``latest`` (null smallest), then smallest ``row_id``. One aggregate that keeps the
    best row of each key in a task before it shuffles, so rows travel once and a hot key leaves one a task."""
    rows = df.select(key.alias("k"), F.struct(F.col(latest).alias("l"), (-F.col(row_id)).alias("i")).alias("s"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r")).where("k is not null")
    return rows.groupBy("k").agg(F.max_by("r", "s").alias("r")).select("r.*")


def missingness(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, column_name, rows, null_rate) of each column for each value of ``by``, and over all rows (``overall`` true): one pass."""
    rates = df.rollup(by).agg(F.grouping(by).alias("g"), F.count("*").alias("rows"), *[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"r{i}") for i, c in enumerate(columns)])
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"r{i}").alias("null_rate")) for i, c in enumerate(columns)]))
    return rates.select(F.col(by), (F.col("g") == 1).alias("overall"), "rows", long.alias("x")).select(by, "overall", "x.column_name", "rows", "x.null_rate")


def value_counts(df: DataFrame, column: str, keep_null: bool = True, top: int | None = None) -> DataFrame:
    """(value, n), most frequent first, ties by value; null is a value if ``keep_null``."""
    base = df if keep_null else df.where(F.col(column).isNotNull())
    counts = base.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(top) if top else counts


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with each wanted (column, share) as the exact quantile of the column's non-null values, between two neighbours by
    distance; null where there is none.

    Values fold to counts, which are ranked by ranges; the two neighbours are picked by position, so no task holds all values.
    """
    cells = {}
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
        ranked = running(counts, ["v"], {"before": F.col("n")}, before=True)
        last = ranked.agg((F.max(F.col("before") + F.col("n")) - 1).alias("last")).scalar()
        picks = []
        for name, (c, q) in wanted.items():
            if c == column:
                at = F.lit(float(q)) * last
                of = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("n")), F.col("v")))
                lo, hi = of(F.floor(at)), of(F.ceil(at))
                picks.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
        row = ranked.agg(*picks)
        cells |= {name: row.select(name).scalar() for name in row.columns}
    return df.sparkSession.range(1).select(*[cells[name].alias(name) for name in wanted])


def capped(df: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows in an order for a page, each with ``total`` and whether some were left out. The cap is the feature."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.orderBy(*order).limit(cap).select("*", total.alias("total"), (total > cap).alias("capped"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that fails when the right side has a key twice, at run time and without a pass of its own.

    The right side is grouped by its key; a group of two or more raises an error in the task that sees it. Null keys match nothing.
    """
    rest = [c for c in right.columns if c not in on]
    checked = right.groupBy(*on).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    sure = checked.withColumn("_r", F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("key is not unique: "), F.to_json(F.struct(*on))))))
    return left.join(sure, on, how).select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def suffixed(df: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    """``df`` with a suffix on the named columns."""
    return df.withColumnsRenamed({c: c + suffix for c in columns})


def first_match(left: DataFrame, tables: list[tuple[DataFrame, list[str], list[str]]], value: str, out: str) -> DataFrame:
    """``out`` from the first of several lookup tables that has the row's key: (table, key columns of ``left``, those of the table).

    Keys may have several columns; a null in one matches nothing. A key that a table repeats counts with its smallest
    non-null value, so no row of ``left`` is ever multiplied.
    """
    found, names = left, []
    for i, (table, keys, others) in enumerate(tables):
        names.append(f"_m{i}")
        once = table.groupBy(*[F.col(o).alias(k) for k, o in zip(keys, others, strict=True)]).agg(F.min(value).alias(names[-1]))
        found = found.join(once, keys, "left")
    return found.select(*left.columns, F.coalesce(*names).alias(out))


def joined_key(*columns: Column, sep: str = "|") -> Column:
    """One text of several key columns: outer blanks off, nulls and blanks as nothing between separators; null if all are."""
    parts = [F.coalesce(F.trim(c.cast("string")), F.lit("")) for c in columns]
    key = F.concat_ws(sep, *parts)
    return F.when(F.length(F.concat(*parts)) > 0, key)


def optional_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    return spark.read.schema(schema).parquet(path) if Files(spark, path).exists(path) else spark.createDataFrame([], schema)
