"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_number(c: Column) -> Column:
    """Whole days since 1970-01-01 of a date or timestamp; null stays null."""
    return F.unix_date(F.to_date(c))


def day_text(n: Column) -> Column:
    """``yyyy-MM-dd`` of a day number."""
    return F.date_format(F.date_from_unix_date(n.cast("int")), "yyyy-MM-dd")


def exact(c: Column) -> Column:
    """A double as a decimal with six places, so that sums do not depend on order and retractions cancel. NaN and infinities become null."""
    return c.try_cast("decimal(28,6)")


def exact_sum(c: Column) -> Column:
    """Sum of ``exact(c)`` as a double; 0.0 where nothing is summed."""
    return F.coalesce(F.sum(exact(c)).cast("double"), F.lit(0.0))


def tidy_key(c: Column) -> Column:
    """A key without outer blanks, in upper case; blank becomes null."""
    t = F.upper(F.trim(c))
    return F.when(t != "", t)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names not among the columns of ``df`` (nor each other), made from the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out
