"""Tolerant parsing, dates, guarded arithmetic and number formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date notations in the order in which they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "d MMMM yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
TRUE_WORDS, FALSE_WORDS = ("T", "TRUE", "Y", "YES", "1"), ("F", "FALSE", "N", "NO", "0")


def to_day(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date of a text in any of the notations, else null. Outer blanks don't matter."""
    text = F.trim(c)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def to_number(c: Column) -> Column:
    """The double of a text with thousands commas or a currency sign, else null; NaN becomes null."""
    n = F.regexp_replace(F.trim(c), "[,$]", "").try_cast("double")
    return F.when(~F.isnan(n), n)


def strict_day(c: Column) -> Column:
    """The date of a text that is exactly ``DD-MON-YYYY``, else null."""
    return F.when(c.rlike(r"^\d{2}-[A-Za-z]{3}-\d{4}$"), F.to_date(F.try_to_timestamp(c, F.lit("dd-MMM-yyyy"))))


def new_year_tell(c: Column) -> Column:
    """Whether a raw date text is a 1 January, as imputed dates are; null counts as no."""
    return F.coalesce(F.upper(c).startswith("01-JAN"), F.lit(False))


def truthy(c: Column) -> Column:
    """True, false or null of a flag in any of its notations."""
    w = F.upper(F.trim(c))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def fiscal_year(c: Column) -> Column:
    """Fiscal year that begins in October."""
    return F.year(F.add_months(F.to_date(c), 3))


def days_between(a: Column, b: Column) -> Column:
    """Whole days from ``a`` to ``b``, rounded down also for negative and sub-day differences."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(b) - micros(a)) / F.lit(86_400_000_000)).cast("int")


def ratio(x: Column, y: Column) -> Column:
    """x / y; null where y is 0 or either is null."""
    return F.try_divide(x, y)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """``c`` within the bounds; null stays null (greatest and least would ignore it)."""
    x = c
    if low is not None:
        x = F.greatest(x, F.lit(low))
    if high is not None:
        x = F.least(x, F.lit(high))
    return F.when(c.isNotNull(), x)


def lookup(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a small fixed table; ``default`` for other keys and null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default)) if default is not None else F.try_element_at(pairs, c)


def bucket(c: Column, edges: list[float], labels: list[str] | None = None, right: bool = False) -> Column:
    """Index (or label) of the half-open bin [edge, next edge), or with ``right`` of (edge, next edge]; null outside the edges and for null."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        value = F.lit(labels[i] if labels else i)
        hit = (c > lo) & (c <= hi) if right else (c >= lo) & (c < hi)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def two_sided(name: Column, words: dict[str, list[str]], code: Column, codes: dict[str, tuple[str, ...]], default: str = "unknown") -> Column:
    """One of two labels: that of the words which stand in the name, if those of the other don't; else that of the code; else
    ``default``. A null name has no words, a null code no label."""
    (a, b), upper = words, F.upper(name)
    has = {k: F.coalesce(reduce(lambda p, q: p | q, [upper.contains(w) for w in ws]), F.lit(False)) for k, ws in words.items()}
    out = F.when(has[a] & ~has[b], a).when(has[b] & ~has[a], b)
    for label, values in codes.items():
        out = out.when(code.isin(*values), label)
    return out.otherwise(default)


def mode(c: Column) -> Column:
    """Most frequent non-null value of a group, the smallest among equals."""
    return F.mode(c, True)


def string_set(c: Column) -> Column:
    """Distinct non-null values of a group, sorted and joined by ``;``."""
    return F.array_join(F.array_sort(F.collect_set(c)), ";")


def dollars(c: Column) -> Column:
    """``$1,234``, half-even like the evidence texts need."""
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(c), 0))


def percent(c: Column, digits: int = 0) -> Column:
    return F.coalesce(F.concat(F.format_number(c * 100, digits), F.lit("%")), F.lit("n/a"))


def short_dollars(c: Column) -> Column:
    """``$950``, ``$1.2m`` and the like, ``n/a`` for null: thousands by the power of ten, to one place."""
    thousands = F.least(F.floor(F.log10(F.greatest(F.abs(c), F.lit(1.0))) / 3), F.lit(3)).cast("int")
    text = F.when(thousands == 0, F.format_number(c, 0)).otherwise(F.format_number(c / F.pow(F.lit(1000.0), thousands), 1))
    return F.coalesce(F.concat(F.lit("$"), text, F.element_at(F.array(*map(F.lit, ("", "k", "m", "bn"))), thousands + 1)), F.lit("n/a"))
