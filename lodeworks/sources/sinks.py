"""Writers: tables, reports, JSON that every parser reads, capped sections that say so."""

from __future__ import annotations

import json
import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.sources.shared import Files


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, force: bool = True) -> bool:
    """Overwrite a table; with ``force`` off, leave a finished one as it is. Tells whether it wrote."""
    if not force and Files(df.sparkSession, path).exists(f"{path}/_SUCCESS"):
        return False
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return True


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_safe(df: DataFrame, digits: int = 6) -> DataFrame:
    """``df`` with floats rounded half-even and NaN and infinities null, and dates and timestamps as ``yyyy-MM-dd``."""

    def clean(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.bround(c.cast("double"), digits)).alias(name)
        if kind in ("date", "timestamp", "timestamp_ntz"):
            return F.date_format(c, "yyyy-MM-dd").alias(name)
        return c.alias(name)

    return df.select(*[clean(n, k) for n, k in df.dtypes])


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object with its nulls."""
    return json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def as_json(value) -> object:
    """A driver-side value as JSON has it: written and read again, numbers that JSON lacks become null, others have six places,
    days and times are their day."""
    text = json.dumps(value, default=lambda o: f"{o:%Y-%m-%d}" if isinstance(o, date) else float(o))
    return json.loads(text, parse_constant=lambda _: None, parse_float=lambda digits: round(float(digits), 6))


def section(df: DataFrame, order: list[Column], cap: int) -> dict:
    """The first ``cap`` rows in an order for a page, with the number of all rows and whether some were left out. The cap is
    the feature: a page shows so many; the table itself is written whole elsewhere."""
    rows = [as_json(r.asDict(recursive=True)) for r in df.orderBy(*order).limit(cap).collect()]
    total = df.count()
    return {"rows": rows, "total": total, "capped": total > len(rows)}


def write_report(df: DataFrame, report: dict, path: str) -> None:
    """A small report as one JSON file, whole or not at all."""
    Files(df.sparkSession, path).write_once(path, json.dumps(as_json(report), indent=1, sort_keys=True))


def for_script(document: dict) -> str:
    """JSON that may stand in a script element."""
    return json.dumps(as_json(document)).replace("</", "<\\/")


def digest(document: dict, wanted: dict[str, str]) -> dict:
    """Figures of a document for a cover page: each wanted name with what stands at its path (keys joined by dots), or null."""

    def at(path: str):
        here = document
        for key in path.split("."):
            here = here.get(key) if isinstance(here, dict) else None
        return here

    return {name: at(path) for name, path in wanted.items()}


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table."""
    cell = lambda v: str("" if v is None else v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]])


def injected(text: str, marker: str, body: str) -> str:
    """``text`` with what stands between a marker's two comments replaced; it must have them once."""
    between = re.compile(rf"(?<=<!-- {re.escape(marker)} -->).*?(?=<!-- /{re.escape(marker)} -->)", re.DOTALL)
    out, places = between.subn(lambda _: f"\n{body}\n", text)
    if places != 1:
        raise ValueError(f"{places} places for {marker}, not one")
    return out


def manifest(df: DataFrame) -> DataFrame:
    """(columns, rows, checksum) of a table, the checksum not depending on row order."""
    return df.agg(F.lit(len(df.columns)).alias("columns"), F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))
