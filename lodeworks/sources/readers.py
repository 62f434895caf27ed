"""Readers of landed files: zipped and headerless CSV, fixed width, snapshots, filings, with checks of what landed."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeworks.functions.values import to_number
from lodeworks.sources.shared import Files


#: Bytes of CSV that a task parses at a time; a longer row fails the read.
BLOCK = 32 << 20


def _members(where: str, content: bytes, zipped: bool) -> Iterator[tuple[str, Callable[[], io.BufferedIOBase]]]:
    """The CSV files of a landed file, by name: members of an archive, or the file itself. Each is opened as often as needed."""
    if not zipped:
        yield where.rsplit("/", 1)[-1], lambda: io.BytesIO(content)
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
            yield name, lambda name=name: z.open(name)


def _header(raw: io.BufferedIOBase) -> list[str]:
    with io.TextIOWrapper(raw, "utf-8-sig", newline="") as text:
        return next(csv.reader(text), [])


def _parsed(raw: io.BufferedIOBase, header: list[str], wanted: list[str]) -> Iterator[pa.RecordBatch]:
    """The wanted columns as texts, by column; rows of more or fewer fields than the header has are read by themselves."""
    odd: list[str] = []

    def by_itself(row) -> str:
        odd.append(row.text)
        return "skip"

    reader = pacsv.open_csv(
        raw,
        read_options=pacsv.ReadOptions(block_size=BLOCK, use_threads=False),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=by_itself),
        convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(header, pa.string()), include_columns=wanted, include_missing_columns=True, strings_can_be_null=True, null_values=[""]),
    )
    for b in reader:
        yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in b.columns], names=wanted)
    if odd:
        csv.field_size_limit(1 << 31)
        rows = [dict(zip(header, r)) for r in csv.reader(odd)]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(c) or None for r in rows], pa.string()) for c in wanted], names=wanted)


def _csv_files(spark: SparkSession, path: str, wanted: list[str], needed: list[str], zipped: bool) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in wanted) + ", member string, path string"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            for where, content in zip(f["path"].to_pylist(), f["content"].to_pylist()):
                for name, opened in _members(where, content, zipped):
                    header = _header(opened())
                    if not header or not set(needed) <= set(header):
                        continue
                    for b in _parsed(opened(), header, wanted):
                        tell = lambda text, n=b.num_rows: pa.array([text] * n, pa.string())
                        yield pa.RecordBatch.from_arrays([*b.columns, tell(name), tell(where)], names=[*wanted, "member", "path"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, schema)


def zipped_csv(spark: SparkSession, path: str, wanted: list[str], tag_pattern: str = r"([^/]+)$") -> DataFrame:
    """Rows of the CSV members of all archives under ``path``: the wanted columns as texts, null where a member lacks one,
    with ``member``, and ``tag`` from the archive's name. Line breaks may stand within quotes; a row with fewer fields than the header
    has nulls, one with more loses those. An archive is one task, so land archives of bounded size."""
    return _csv_files(spark, path, wanted, [], True).withColumn("tag", F.regexp_extract("path", tag_pattern, 1)).drop("path")


def headed_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and line breaks within quotes; columns are pruned and typed by the schema, bad values become null."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="PERMISSIVE").csv(path)


def routed(spark: SparkSession, paths: dict[str, str], schema: StructType | str, tag: str) -> DataFrame:
    """CSV files of several pulls with the name of the pull in ``tag``."""
    parts = [headed_csv(spark, p, schema).withColumn(tag, F.lit(k)) for k, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fixed_width(spark: SparkSession, path: str, layout: dict[str, tuple[int, int]], encoding: str = "ISO-8859-1") -> DataFrame:
    """Texts cut by a layout of (start from 1, length), outer blanks off, blank fields null; blank lines are skipped."""
    # the text source reads UTF-8 only; the CSV source decodes, and here sees one column a line
    whole = {"encoding": encoding, "sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines = spark.read.schema("value string").options(**whole).csv(path).where(F.trim("value") != "")
    cell = lambda s, n: F.trim(F.substring("value", s, n))
    return lines.select(*[F.when(cell(s, n) != "", cell(s, n)).alias(c) for c, (s, n) in layout.items()])


def delimited(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Headerless CSV of exactly these columns as trimmed texts; a row of another number of fields fails the read."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("mode", "FAILFAST").csv(path)
    return raw.select(*[F.trim(c).alias(c) for c in columns])


def json_document(spark: SparkSession, path: str, schema: StructType | str, default: str | None = None, lines: bool = False) -> DataFrame:
    """One JSON document a file (or, with ``lines``, a line); where there is no file, the ``default`` document, or else no row."""
    if not Files(spark, path).exists(path):
        given = spark.createDataFrame([(default,)] if default is not None else [], "j string")
        return given.select(F.from_json("j", schema if isinstance(schema, str) else schema.json()).alias("d")).select("d.*")
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def snapshots(spark: SparkSession, path: str, wanted: list[str], needed: list[str], zipped: bool = False) -> DataFrame:
    """Daily CSV snapshots (or archives of them) as one table of texts with ``member``; a snapshot whose header lacks a needed
    column gives no rows. Columns may differ in order and number from day to day. A file is one task."""
    return _csv_files(spark, path, wanted, needed, zipped).drop("path")


def annual_facts(doc: DataFrame, json_column: str, tag: str, taxonomy: str = "us-gaap", form: str = "10-K", period: str = "FY", unit: str = "USD") -> DataFrame:
    """(start, end, value, filed) of a company's yearly figures of one tag: whole filings of ``form``, of each (start, end) the
    value filed last, newest first."""
    fact = "array<struct<start:string,end:string,val:double,form:string,fp:string,filed:string>>"
    facts = F.from_json(F.get_json_object(json_column, f"$.facts.{taxonomy}.{tag}.units.{unit}"), fact)
    rows = doc.select(F.explode(facts).alias("f")).select("f.*").where((F.col("form") == form) & (F.col("fp") == period) & F.col("start").isNotNull())
    last = rows.groupBy("start", "end").agg(F.max(F.struct("filed", "val")).alias("m"))
    return last.select("start", "end", F.col("m.val").alias("value"), F.col("m.filed").alias("filed")).orderBy(F.desc("end"), F.desc("start"))


def period_ratio(a: DataFrame, b: DataFrame, newest: int) -> DataFrame:
    """(start, end, a, b, ratio) of the ``newest`` periods that both series have."""
    both = a.select("start", "end", F.col("value").alias("a")).join(b.select("start", "end", F.col("value").alias("b")), ["start", "end"])
    return both.withColumn("ratio", F.try_divide("b", "a")).orderBy(F.desc("end")).limit(newest)


def narrative_figures(html: Column, patterns: dict[str, str]) -> list[Column]:
    """Numbers that patterns (one group each) find in a page's text, tags and runs of blanks aside; null where there is none."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"(?:&nbsp;|&#160;|\s)+", " ")
    return [to_number(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))).alias(n) for n, p in patterns.items()]


def landed(spark: SparkSession, path: str, magic: bytes = b"PK\x03\x04") -> DataFrame:
    """(path, bytes, sha256, is_kind, looks_html) of landed files: whether they begin as they should, or are an error page."""
    f = spark.read.format("binaryFile").load(path)
    start = F.lower(F.decode(F.substring("content", 1, 200), "ISO-8859-1"))
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), (F.hex(F.substring("content", 1, len(magic))) == magic.hex().upper()).alias("is_kind"), start.rlike(r"^\s*<(!doctype|html)").alias("looks_html"))


def pull_windows(first_year: int, last_year: int, years: int, lo: date, hi: date) -> list[tuple[date, date]]:
    """Windows of so many fiscal years (October to September), clamped to [lo, hi]."""
    out = []
    for y in range(first_year, last_year + 1, years):
        a, b = max(date(y - 1, 10, 1), lo), min(date(min(y + years - 1, last_year), 9, 30), hi)
        if a <= b:
            out.append((a, b))
    return out


def pulled(df: DataFrame, when: str, filters: dict[str, Column], window: tuple[date, date], tag: str) -> DataFrame:
    """What separate pulls over one window return: for each filter its rows with the filter's name, so rows may come twice."""
    rows = df.where(F.to_date(when).between(F.lit(window[0]), F.lit(window[1])))
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in filters.items()]))
    return rows.select("*", F.explode(tags).alias(tag))
