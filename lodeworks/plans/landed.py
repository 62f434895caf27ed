"""Queries that write what a source lands as, from whole test tables, and read it back by the readers; SQL says what was written."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import values as v
from lodeworks.operators import conform, curves
from lodeworks.plans import governance
from lodeworks.plans.reference import table
from lodeworks.sources import readers, sinks
from lodeworks.sources.shared import fresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def zipped(df: DataFrame, folder: str, kind: str, parts: int) -> str:
    """``df`` as CSV members of zip archives below ``folder``, one archive a partition; each task writes its own."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        whole = [f for f in frames if len(f)]
        if not whole:
            return
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for i, f in enumerate(whole):
                z.writestr(f"{kind}_{i}.csv", f.to_csv(index=False))
            z.writestr("readme.txt", "not a table")
        name = f"{folder}/pull_{kind}_{TaskContext.get().partitionId()}.zip"
        place, path = fs.FileSystem.from_uri(name)
        place.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with place.open_output_stream(path) as out:
            out.write(packed.getvalue())
        yield pd.DataFrame({"rows": [sum(map(len, whole))]})

    df.repartition(parts).mapInPandas(write, "rows bigint").agg(F.sum("rows")).collect()
    return folder


_TWO_KINDS = "CASE WHEN _filter_kind = 'psc' THEN 'psc' ELSE 'naics' END"


@query(f"SELECT raw_row_id, recipient_name_raw, {_TWO_KINDS} AS tag FROM awards_raw")
def s1_zipped_csv(spark, sf):
    """Archives of two pulls, told apart by their names, one without a column that the other has."""
    raw = table(spark, sf, "awards_raw").select("raw_row_id", F.regexp_replace("recipient_name_raw", "^$", " ").alias("recipient_name_raw"), "_filter_kind", "batch_id")
    folder = fresh(spark, "pulls")
    psc = F.coalesce(F.col("_filter_kind") == "psc", F.lit(False))
    zipped(raw.where(psc).drop("_filter_kind"), folder, "psc", 3)
    zipped(raw.where(~psc).drop("_filter_kind", "batch_id"), folder, "naics", 2)
    return readers.zipped_csv(spark, folder, ["raw_row_id", "recipient_name_raw", "batch_id"], r"pull_([a-z]+)_").select(F.col("raw_row_id").cast("bigint").alias("raw_row_id"), "recipient_name_raw", "tag")


@query("SELECT CAST(count(*) > 0 AS BOOLEAN) AS any_file, true AS all_archives, false AS any_html, true AS digests FROM awards_raw")
def s10_landed_files(spark, sf):
    """Whether landed archives begin as archives do, and have a digest."""
    folder = zipped(table(spark, sf, "awards_raw").select("raw_row_id"), fresh(spark, "pulls"), "all", 4)
    f = readers.landed(spark, folder)
    return f.agg((F.count("*") > 0).alias("any_file"), F.min("is_kind").alias("all_archives"), F.max("looks_html").alias("any_html"), F.min(F.length("sha256") == 64).alias("digests"))


@query("SELECT subaward_number, prime_awardee_uei, subaward_description, CASE WHEN subaward_amount >= 100000 THEN 'large' ELSE 'other' END AS pull FROM subaward_report")
def s2_routed_csv(spark, sf):
    """CSV files of two pulls with headers and line breaks in quotes, told apart by where they lie."""
    subs = table(spark, sf, "subaward_report")
    place = fresh(spark, "csv")
    large = F.coalesce(F.col("subaward_amount") >= 100_000, F.lit(False))
    for kind, rows in (("large", large), ("other", ~large)):
        subs.where(rows).select("subaward_number", "prime_awardee_uei", "subaward_description").write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{place}/{kind}")
    return readers.routed(spark, {k: f"{place}/{k}" for k in ("large", "other")}, "subaward_number string, prime_awardee_uei string, subaward_description string", "pull")


@query("SELECT c_custkey, trim(c_name) AS c_name, c_nationkey FROM customer")
def s3_fixed_width(spark, sf):
    """Records of fixed columns, blank lines between them."""
    c = table(spark, sf, "customer").select("c_custkey", F.trim("c_name").alias("c_name"), "c_nationkey")
    lines = c.select(F.explode(F.array(F.concat(F.rpad(F.col("c_custkey").cast("string"), 12, " "), F.rpad("c_name", 40, " "), F.lpad(F.col("c_nationkey").cast("string"), 4, " ")), F.lit("   "))))
    place = fresh(spark, "fixed")
    lines.write.text(place)
    f = readers.fixed_width(spark, place, {"c_custkey": (1, 12), "c_name": (13, 40), "c_nationkey": (53, 4)})
    return f.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"))


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%d-') || upper(strftime(o_orderdate, '%b')) || strftime(o_orderdate, '-%Y') AS said, o_orderdate::DATE AS day, strftime(o_orderdate, '%m-%d') = '01-01' AS new_year FROM orders")
def s4_headerless(spark, sf):
    """Headerless CSV of a fixed number of fields, with days as DD-MON-YYYY read strictly, and the tell of an imputed day."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("said"))
    place = fresh(spark, "plain")
    o.write.csv(place)
    d = readers.delimited(spark, place, ["o_orderkey", "o_custkey", "said"])
    title = F.concat(F.substring("said", 1, 4), F.lower(F.substring("said", 5, 2)), F.substring("said", 7, 5))
    return d.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), "said", v.strict_day(title).alias("day"), v.new_year_tell(F.col("said")).alias("new_year"))


@query("SELECT n_nationkey, n_name, n_regionkey, 0 AS absent FROM nation")
def s5_optional_tables(spark, sf):
    """A table that is there, and one that isn't, which counts as empty."""
    place = fresh(spark, "nations")
    table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.parquet(place)
    here = conform.optional_table(spark, place, "n_nationkey bigint, n_name string, n_regionkey bigint")
    gone = conform.optional_table(spark, place + "-not", "n_nationkey bigint")
    return here.withColumn("absent", gone.agg(F.count("*").cast("int").alias("n")).scalar())


@query("SELECT r_name, count(*) AS nations, 'none' AS missing FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def s6_json_document(spark, sf):
    """A document for each region with its nations, and a default where there is no document."""
    doc = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list("n_name").alias("nations"))
    place = fresh(spark, "documents")
    doc.repartition(4, "r_name").write.json(place)
    kind = "r_name string, nations array<string>"
    default = readers.json_document(spark, place + "-not", kind, default='{"r_name": "none", "nations": []}', lines=True)
    return readers.json_document(spark, place, kind, lines=True).select("r_name", F.size("nations").cast("bigint").alias("nations"), default.select("r_name").scalar().alias("missing"))


@query(
    "SELECT CAST(floor(value / 50) AS INTEGER) AS bucket, count(*) AS exposure, count(*) FILTER (WHERE event_type = 'error') AS failures, (count(*) FILTER (WHERE event_type = 'error')) / count(*) AS daily, 1 - pow(1 - (count(*) FILTER (WHERE event_type = 'error')) / count(*), 365.25) AS yearly FROM events WHERE value IS NOT NULL GROUP BY 1"
)
def s7_snapshots(spark, sf):
    """Snapshots by month with a header, whose columns stand in another order in some; their hazard."""
    e = table(spark, sf, "events").select("event_type", "value", F.date_format("ts", "yyyyMM").alias("month"))
    place = fresh(spark, "snapshots")
    odd = F.col("month").substr(6, 1).cast("int") % 2 == 1
    e.where(odd).drop("month").write.option("header", True).csv(place + "/a")
    e.where(~F.coalesce(odd, F.lit(False))).select("value", "event_type").write.option("header", True).csv(place + "/b")
    rows = readers.snapshots(spark, f"{place}/*/*.csv", ["event_type", "value"], ["event_type", "value"]).withColumn("value", F.col("value").cast("double"))
    return curves.hazard(rows, F.floor(F.col("value") / 50).cast("int"), F.lit(1).cast("bigint"), (F.col("event_type") == "error").cast("bigint"))


_YEARS = "CAST(year(o_orderdate) AS VARCHAR) || '-01-01' AS start, CAST(year(o_orderdate) AS VARCHAR) || '-12-31' AS \"end\""


@query(
    f"""WITH y AS (SELECT {_YEARS}, CAST(sum(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS b FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2)
SELECT *, b / nullif(a, 0) AS ratio FROM y ORDER BY "end" DESC LIMIT 4"""
)
def s8_annual_facts(spark, sf):
    """A filing of yearly totals, some restated later, and the ratio of two series over the newest years that both have."""
    year = F.year("o_orderdate").cast("string")
    o = table(spark, sf, "orders").where("o_orderdate is not null").groupBy(year.alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(28,2)")).cast("double").alias("a"), F.count("*").cast("double").alias("b"))
    fact = lambda c, filed: F.struct(F.concat("y", F.lit("-01-01")).alias("start"), F.concat("y", F.lit("-12-31")).alias("end"), c.alias("val"), F.lit("10-K").alias("form"), F.lit("FY").alias("fp"), F.lit(filed).alias("filed"))
    series = lambda *facts: F.struct(F.struct(F.flatten(F.collect_list(F.array(*facts))).alias("USD")).alias("units"))
    doc = o.agg(F.to_json(F.struct(F.struct(F.struct(series(fact(F.col("a") + 1, "2001-01-01"), fact(F.col("a"), "2009-01-01")).alias("Total"), series(fact(F.col("b"), "2005-01-01")).alias("Count")).alias("us-gaap")).alias("facts"))).alias("j"))
    return readers.period_ratio(readers.annual_facts(doc, "j", "Total"), readers.annual_facts(doc, "j", "Count"), 4)


@query("SELECT contract_award_unique_key, CAST(floor(award_amount) AS DOUBLE) AS backlog FROM contracts WHERE award_amount >= 0")
def s9_narrative_figures(spark, sf):
    """Figures found in pages, tags and odd blanks aside."""
    c = table(spark, sf, "contracts").where("award_amount >= 0")
    page = F.concat(F.lit("<html><p>Our backlog&nbsp;was <b>$"), F.format_number(F.floor("award_amount"), 0), F.lit("</b>\n at year's end.</p>"))
    return c.select("contract_award_unique_key", *readers.narrative_figures(page, {"backlog": r"backlog was \$([\d,]+) at"}))


# sinks


@query("SELECT account_id, count(*) AS n, false AS again FROM contracts WHERE account_id IS NOT NULL GROUP BY 1")
def k1_written_once(spark, sf):
    """A table that is written, left alone when it is there, and read back."""
    place = fresh(spark, "accounts")
    n = table(spark, sf, "contracts").where("account_id is not null").groupBy("account_id").agg(F.count("*").alias("n"))
    sinks.write_parquet(n, place)
    again = sinks.write_parquet(n.limit(0), place, force=False)
    return spark.read.parquet(place).withColumn("again", F.lit(again))


@query("SELECT contract_award_unique_key, psc_role, award_fy FROM contracts")
def k2_csv_and_back(spark, sf):
    place = fresh(spark, "csv")
    sinks.write_csv(table(spark, sf, "contracts").select("contract_award_unique_key", "psc_role", "award_fy"), place)
    return readers.headed_csv(spark, place, "contract_award_unique_key string, psc_role string, award_fy int")


@query("SELECT (SELECT count(*) FROM contracts) AS total, 25 AS shown, (SELECT count(*) FROM contracts) > 25 AS capped, (SELECT max(contract_award_unique_key) FROM contracts) AS first_key, true AS read_back")
def t5_report_of_a_section(spark, sf):
    """A section with its cap told, written as a report and read back."""
    s = sinks.section(table(spark, sf, "contracts").select("contract_award_unique_key", "award_amount", "end_date"), [F.desc("contract_award_unique_key")], 25)
    place = fresh(spark, "report") + "/r.json"
    sinks.write_report(spark.range(0), {"awards": s, "nothing": float("nan")}, place)
    kind = "awards struct<total: bigint, capped: boolean, rows: array<struct<contract_award_unique_key: string>>>, nothing double"
    r = readers.json_document(spark, place, kind)
    return r.select("awards.total", F.size("awards.rows").alias("shown"), "awards.capped", F.element_at("awards.rows", 1)["contract_award_unique_key"].alias("first_key"), F.col("nothing").isNull().alias("read_back"))


@query("SELECT count(*) AS rows, 19 AS columns, true AS same FROM contracts")
def k9_manifest(spark, sf):
    """Two orders of one table have the same checksum."""
    c = table(spark, sf, "contracts")
    a, b = sinks.manifest(c), sinks.manifest(c.repartition(7, "account_id"))
    return a.select("rows", "columns", (F.col("checksum") == b.select("checksum").scalar()).alias("same"))


@query("SELECT contract_award_unique_key, CASE WHEN award_amount IS NULL THEN 'n/a' ELSE CASE WHEN award_amount < 0 THEN '-' ELSE '' END || '$' || format('{:,}', CAST(round_even(abs(award_amount), 0) AS BIGINT)) END AS shown FROM contracts")
def f5_dollars(spark, sf):
    return table(spark, sf, "contracts").select("contract_award_unique_key", F.coalesce(v.dollars(F.col("award_amount")), F.lit("n/a")).alias("shown"))


@query("SELECT account_id, md5(account_id) AS m, sha256(account_id) AS s FROM (SELECT DISTINCT account_id FROM contracts WHERE account_id IS NOT NULL)")
def f10_digests(spark, sf):
    return table(spark, sf, "contracts").where("account_id is not null").select("account_id").distinct().select("account_id", F.md5("account_id").alias("m"), F.sha2("account_id", 256).alias("s"))


@query("SELECT (SELECT count(*) FROM contracts) AS contracts, (SELECT count(*) FROM contracts WHERE account_id IS NOT NULL) AS kept, 'broken' AS failed")
def o1_steps(spark, sf):
    """Steps over a shared state: one that isn't critical fails, one is skipped, the others hand their tables on."""

    def broken(_):
        raise RuntimeError("a step that may fail")

    steps = [governance.Step("contracts", lambda s: table(spark, sf, "contracts")), governance.Step("broken", broken, critical=False), governance.Step("kept", lambda s: s["contracts"].where("account_id is not null")), governance.Step("never", broken)]
    p = governance.Pipeline(steps)
    state = p.run({}, skip=("never",))
    n = lambda name: state[name].agg(F.count("*").alias("n")).scalar().alias(name)
    return spark.range(1).select(n("contracts"), n("kept"), F.lit(";".join(p.failed)).alias("failed"))


@query(
    "SELECT id, CASE WHEN id = 'R-8' THEN CAST((SELECT arg_max(award_fy, contract_award_unique_key) FROM contracts WHERE award_fy IS NOT NULL) AS DOUBLE) ELSE value END AS value FROM (VALUES "
    + ", ".join(f"('{a}', {c}::DOUBLE)" for a, _, c, _, _ in governance.ASSUMPTIONS)
    + ") x(id, value)"
)
def o3_anchored(spark, sf):
    """An assumption that is taken from data where there are any."""
    return governance.anchored(governance.assumptions(spark), "R-8", table(spark, sf, "contracts"), "award_fy", "contract_award_unique_key", "newest award").select("id", "value")
