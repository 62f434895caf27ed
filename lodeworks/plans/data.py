"""Queries over the problem tables, with the parameters they run with in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.columns import day_number, day_text
from lodeworks.operators import asof, features, intervals, sessions, tree
from lodeworks.params import DEFAULT
from lodeworks.streaming import deliveries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# 1. attributes as known at event time


def _known(spark: SparkSession, sf: str, attributes: list[str], events: list[str]) -> DataFrame:
    contracts = table(spark, sf, "contracts").select("contract_award_unique_key", "account_id", "base_obligation_date", *events)
    return asof.known_at(contracts, table(spark, sf, "account_versions"), "account_id", "base_obligation_date", "effective_from", "recorded_at", "version_id", attributes, prefix="known_")


_P1 = """
WITH v AS (SELECT DISTINCT * FROM account_versions WHERE effective_from IS NOT NULL AND recorded_at IS NOT NULL),
m AS (SELECT c.contract_award_unique_key, v.*, row_number() OVER (PARTITION BY c.contract_award_unique_key
        ORDER BY v.effective_from DESC, v.recorded_at DESC, v.version_id DESC) AS rn
      FROM contracts c JOIN v ON c.account_id = v.account_id
       AND v.effective_from <= c.base_obligation_date AND v.recorded_at <= c.base_obligation_date)
"""


@query(_P1 + "SELECT contract_award_unique_key, version_id FROM m WHERE rn = 1")
def p1_found(spark, sf):
    return _known(spark, sf, ["version_id"], []).where("known_version_id is not null").select("contract_award_unique_key", F.col("known_version_id").alias("version_id"))


@query(
    _P1
    + """SELECT c.contract_award_unique_key, c.segment AS segment_today, m.segment AS segment_known, c.region AS region_today,
       m.region AS region_known, m.size_band AS size_band_known
FROM contracts c LEFT JOIN m ON m.contract_award_unique_key = c.contract_award_unique_key AND m.rn = 1"""
)
def p1_known_attributes(spark, sf):
    df = _known(spark, sf, ["segment", "region", "size_band"], ["segment", "region"])
    return df.select("contract_award_unique_key", F.col("segment").alias("segment_today"), F.col("known_segment").alias("segment_known"), F.col("region").alias("region_today"), F.col("known_region").alias("region_known"), F.col("known_size_band").alias("size_band_known"))


# 2. messages delivered more than once

_P2 = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY upper(trim(contract_award_unique_key))
             ORDER BY last_modified_date DESC NULLS LAST, raw_row_id) AS rn,
           coalesce(trim(contract_award_unique_key), '') = '' AS keyless FROM awards_raw)
"""
_DELIVERED = dict(key="contract_award_unique_key", rank="last_modified_date", row_id="raw_row_id", event_time="landed_at")


#: Days by which deliveries have landed: what came between two of them is one micro-batch, so that state expires in between.
_LANDINGS = ("2022-01-01", "2023-07-01", "2025-01-01")
_LANDING = " + ".join(f"CAST(coalesce(landed_at >= TIMESTAMP '{d}', false) AS INTEGER)" for d in _LANDINGS)


def _landed(spark: SparkSession, sf: str) -> deliveries.DeliveryStore:
    raw = table(spark, sf, "awards_raw")
    since = [F.coalesce(F.col("landed_at") >= F.lit(d).cast("timestamp_ntz"), F.lit(False)).cast("int") for d in _LANDINGS]
    return deliveries.landed_in_order(raw, since[0] + since[1] + since[2], **_DELIVERED)


@query(_P2 + "SELECT raw_row_id FROM r WHERE NOT keyless AND rn > 1")
def p2_found(spark, sf):
    return _landed(spark, sf).surplus()


@query(
    f"""WITH r AS (SELECT upper(trim(contract_award_unique_key)) AS k, {_LANDING} AS g FROM awards_raw WHERE coalesce(trim(contract_award_unique_key), '') <> ''),
d AS (SELECT DISTINCT k, g FROM r), s AS (SELECT DISTINCT g FROM r), o AS (SELECT g, CAST(row_number() OVER (ORDER BY g) - 1 AS INTEGER) AS batch FROM s),
e AS (SELECT k, batch FROM d JOIN o USING (g)), p AS (SELECT *, max(batch) OVER (PARTITION BY k ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT batch, count(*) AS keys, count(*) FILTER (WHERE before < batch - 1) AS late FROM p GROUP BY 1"""
)
def p2_late_keys(spark, sf):
    """Keys of each landing, and how many of them had expired and were found in the archive."""
    return _landed(spark, sf).trace()


@query(_P2 + "SELECT raw_row_id, contract_award_unique_key, last_modified_date, batch_id FROM r WHERE keyless OR rn = 1")
def p2_kept(spark, sf):
    return deliveries.kept_deliveries(spark, f"{sf}/awards_raw.parquet", **_DELIVERED).select("raw_row_id", "contract_award_unique_key", "last_modified_date", "batch_id")


# 3. per-entity feature table

_EVENT = ("account_id", "psc_code", "base_obligation_date", "award_amount")


def _p3_sql(where: str) -> str:
    return f"""
WITH c AS (SELECT account_id AS entity, nullif(upper(trim(psc_code)), '') AS type, base_obligation_date AS t,
             CAST(award_amount AS DECIMAL(28,6)) AS x FROM contracts WHERE account_id IS NOT NULL AND ({where})),
g AS (SELECT entity, type, count(*) AS n, date_diff('day', max(t)::DATE, DATE '{DEFAULT.as_of}') AS d,
        CAST(coalesce(sum(x), 0) AS DOUBLE) AS x FROM c GROUP BY 1, 2)
SELECT entity AS account_id, CAST(sum(n) AS BIGINT) AS events,
  coalesce(list(type ORDER BY type) FILTER (WHERE type IS NOT NULL), []) AS types,
  coalesce(list(n ORDER BY type) FILTER (WHERE type IS NOT NULL), []) AS counts,
  coalesce(list(CAST(d AS INTEGER) ORDER BY type) FILTER (WHERE type IS NOT NULL), []) AS days_since,
  coalesce(list(x ORDER BY type) FILTER (WHERE type IS NOT NULL), []) AS totals
FROM g GROUP BY 1"""


def _rows(features_table: DataFrame) -> DataFrame:
    return features.per_entity(features_table, day_number(F.lit(str(DEFAULT.as_of)))).withColumnRenamed("entity", "account_id")


@query(_p3_sql("true"))
def p3_features(spark, sf):
    return _rows(features.built(features.changes(table(spark, sf, "contracts"), *_EVENT)))


@query(_p3_sql("NOT coalesce(end_date < start_date, false)"))
def p3_after_retraction(spark, sf):
    """The table of all awards, after those with reversed periods are retracted."""
    contracts = table(spark, sf, "contracts")
    wrong = F.coalesce(F.col("end_date") < F.col("start_date"), F.lit(False))
    before = features.built(features.changes(contracts, *_EVENT))
    return _rows(features.maintained(before, features.changes(contracts.where(wrong), *_EVENT, sign=-1), features.changes(contracts.where(~wrong), *_EVENT)))


# 4. sessions

_P4 = f"""
WITH d AS (SELECT account_id, base_obligation_date::DATE AS d, count(*) AS n FROM contracts
           WHERE account_id IS NOT NULL AND base_obligation_date IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {DEFAULT.session_gap_days} THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY d) AS s
      FROM (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY account_id ORDER BY d), d) AS gap FROM d)),
g AS (SELECT account_id, s, min(d) AS a, max(d) AS b, sum(n) AS n FROM s GROUP BY 1, 2)
"""


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions.sessions(table(spark, sf, "contracts"), "account_id", "base_obligation_date", DEFAULT.session_gap_days)
    return s.select(F.col("entity").alias("account_id"), day_text(F.col("first_day")).alias("session_start"), day_text(F.col("last_day")).alias("session_end"), "days", "events")


@query(_P4 + "SELECT account_id, strftime(a, '%Y-%m-%d') AS session_start, strftime(b, '%Y-%m-%d') AS session_end FROM g")
def p4_found(spark, sf):
    return _sessions(spark, sf).select("account_id", "session_start", "session_end")


@query(_P4 + "SELECT account_id, strftime(a, '%Y-%m-%d') AS session_start, strftime(b, '%Y-%m-%d') AS session_end, CAST(date_diff('day', a, b) + 1 AS INTEGER) AS days, CAST(n AS BIGINT) AS awards FROM g")
def p4_sessions(spark, sf):
    return _sessions(spark, sf).withColumnRenamed("events", "awards")


# 6. a few keys holding most records

_P6 = """
WITH u AS (SELECT 'account_id' AS field_name, account_id AS key_value, award_amount AS x, base_obligation_date AS t FROM contracts
           UNION ALL SELECT 'recipient_entity_id', recipient_entity_id, award_amount, base_obligation_date FROM contracts),
g AS (SELECT field_name, key_value, count(*) AS n, CAST(coalesce(sum(CAST(x AS DECIMAL(28,6))), 0) AS DOUBLE) AS total,
        strftime(min(t), '%Y-%m-%d') AS first_day, strftime(max(t), '%Y-%m-%d') AS last_day FROM u GROUP BY 1, 2)
"""


def _totals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    contracts = table(spark, sf, "contracts")
    return tree.key_totals(contracts, ["account_id", "recipient_entity_id"], "award_amount", "base_obligation_date"), contracts


@query(_P6 + f"SELECT field_name, key_value FROM g WHERE key_value IS NOT NULL AND n > {DEFAULT.hot_share} * (SELECT count(*) FROM contracts)")
def p6_found(spark, sf):
    return tree.heavy_keys(*_totals(spark, sf), share=DEFAULT.hot_share)


def _days(totals: DataFrame) -> DataFrame:
    return totals.select("field_name", "key_value", "n", "total", F.date_format("first_at", "yyyy-MM-dd").alias("first_day"), F.date_format("last_at", "yyyy-MM-dd").alias("last_day"))


@query(_P6 + "SELECT * FROM g")
def p6_key_totals(spark, sf):
    return _days(_totals(spark, sf)[0])


@query(_P6 + "SELECT * FROM g")
def p6_deep_tree(spark, sf):
    """The same totals over a tree that merges two by two in five rounds, with chunks of no more than what one of 32 nodes takes."""
    contracts = table(spark, sf, "contracts").repartition(32)
    return _days(tree.key_totals(contracts, ["account_id", "recipient_entity_id"], "award_amount", "base_obligation_date", fan_in=2, rounds=5))


# 7. overlapping and gapped intervals


@query(
    """
WITH i AS (SELECT account_id, start_date::DATE AS s, end_date::DATE AS e FROM contracts
           WHERE account_id IS NOT NULL AND start_date IS NOT NULL AND end_date IS NOT NULL AND end_date::DATE >= start_date::DATE),
o AS (SELECT *, max(e) OVER (PARTITION BY account_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i),
n AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS p FROM o),
g AS (SELECT account_id, p, min(s) AS s, max(e) AS e FROM n GROUP BY 1, 2),
l AS (SELECT *, lead(s) OVER (PARTITION BY account_id ORDER BY s) AS nx FROM g)
SELECT account_id, 'period' AS kind, strftime(s, '%Y-%m-%d') AS day_from, strftime(e, '%Y-%m-%d') AS day_to FROM l
UNION ALL SELECT account_id, 'gap', strftime(e + 1, '%Y-%m-%d'), strftime(nx - 1, '%Y-%m-%d') FROM l WHERE nx IS NOT NULL"""
)
def p7_found(spark, sf):
    p = intervals.periods_and_gaps(table(spark, sf, "contracts"), "account_id", "start_date", "end_date")
    return p.select(F.col("entity").alias("account_id"), "kind", day_text(F.col("day_from")).alias("day_from"), day_text(F.col("day_to")).alias("day_to"))
