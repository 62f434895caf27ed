"""One named query for each kind of operator that the engine has, with an SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import names as fn
from lodeworks.functions import values as v
from lodeworks.functions.columns import exact_sum, tidy_key
from lodeworks.operators import accounts, conform, coverage, curves, episodes, flows, generate, metrics, ordered, resolve, rules, survival
from lodeworks.params import DEFAULT as P
from lodeworks.plans import governance
from lodeworks.sources import readers, sinks
from lodeworks.sources.shared import settle

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


AS_OF = f"DATE '{P.as_of}'"
DEC = "CAST(award_amount AS DECIMAL(28,6))"
HARD, KEPT = "('hardware_core', 'hardware_adjacent')", "psc_role = 'maintenance'"


def hardware():
    return F.col("psc_role").isin("hardware_core", "hardware_adjacent")


def maintained():
    return F.col("psc_role") == "maintenance"


# unions, keep-latest, profiles

_KEY = "upper(trim(contract_award_unique_key))"


def _primes(spark, sf):
    raw = table(spark, sf, "awards_raw").withColumn("key", tidy_key(F.col("contract_award_unique_key")))
    return conform.keep_latest(raw, F.col("key"), "last_modified_date", "raw_row_id")


_PRIMES = f"""primes AS (SELECT * FROM (SELECT *, {_KEY} AS key, row_number() OVER (PARTITION BY {_KEY} ORDER BY last_modified_date DESC NULLS LAST, raw_row_id) AS rn
  FROM awards_raw WHERE coalesce(trim(contract_award_unique_key), '') <> '') WHERE rn = 1)"""


@query(f"WITH {_PRIMES} SELECT key, raw_row_id, total_obligated_amount, last_modified_date FROM primes")
def w1_keep_latest(spark, sf):
    return _primes(spark, sf).select("key", "raw_row_id", "total_obligated_amount", "last_modified_date")


@query(f"SELECT {_KEY} AS key, string_agg(DISTINCT _filter_kind, ';' ORDER BY _filter_kind) AS filters, count(*) AS deliveries FROM awards_raw WHERE coalesce(trim(contract_award_unique_key), '') <> '' GROUP BY 1")
def a3_matched_filters(spark, sf):
    raw = table(spark, sf, "awards_raw").withColumn("key", tidy_key(F.col("contract_award_unique_key"))).where("key is not null")
    return raw.groupBy("key").agg(v.string_set(F.col("_filter_kind")).alias("filters"), F.count("*").alias("deliveries"))


_PSC = "(upper(trim(product_or_service_code)) LIKE '9%')"
_NAICS = "(naics_code IN ('541512', '518210'))"
_IN = f"award_base_action_date::DATE BETWEEN DATE '2020-10-01' AND DATE '2023-09-30'"


@query(
    f"""SELECT pull, count(*) AS n, count(DISTINCT raw_row_id) AS awards FROM (
  SELECT 'psc' AS pull, raw_row_id FROM awards_raw WHERE {_IN} AND {_PSC}
  UNION ALL SELECT 'naics', raw_row_id FROM awards_raw WHERE {_IN} AND {_NAICS}) GROUP BY 1"""
)
def s11_union_of_pulls(spark, sf):
    window = readers.pull_windows(2021, 2023, 3, date(2010, 1, 1), date(2030, 1, 1))[0]
    filters = {"psc": F.upper(F.trim("product_or_service_code")).startswith("9"), "naics": F.col("naics_code").isin("541512", "518210")}
    return readers.pulled(table(spark, sf, "awards_raw"), "award_base_action_date", filters, window, "pull").groupBy("pull").agg(F.count("*").alias("n"), F.countDistinct("raw_row_id").alias("awards"))


_MISSING = ["account_id", "recipient_uei", "award_amount", "start_date", "end_date", "base_obligation_date", "psc_code", "extent_competed", "number_of_offers_received"]


@query("UNION ALL ".join(f"SELECT award_fy, grouping(award_fy) = 1 AS overall, '{c}' AS column_name, count(*) AS rows, avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS null_rate FROM contracts GROUP BY ROLLUP(award_fy) " for c in _MISSING))
def a5_missingness(spark, sf):
    return conform.missingness(table(spark, sf, "contracts"), _MISSING, "award_fy")


@query("SELECT extent_competed AS value, count(*) AS n FROM contracts GROUP BY 1")
def a6_value_counts(spark, sf):
    return conform.value_counts(table(spark, sf, "contracts"), "extent_competed")


@query("SELECT sub_agency AS value, count(*) AS n FROM contracts WHERE sub_agency IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def a6_top_values(spark, sf):
    return conform.value_counts(table(spark, sf, "contracts"), "sub_agency", keep_null=False, top=10)


@query(f"SELECT count(*) AS rows, count(DISTINCT account_id) AS accounts, count(DISTINCT recipient_entity_id) AS entities, min(base_obligation_date) AS first_at, max(base_obligation_date) AS last_at, CAST(sum({DEC}) AS DOUBLE) AS total FROM contracts")
def a7_profile(spark, sf):
    return table(spark, sf, "contracts").agg(F.count("*").alias("rows"), F.countDistinct("account_id").alias("accounts"), F.countDistinct("recipient_entity_id").alias("entities"), F.min("base_obligation_date").alias("first_at"), F.max("base_obligation_date").alias("last_at"), exact_sum(F.col("award_amount")).alias("total"))


@query("SELECT award_id_piid, count(*) AS n FROM awards_raw GROUP BY 1 HAVING count(*) > 1")
def a39_duplicates(spark, sf):
    return conform.duplicates(table(spark, sf, "awards_raw"), ["award_id_piid"])


@query("SELECT median(number_of_offers_received) AS med, quantile_cont(number_of_offers_received, 0.1) AS p10, quantile_cont(award_amount, 0.25) AS q1, quantile_cont(award_amount, 0.75) AS q3, quantile_cont(award_amount, 0.9) AS p90 FROM contracts")
def a8_quantiles(spark, sf):
    wanted = {"med": ("number_of_offers_received", 0.5), "p10": ("number_of_offers_received", 0.1), "q1": ("award_amount", 0.25), "q3": ("award_amount", 0.75), "p90": ("award_amount", 0.9)}
    return conform.quantiles(table(spark, sf, "contracts"), wanted)


# projections

_DAY = "coalesce(try_strptime(trim(subaward_action_date), '%Y-%m-%d'), try_strptime(trim(subaward_action_date), '%m/%d/%Y'), try_strptime(trim(subaward_action_date), '%Y-%m-%d %H:%M:%S'))::DATE"


@query(f"SELECT subaward_number, subaward_amount, {_DAY} AS day, {_DAY} IS NULL AS undated FROM subaward_report")
def typed_subawards(spark, sf):
    day = v.to_day(F.col("subaward_action_date"))
    return table(spark, sf, "subaward_report").select("subaward_number", "subaward_amount", day.alias("day"), day.isNull().alias("undated"))


@query("SELECT manufacturer_of_goods AS raw, CASE WHEN upper(trim(manufacturer_of_goods)) IN ('T','TRUE','Y','YES','1') THEN true WHEN upper(trim(manufacturer_of_goods)) IN ('F','FALSE','N','NO','0') THEN false END AS flag, count(*) AS n FROM awards_raw GROUP BY 1, 2")
def truthy_flags(spark, sf):
    return table(spark, sf, "awards_raw").groupBy(F.col("manufacturer_of_goods").alias("raw"), v.truthy(F.col("manufacturer_of_goods")).alias("flag")).agg(F.count("*").alias("n"))


_EVENT_DAY = "coalesce(base_obligation_date, start_date)::DATE"


@query(
    f"""SELECT contract_award_unique_key, {_EVENT_DAY} AS event_day, CAST(year({_EVENT_DAY} + INTERVAL 3 MONTH) AS INTEGER) AS fy,
  CAST(date_diff('day', start_date::DATE, end_date::DATE) AS INTEGER) AS pop_days, CAST(date_diff('day', {AS_OF}, end_date::DATE) AS INTEGER) AS days_to_expiry,
  coalesce(date_diff('day', {AS_OF}, end_date::DATE) BETWEEN 0 AND {P.renewal_lookahead_days}, false) AS expiring,
  CASE WHEN award_amount IS NOT NULL THEN least(greatest(award_amount, 0.0), 1e6) END AS clipped,
  award_amount / nullif(number_of_offers_received, 0) AS per_offer, coalesce(account_id, 'SA-' || coalesce(sub_agency, 'UNK')) AS account
FROM contracts"""
)
def derived_columns(spark, sf):
    c = table(spark, sf, "contracts")
    day = F.to_date(F.coalesce("base_obligation_date", "start_date"))
    left = v.days_between(F.lit(str(P.as_of)).cast("timestamp_ntz"), F.col("end_date"))
    return c.select("contract_award_unique_key", day.alias("event_day"), v.fiscal_year(day).alias("fy"), v.days_between(F.col("start_date"), F.col("end_date")).alias("pop_days"), left.alias("days_to_expiry"), F.coalesce(left.between(0, P.renewal_lookahead_days), F.lit(False)).alias("expiring"), v.clip(F.col("award_amount"), 0.0, 1e6).alias("clipped"), v.ratio(F.col("award_amount"), F.col("number_of_offers_received")).alias("per_offer"), F.coalesce("account_id", F.concat(F.lit("SA-"), F.coalesce("sub_agency", F.lit("UNK")))).alias("account"))


_FAMILY = {"9": "goods", "7": "goods", "M": "operations", "Z": "works", "Y": "works", "R": "support", "D": "information"}


@query("SELECT contract_award_unique_key, coalesce(CASE upper(trim(psc_code))[1] " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in _FAMILY.items()) + " END, CASE WHEN psc_role <> 'out_of_scope' THEN 'other' ELSE 'out' END) AS family, upper(trim(psc_code))[1] IN ('9','7') AS is_goods FROM contracts")
def lookup_with_fallback(spark, sf):
    first = F.substring(F.upper(F.trim("psc_code")), 1, 1)
    return table(spark, sf, "contracts").select("contract_award_unique_key", F.coalesce(v.lookup(first, _FAMILY), F.when(F.col("psc_role") != "out_of_scope", "other").otherwise("out")).alias("family"), first.isin("9", "7").alias("is_goods"))


_BOTH = "count(DISTINCT _filter_kind) FILTER (WHERE _filter_kind IN ('psc', 'naics')) = 2"


@query(f"SELECT {_KEY} AS key, {_BOTH} AS matched_both FROM awards_raw WHERE coalesce(trim(contract_award_unique_key), '') <> '' GROUP BY 1")
def matched_both_pulls(spark, sf):
    joined = a3_matched_filters(spark, sf)
    return joined.select("key", (F.col("filters").contains("psc") & F.col("filters").contains("naics")).alias("matched_both"))


_MEDIAN = "(SELECT median(number_of_offers_received) FROM contracts)"


@query(
    f"""SELECT contract_award_unique_key, coalesce(CASE WHEN channel <> 'unknown' THEN channel END, CASE WHEN upper(trim(psc_code)) LIKE '9%' THEN 'direct' END, 'unknown') AS channel,
  CASE WHEN channel <> 'unknown' THEN 'label' WHEN upper(trim(psc_code)) LIKE '9%' THEN 'rule' ELSE 'none' END AS channel_source,
  coalesce(sub_agency ILIKE '%fleet%' OR sub_agency ILIKE '%range%', false) AS by_name, CASE WHEN award_amount IS NULL THEN 'unknown' WHEN award_amount < 10000 THEN 'small' ELSE 'large' END AS stratum,
  ln(1 + coalesce(number_of_offers_received, {_MEDIAN})) AS log_offers, CAST(number_of_offers_received IS NULL AS INTEGER) AS imputed FROM contracts"""
)
def merged_and_imputed(spark, sf):
    """Merges by priority with the source they came from, name tests, strata with an explicit unknown, imputed logarithms."""
    c = table(spark, sf, "contracts")
    label, rule = F.when(F.col("channel") != "unknown", F.col("channel")), F.when(F.upper(F.trim("psc_code")).startswith("9"), F.lit("direct"))
    offers = F.coalesce("number_of_offers_received", c.agg(F.median("number_of_offers_received").alias("m")).scalar())
    return c.select(
        "contract_award_unique_key",
        F.coalesce(label, rule, F.lit("unknown")).alias("channel"),
        F.when(label.isNotNull(), "label").when(rule.isNotNull(), "rule").otherwise("none").alias("channel_source"),
        F.coalesce(F.col("sub_agency").ilike("%fleet%") | F.col("sub_agency").ilike("%range%"), F.lit(False)).alias("by_name"),
        F.when(F.col("award_amount").isNull(), "unknown").when(F.col("award_amount") < 10_000, "small").otherwise("large").alias("stratum"),
        F.log1p(offers).alias("log_offers"),
        F.col("number_of_offers_received").isNull().cast("int").alias("imputed"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def f8_json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


# accounts


@query(
    f"""
WITH c AS (SELECT * FROM contracts WHERE account_id IS NOT NULL),
md AS (SELECT account_id, {", ".join(f"(SELECT x.{m} FROM (SELECT {m}, count(*) AS n FROM contracts i WHERE i.account_id = o.account_id AND {m} IS NOT NULL GROUP BY 1) x ORDER BY x.n DESC, x.{m} LIMIT 1) AS {m}" for m in ("sub_agency", "segment", "region"))} FROM (SELECT DISTINCT account_id FROM c) o),
g AS (SELECT account_id, min(base_obligation_date)::DATE AS first_day, max(base_obligation_date)::DATE AS last_day, count(*) AS awards, CAST(coalesce(sum({DEC}), 0) AS DOUBLE) AS total,
  count(DISTINCT recipient_entity_id) AS vendors, count(DISTINCT psc_code) AS codes, CAST(coalesce(sum({DEC}) FILTER (WHERE psc_role IN {HARD}), 0) AS DOUBLE) AS hardware_total,
  CAST(coalesce(sum({DEC}) FILTER (WHERE {KEPT}), 0) AS DOUBLE) AS maintenance_total FROM c GROUP BY 1)
SELECT g.*, md.sub_agency, md.segment, md.region, round_even(date_diff('day', last_day, {AS_OF}) / {P.month_days}, 1) AS months_idle,
  round_even(date_diff('day', last_day, {AS_OF}) / {P.month_days}, 1) >= 24 AS dormant, round_even(date_diff('day', first_day, last_day) / {P.year_days}, 2) AS tenure_years, total / awards AS mean_amount
FROM g JOIN md USING (account_id)"""
)
def a1_account_rollup(spark, sf):
    return accounts.rollup(table(spark, sf, "contracts"), "account_id", "base_obligation_date", "award_amount", ["sub_agency", "segment", "region"], {"vendors": "recipient_entity_id", "codes": "psc_code"}, {"hardware_total": hardware(), "maintenance_total": maintained()}, P.as_of)


_SCOPES = {"all": "true", "core": "psc_role = 'hardware_core'", "services": "psc_role IN ('maintenance', 'storage_as_a_service')", "direct": "channel = 'direct'"}


@query(
    "WITH t AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS scope, account_id, max(base_obligation_date)::DATE AS d FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date IS NOT NULL AND {m} GROUP BY 2" for n, m in _SCOPES.items())
    + f"), i AS (SELECT scope, round_even(date_diff('day', d, {AS_OF}) / {P.month_days}, 1) AS idle FROM t) SELECT scope, count(*) AS accounts, median(idle) AS median_idle, "
    + ", ".join(f"avg(CASE WHEN idle >= {k} THEN 1 ELSE 0 END) AS share_{k}" for k in (12, 18, 24, 36))
    + " FROM i GROUP BY 1"
)
def a19_dormancy_scopes(spark, sf):
    return accounts.scopes(table(spark, sf, "contracts"), "account_id", "base_obligation_date", {n: F.expr(m) for n, m in _SCOPES.items()}, P.as_of)


_AGE = f"date_diff('day', base_obligation_date::DATE, {AS_OF})"


@query(
    f"""
WITH g AS (SELECT account_id,
  CAST(coalesce(sum({DEC}) FILTER (WHERE {_AGE} BETWEEN 0 AND {P.shift_window_days} AND channel = 'direct'), 0) AS DOUBLE) AS rp,
  CAST(coalesce(sum({DEC}) FILTER (WHERE {_AGE} BETWEEN 0 AND {P.shift_window_days}), 0) AS DOUBLE) AS r,
  CAST(coalesce(sum({DEC}) FILTER (WHERE {_AGE} > {P.shift_window_days} AND channel = 'direct'), 0) AS DOUBLE) AS pp,
  CAST(coalesce(sum({DEC}) FILTER (WHERE {_AGE} > {P.shift_window_days}), 0) AS DOUBLE) AS p
  FROM contracts WHERE account_id IS NOT NULL AND channel IN ('direct', 'partner') GROUP BY 1),
s AS (SELECT account_id, rp / nullif(r, 0) AS recent_share, pp / nullif(p, 0) AS prior_share FROM g)
SELECT account_id, recent_share, prior_share, recent_share - prior_share AS delta,
  ((recent_share >= 0.5) <> (prior_share >= 0.5)) AND abs(recent_share - prior_share) >= {P.shift_delta} AS shifted,
  CASE WHEN ((recent_share >= 0.5) <> (prior_share >= 0.5)) AND abs(recent_share - prior_share) >= {P.shift_delta} THEN CASE WHEN recent_share > prior_share THEN 'towards' ELSE 'away' END ELSE 'none' END AS direction
FROM s WHERE recent_share IS NOT NULL AND prior_share IS NOT NULL"""
)
def a20_share_shift(spark, sf):
    c = table(spark, sf, "contracts").where(F.col("channel").isin("direct", "partner"))
    return accounts.share_shift(c, "account_id", "base_obligation_date", "award_amount", F.col("channel") == "direct", F.lit(True), P.as_of, P.shift_window_days, P.shift_delta)


@query(
    f"""
WITH d AS (SELECT account_id AS a, base_obligation_date::DATE AS d, sum({DEC}) AS x FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date IS NOT NULL GROUP BY 1, 2),
f AS (SELECT a, min(d) AS f, sum(x) AS x, CAST(year(min(d) + INTERVAL 3 MONTH) AS INTEGER) AS cohort_fy FROM d GROUP BY 1),
s AS (SELECT cohort_fy, count(*) AS accounts, CAST(coalesce(sum(x), 0) AS DOUBLE) AS total FROM f GROUP BY 1),
y AS (SELECT a, cohort_fy, f, n AS year_n FROM f, (VALUES (1), (2), (3)) t(n) WHERE f + CAST(365 * n AS INTEGER) <= {AS_OF}),
h AS (SELECT DISTINCT d.a, CAST(ceil(date_diff('day', f.f, d.d) / 365.0) AS INTEGER) AS year_n FROM d JOIN f ON d.a = f.a)
SELECT s.cohort_fy, s.accounts, s.total, y.year_n, count(*) AS eligible, count(h.a) AS active, count(h.a) / count(*) AS rate
FROM y JOIN s USING (cohort_fy) LEFT JOIN h ON h.a = y.a AND h.year_n = y.year_n GROUP BY 1, 2, 3, 4"""
)
def a16_cohorts(spark, sf):
    return accounts.cohorts(table(spark, sf, "contracts"), "account_id", "base_obligation_date", "award_amount", P.as_of)


@query(
    f"""
WITH g AS (SELECT account_id, count(*) AS n, min(base_obligation_date)::DATE AS f FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date IS NOT NULL GROUP BY 1),
r AS (SELECT account_id, CAST(year(f + INTERVAL 3 MONTH) AS INTEGER) AS cohort_fy, n / greatest(date_diff('day', f, {AS_OF}) / {P.year_days}, 0.5) AS per_year FROM g)
SELECT *, median(per_year) OVER (PARTITION BY cohort_fy) AS cohort_median, per_year / nullif(median(per_year) OVER (PARTITION BY cohort_fy), 0) AS pace FROM r"""
)
def a17_pace_against_cohort(spark, sf):
    return accounts.pace_against_cohort(table(spark, sf, "contracts"), "account_id", "base_obligation_date", P.as_of)


def _peers(spark, sf):
    c = table(spark, sf, "contracts")
    a = c.where("account_id is not null").groupBy("account_id").agg(v.mode(F.col("segment")).alias("segment"), exact_sum(F.col("award_amount")).alias("total"))
    return c, accounts.peer_groups(a, "account_id", "segment", "total")


_PEERS = f"""
g AS (SELECT account_id, CAST(coalesce(sum({DEC}), 0) AS DOUBLE) AS total, count(*) FILTER (WHERE segment = 'Defense') AS de, count(*) FILTER (WHERE segment = 'Civilian') AS ci FROM contracts WHERE account_id IS NOT NULL GROUP BY 1),
p AS (SELECT account_id, total, CASE WHEN de = 0 AND ci = 0 THEN NULL WHEN de > ci THEN 'Defense' ELSE 'Civilian' END AS segment, row_number() OVER (ORDER BY total, account_id) AS pos, count(*) OVER () AS n FROM g),
b AS (SELECT *, CAST(greatest(1, coalesce(ceil((pos - 1) * 5.0 / nullif(n - 1, 0)), 1)) AS INTEGER) AS band FROM p),
peers AS (SELECT account_id, segment, total, ['XS','S','M','L','XL'][band] AS size_band, concat_ws(' / ', segment, ['XS','S','M','L','XL'][band]) AS peer_group FROM b)
"""


@query(f"WITH {_PEERS} SELECT * FROM peers")
def r7_size_bands(spark, sf):
    return _peers(spark, sf)[1]


@query(
    f"""WITH {_PEERS},
bought AS (SELECT DISTINCT account_id, upper(trim(psc_code)) AS code FROM contracts WHERE account_id IS NOT NULL AND trim(psc_code) <> ''),
s AS (SELECT peer_group, count(*) AS members FROM peers GROUP BY 1),
a AS (SELECT peer_group, code, count(*) AS adopters FROM bought JOIN peers USING (account_id) GROUP BY 1, 2),
o AS (SELECT a.*, adopters / members AS adoption FROM a JOIN s USING (peer_group) WHERE adopters / members >= {P.adoption_floor})
SELECT m.account_id, m.peer_group, o.code, o.adopters, o.adoption FROM peers m JOIN o USING (peer_group) WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.account_id = m.account_id AND b.code = o.code)"""
)
def a18_peer_gaps(spark, sf):
    c, peers = _peers(spark, sf)
    return accounts.peer_gaps(c.withColumn("code", tidy_key(F.col("psc_code"))), peers, "account_id", "code", "peer_group", P.adoption_floor)


@query(
    f"""
WITH g AS (SELECT account_id, recipient_entity_id AS top_part, coalesce(sum({DEC}), 0) AS x, count(*) AS n FROM contracts WHERE account_id IS NOT NULL AND recipient_entity_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY x DESC, top_part) AS rn, sum(x) OVER (PARTITION BY account_id) AS t, sum(n) OVER (PARTITION BY account_id) AS rows FROM g)
SELECT account_id, top_part, CAST(x AS DOUBLE) AS top_total, CAST(t AS DOUBLE) AS total, CAST(x AS DOUBLE) / nullif(CAST(t AS DOUBLE), 0) AS share, CAST(rows AS BIGINT) AS rows FROM r WHERE rn = 1"""
)
def a25_concentration(spark, sf):
    return accounts.concentration(table(spark, sf, "contracts"), "account_id", "recipient_entity_id", "award_amount")


@query(
    f"""
WITH g AS (SELECT account_id, count(*) FILTER (WHERE {_AGE} BETWEEN 0 AND 730) AS r, count(*) FILTER (WHERE {_AGE} > 730) AS p, max({_AGE}) AS span FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date IS NOT NULL GROUP BY 1)
SELECT account_id, r / 2.0 AS recent_pace, p / greatest((span - 730) / 365.0, 0.5) AS prior_pace FROM g"""
)
def a26_acceleration(spark, sf):
    return accounts.acceleration(table(spark, sf, "contracts"), "account_id", "base_obligation_date", P.as_of)


@query(
    f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY base_obligation_date DESC, contract_award_unique_key) AS rn FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date IS NOT NULL)
SELECT account_id, count(*) AS used, median(award_amount) AS med, CAST(sum({DEC}) AS DOUBLE) / nullif(count(award_amount), 0) AS mean FROM r WHERE rn <= 5 GROUP BY 1"""
)
def a9_last_awards(spark, sf):
    c = table(spark, sf, "contracts").where("base_obligation_date is not null").select("account_id", "base_obligation_date", "contract_award_unique_key", "award_amount")
    last = accounts.last_n(c, "account_id", [F.desc("base_obligation_date"), F.col("contract_award_unique_key")], 5)
    return last.groupBy("account_id").agg(F.count("*").alias("used"), F.median("award_amount").alias("med"), v.ratio(F.sum(F.col("award_amount").try_cast("decimal(28,6)")).cast("double"), F.count("award_amount")).alias("mean"))


@query(
    f"""
WITH g AS (SELECT recipient_entity_id, count(DISTINCT CASE WHEN channel <> 'unknown' THEN channel END) AS k, sum({DEC}) AS x FROM contracts WHERE recipient_entity_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS entities, count(*) FILTER (WHERE k > 1) AS unstable, avg(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS share, CAST(sum(x) FILTER (WHERE k > 1) AS DOUBLE) / CAST(sum(x) AS DOUBLE) AS amount_share FROM g"""
)
def a15_instability(spark, sf):
    return accounts.instability(table(spark, sf, "contracts"), "recipient_entity_id", "channel", "award_amount")


@query(f"SELECT award_fy, psc_role, count(DISTINCT contract_award_unique_key) AS awards, CAST(coalesce(sum({DEC}), 0) AS DOUBLE) AS total FROM contracts GROUP BY 1, 2")
def a23_series(spark, sf):
    return table(spark, sf, "contracts").groupBy("award_fy", "psc_role").agg(F.countDistinct("contract_award_unique_key").alias("awards"), exact_sum(F.col("award_amount")).alias("total"))


@query("SELECT strftime(end_date, '%Y-%m') AS month, CAST(year(end_date) // 10 * 10 AS INTEGER) AS decade, count(*) AS n FROM contracts WHERE end_date IS NOT NULL GROUP BY 1, 2")
def a24_histograms(spark, sf):
    c = table(spark, sf, "contracts").where("end_date is not null")
    return c.groupBy(F.date_format("end_date", "yyyy-MM").alias("month"), (F.floor(F.year("end_date") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


@query("SELECT contract_award_unique_key, award_amount FROM contracts WHERE award_amount IS NOT NULL ORDER BY award_amount DESC, contract_award_unique_key LIMIT 25")
def t1_top_k(spark, sf):
    c = table(spark, sf, "contracts").where("award_amount is not null")
    return c.orderBy(F.desc("award_amount"), "contract_award_unique_key").limit(25).select("contract_award_unique_key", "award_amount")


# coverage and clusters

_W = P.coverage_window_days


@query(
    f"""
WITH h AS (SELECT * FROM contracts WHERE psc_role IN {HARD}),
m AS (SELECT account_id, recipient_entity_id, base_obligation_date::DATE AS d FROM contracts WHERE {KEPT})
SELECT h.contract_award_unique_key,
  EXISTS (SELECT 1 FROM m WHERE m.account_id = h.account_id AND m.d BETWEEN h.base_obligation_date::DATE - {_W} AND h.base_obligation_date::DATE + {_W}) AS covered,
  EXISTS (SELECT 1 FROM m WHERE m.account_id = h.account_id AND m.recipient_entity_id = h.recipient_entity_id AND m.d BETWEEN h.base_obligation_date::DATE - {_W} AND h.base_obligation_date::DATE + {_W}) AS covered_vendor
FROM h"""
)
def j8_coverage(spark, sf):
    c = table(spark, sf, "contracts").select("contract_award_unique_key", "account_id", "recipient_entity_id", "base_obligation_date", "psc_role")
    by = {"covered": ["account_id"], "covered_vendor": ["account_id", "recipient_entity_id"]}
    return coverage.coverages(c, by, "base_obligation_date", maintained(), hardware(), _W).select("contract_award_unique_key", *by)


@query(
    f"""
WITH m AS (SELECT DISTINCT account_id, base_obligation_date::DATE AS d FROM contracts WHERE {KEPT}),
h AS (SELECT segment, channel, award_fy, EXISTS (SELECT 1 FROM m WHERE m.account_id = c.account_id AND m.d BETWEEN c.base_obligation_date::DATE - {_W} AND c.base_obligation_date::DATE + {_W}) AS covered FROM contracts c WHERE psc_role IN {HARD})
SELECT segment, channel, award_fy, CAST(grouping(segment, channel, award_fy) AS INTEGER) AS level, count(*) AS n, avg(CASE WHEN covered THEN 1 ELSE 0 END) AS rate FROM h GROUP BY GROUPING SETS ((segment), (channel), (award_fy), ())"""
)
def a4_rates_by_group(spark, sf):
    c = table(spark, sf, "contracts").select("account_id", "base_obligation_date", "psc_role", "segment", "channel", "award_fy")
    h = coverage.covered(c, ["account_id"], "base_obligation_date", maintained(), hardware(), _W, "covered").withColumn("x", F.col("covered").cast("int"))
    g = h.groupingSets([["segment"], ["channel"], ["award_fy"], []], "segment", "channel", "award_fy")
    return g.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.avg("x").alias("rate"))


def _clusters(spark, sf):
    c = table(spark, sf, "contracts")
    due = c.where(F.to_date("end_date").between(F.lit(P.as_of), F.date_add(F.lit(P.as_of), P.renewal_lookahead_days)))
    return coverage.anchored_clusters(due, "account_id", "end_date", P.coterm_window_days)


_CLUSTERS = f"""due AS (SELECT * FROM contracts WHERE account_id IS NOT NULL AND end_date::DATE BETWEEN {AS_OF} AND {AS_OF} + {P.renewal_lookahead_days}),
days AS (SELECT DISTINCT account_id, end_date::DATE AS d FROM due),
num AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY d) AS i FROM days),
rec AS (SELECT account_id, d, i, d AS anchor, 1 AS cluster FROM num WHERE i = 1
  UNION ALL SELECT n.account_id, n.d, n.i, CASE WHEN n.d - r.anchor > {P.coterm_window_days} THEN n.d ELSE r.anchor END, CASE WHEN n.d - r.anchor > {P.coterm_window_days} THEN r.cluster + 1 ELSE r.cluster END
  FROM rec r JOIN num n ON n.account_id = r.account_id AND n.i = r.i + 1),
clustered AS (SELECT due.*, rec.cluster FROM due JOIN rec ON rec.account_id = due.account_id AND rec.d = due.end_date::DATE)"""


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT contract_award_unique_key, account_id, cluster FROM clustered")
def w7_anchored_clusters(spark, sf):
    return _clusters(spark, sf).select("contract_award_unique_key", "account_id", "cluster")


@query(
    f"""WITH RECURSIVE {_CLUSTERS} SELECT account_id, cluster, count(*) AS size, count(DISTINCT recipient_entity_id) AS vendors, CAST(coalesce(sum({DEC}), 0) AS DOUBLE) AS total,
  min(end_date)::DATE AS first_day, max(end_date)::DATE AS last_day, CAST(date_diff('day', min(end_date)::DATE, max(end_date)::DATE) AS INTEGER) AS span_days FROM clustered GROUP BY 1, 2 HAVING count(*) > 1"""
)
def w8_cluster_summary(spark, sf):
    return coverage.cluster_summary(_clusters(spark, sf), "account_id", "cluster", "end_date", "award_amount", "recipient_entity_id").where("size > 1")


# flows

_PRIME_KEY = "upper(trim(prime_award_unique_key))"


@query(f"WITH {_PRIMES} SELECT count(*) AS subs, count(p.key) AS joined, count(p.key) / count(*) AS rate FROM subaward_report s LEFT JOIN primes p ON {_PRIME_KEY} = p.key")
def j3_join_rate(spark, sf):
    subs = table(spark, sf, "subaward_report").withColumn("key", tidy_key(F.col("prime_award_unique_key")))
    both = subs.select("key").join(_primes(spark, sf).select("key", F.lit(1).alias("hit")), "key", "left")
    return both.agg(F.count("*").alias("subs"), F.count("hit").alias("joined"), (F.count("hit") / F.count("*")).alias("rate"))


_TRUE = "CASE WHEN upper(trim(manufacturer_of_goods)) IN ('T','TRUE','Y','YES','1') THEN 'true' WHEN upper(trim(manufacturer_of_goods)) IN ('F','FALSE','N','NO','0') THEN 'false' END"
_LABELS = f"""labels AS (SELECT uei, label = 'true' AS label FROM (SELECT *, row_number() OVER (PARTITION BY uei ORDER BY n DESC, label) AS rn FROM
  (SELECT recipient_uei AS uei, {_TRUE} AS label, count(*) AS n FROM primes WHERE recipient_uei IS NOT NULL AND {_TRUE} IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1)"""


def _labels(primes):
    g = primes.where("recipient_uei is not null").groupBy(F.col("recipient_uei").alias("uei")).agg(v.mode(v.truthy(F.col("manufacturer_of_goods")).cast("string")).alias("label"))
    return g.where("label is not null").withColumn("label", F.col("label") == "true")


@query(f"WITH {_PRIMES}, {_LABELS} SELECT uei, label FROM labels")
def a10_learned_labels(spark, sf):
    return _labels(_primes(spark, sf))


_FLOWS = f"""{_PRIMES}, {_LABELS},
g AS (SELECT {_PRIME_KEY} AS key, count(*) AS subs, count(DISTINCT subawardee_name) AS names, CAST(coalesce(sum(CAST(subaward_amount AS DECIMAL(28,6))), 0) AS DOUBLE) AS flow,
  CAST(coalesce(sum(CAST(subaward_amount AS DECIMAL(28,6))) FILTER (WHERE label), 0) AS DOUBLE) AS tt, CAST(coalesce(sum(CAST(subaward_amount AS DECIMAL(28,6))) FILTER (WHERE label IS NOT NULL), 0) AS DOUBLE) AS ll
  FROM subaward_report LEFT JOIN labels ON subawardee_uei = uei WHERE coalesce(trim(prime_award_unique_key), '') <> '' GROUP BY 1),
flows AS (SELECT g.key, subs, names, flow, p.total_obligated_amount AS own,
  CASE WHEN flow / nullif(p.total_obligated_amount, 0) IS NOT NULL THEN least(greatest(flow / nullif(p.total_obligated_amount, 0), 0), 3) END AS passthrough, tt / nullif(ll, 0) AS true_share FROM g JOIN primes p ON p.key = g.key)"""


def _flows(spark, sf):
    primes = _primes(spark, sf)
    subs = table(spark, sf, "subaward_report").withColumn("key", tidy_key(F.col("prime_award_unique_key"))).withColumnRenamed("subawardee_uei", "uei")
    return flows.prime_flows(subs, primes, "key", "subaward_amount", "subawardee_name", "total_obligated_amount", _labels(primes), "uei", "label")


@query(f"WITH {_FLOWS} SELECT * FROM flows")
def a11_prime_flows(spark, sf):
    return _flows(spark, sf)


_BINS = [0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 3.0]


@query(f"WITH {_FLOWS} SELECT CASE " + " ".join(f"WHEN passthrough >= {a} AND passthrough < {b} THEN {i}" for i, (a, b) in enumerate(zip(_BINS, _BINS[1:]))) + " END AS bin, count(*) AS n FROM flows GROUP BY 1")
def a38_passthrough_histogram(spark, sf):
    return _flows(spark, sf).groupBy(v.bucket(F.col("passthrough"), _BINS).alias("bin")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT prime_awardee_uei, subawardee_name, count(*) AS rows, count(DISTINCT prime_award_unique_key) AS awards, CAST(coalesce(sum(CAST(subaward_amount AS DECIMAL(28,6))), 0) AS DOUBLE) AS total,
  min({_DAY}) AS first_day, max({_DAY}) AS last_day FROM subaward_report WHERE prime_awardee_uei IS NOT NULL AND subawardee_name IS NOT NULL GROUP BY 1, 2"""
)
def a12_edges(spark, sf):
    return flows.edges(table(spark, sf, "subaward_report"), "prime_awardee_uei", "subawardee_name", "subaward_amount", "prime_award_unique_key", v.to_day(F.col("subaward_action_date")))


# episodes and survival

_EPISODES = f"""eps AS (SELECT account_id AS account, base_obligation_date::DATE AS day, count(*) AS rows, coalesce(sum({DEC}), 0) AS total, max(CASE WHEN {KEPT} THEN 1 ELSE 0 END) AS maint,
  max(CASE WHEN psc_role IN {HARD} THEN 1 ELSE 0 END) AS hard, arg_min(recipient_entity_id, contract_award_unique_key) FILTER (WHERE recipient_entity_id IS NOT NULL) AS recipient_entity_id
  FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date IS NOT NULL GROUP BY 1, 2)"""


def _episodes(spark, sf):
    return episodes.episodes(table(spark, sf, "contracts"), "account_id", "base_obligation_date", "award_amount", {"maint": maintained(), "hard": hardware()}, ["recipient_entity_id"], "contract_award_unique_key")


@query(f"WITH {_EPISODES} SELECT account, day, rows, CAST(total AS DOUBLE) AS total, CAST(maint AS INTEGER) AS maint, CAST(hard AS INTEGER) AS hard, recipient_entity_id FROM eps")
def a13_episodes(spark, sf):
    return _episodes(spark, sf).withColumn("total", F.col("total").cast("double"))


@query(
    f"""WITH {_EPISODES},
n AS (SELECT *, CASE WHEN recipient_entity_id IS NOT NULL AND row_number() OVER (PARTITION BY account, recipient_entity_id ORDER BY day) = 1 THEN 1 ELSE 0 END AS fresh FROM eps),
r AS (SELECT account, day, row_number() OVER w AS ordinal, CAST(sum(total) OVER w AS DOUBLE) AS running_total, date_diff('day', lag(day) OVER w, day) AS gap_before,
  date_diff('day', min(day) OVER (PARTITION BY account), day) AS span, CAST(sum(fresh) OVER w AS BIGINT) AS vendors_so_far, sum(maint) OVER w AS m FROM n WINDOW w AS (PARTITION BY account ORDER BY day)),
g AS (SELECT *, span / nullif(ordinal - 1, 0) AS mg FROM r)
SELECT account, day, CAST(ordinal AS INTEGER) AS ordinal, running_total, CAST(gap_before AS INTEGER) AS gap_before, span / {P.year_days} AS tenure_years,
  coalesce(mg, (SELECT median(mg) FROM g WHERE day <= DATE '{P.train_cutoff}')) AS mean_gap, vendors_so_far, m / ordinal AS maint_share, log10(greatest(running_total, 1)) AS log_total FROM g"""
)
def w2_running_features(spark, sf):
    f = episodes.running_features(_episodes(spark, sf), ["maint", "hard"], ["recipient_entity_id"], P.train_cutoff)
    return f.select("account", "day", "ordinal", "running_total", "gap_before", "tenure_years", "mean_gap", F.col("recipient_entity_id_so_far").alias("vendors_so_far"), "maint_share", "log_total")


_GAPS = f"""{_EPISODES},
nx AS (SELECT account, day, lead(day) OVER (PARTITION BY account ORDER BY day) AS nxt FROM eps WHERE day <= DATE '{P.train_cutoff}'),
gaps AS (SELECT account, day, greatest(CAST(date_diff('day', day, coalesce(nxt, DATE '{P.train_cutoff}')) AS DOUBLE), 0.5) AS duration, CAST(nxt IS NOT NULL AS INTEGER) AS event FROM nx)"""


def _gaps(spark, sf):
    return episodes.gaps(_episodes(spark, sf), P.train_cutoff)


@query(f"WITH {_GAPS} SELECT * FROM gaps")
def w9_gaps(spark, sf):
    return _gaps(spark, sf).select("account", "day", "duration", "event")


@query(f"WITH {_EPISODES} SELECT account, max(day) AS day, CAST(date_diff('day', max(day), DATE '{P.train_cutoff}') AS INTEGER) AS elapsed FROM eps WHERE day <= DATE '{P.train_cutoff}' GROUP BY 1")
def j9_state_at(spark, sf):
    return episodes.state_at(_episodes(spark, sf), P.train_cutoff, []).select("account", "day", "elapsed")


_EDGES = [0, 90, 180, 365, 730, 1095, 1_000_000_000]


@query(f"WITH {_GAPS} SELECT CASE " + " ".join(f"WHEN duration >= {a} AND duration < {b} THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " END AS bucket, count(*) AS n, avg(event) AS rate FROM gaps GROUP BY 1")
def a32_rate_by_bucket(spark, sf):
    return episodes.rate_by_bucket(_gaps(spark, sf), _EDGES)


_NA = f"""{_GAPS}, t AS (SELECT duration AS t, CAST(sum(event) AS BIGINT) AS events, count(*) AS n FROM gaps GROUP BY 1),
na0 AS (SELECT t, events, CAST(sum(n) OVER (ORDER BY t DESC) AS BIGINT) AS at_risk FROM t), na AS (SELECT *, sum(events / at_risk) OVER (ORDER BY t) AS cumulative FROM na0)"""


@query(f"WITH {_NA} SELECT * FROM na")
def a31_nelson_aalen(spark, sf):
    return curves.nelson_aalen(_gaps(spark, sf))


@query(f"WITH {_NA} SELECT s.account, s.elapsed, coalesce((SELECT max(cumulative) FROM na WHERE t <= s.elapsed), 0) AS cumulative FROM (SELECT account, CAST(date_diff('day', max(day), DATE '{P.train_cutoff}') AS INTEGER) AS elapsed FROM eps WHERE day <= DATE '{P.train_cutoff}' GROUP BY 1) s")
def j10_step_lookup(spark, sf):
    state = episodes.state_at(_episodes(spark, sf), P.train_cutoff, []).select("account", "elapsed")
    return curves.step_lookup(state, "elapsed", curves.nelson_aalen(_gaps(spark, sf)), "t", "cumulative", 0.0, "cumulative")


@query(
    f"""WITH {_NA}, seg AS (SELECT t AS t0, lead(t) OVER (ORDER BY t) AS t1, cumulative AS v0, lead(cumulative) OVER (ORDER BY t) AS v1 FROM na),
s AS (SELECT account, CAST(date_diff('day', max(day), DATE '{P.train_cutoff}') AS INTEGER) AS elapsed FROM eps WHERE day <= DATE '{P.train_cutoff}' GROUP BY 1)
SELECT s.account, s.elapsed, coalesce(CASE WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (elapsed - t0) / (t1 - t0) END, 0) AS cumulative FROM s LEFT JOIN seg ON s.elapsed >= t0 AND (t1 IS NULL OR s.elapsed < t1)"""
)
def j11_interpolated(spark, sf):
    state = episodes.state_at(_episodes(spark, sf), P.train_cutoff, []).select("account", "elapsed")
    return curves.interpolated(state, "elapsed", curves.nelson_aalen(_gaps(spark, sf)), "t", "cumulative", 0.0, "cumulative")


_HAZARD = "h0 AS (SELECT CAST(floor(value / 50) AS INTEGER) AS bucket, count(*) AS exposure, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events WHERE value IS NOT NULL GROUP BY 1), hz AS (SELECT *, failures / exposure AS daily, 1 - pow(1 - failures / exposure, 365.25) AS yearly FROM h0)"


def _hazard(spark, sf):
    return curves.hazard(table(spark, sf, "events"), F.floor(F.col("value") / 50).cast("int"), F.lit(1).cast("bigint"), (F.col("event_type") == "error").cast("bigint"))


@query(f"WITH {_HAZARD} SELECT * FROM hz")
def a21_hazard(spark, sf):
    return _hazard(spark, sf)


@query(f"WITH {_HAZARD}, f AS (SELECT * FROM hz WHERE exposure > 100) SELECT min(yearly) AS floor, coalesce(min(CAST(bucket AS DOUBLE)) FILTER (WHERE yearly >= 1.0 * (SELECT min(yearly) FROM f)), 5.0) AS threshold FROM f")
def a22_rising_from(spark, sf):
    return curves.rising_from(_hazard(spark, sf), 100, factor=1.0)


@query(f"WITH {_HAZARD}, f AS (SELECT * FROM hz WHERE exposure > 100) SELECT min(yearly) AS floor, coalesce(min(CAST(bucket AS DOUBLE)) FILTER (WHERE yearly >= 2.0 * (SELECT min(yearly) FROM f)), 5.0) AS threshold FROM f")
def a22_doubled_from(spark, sf):
    """Where the hazard is twice its floor, as the survey has it; ``a22_rising_from`` asks for the floor itself."""
    return curves.rising_from(_hazard(spark, sf), 100)


_LIFE = f"""life AS (SELECT contract_award_unique_key, start_date, end_date, start_date::DATE AS i, end_date::DATE AS r, DATE '2015-01-01' AS lo, {AS_OF} AS nw FROM contracts),
l2 AS (SELECT *, coalesce(r <= nw, false) AS gone, CASE WHEN coalesce(r <= nw, false) THEN r ELSE nw END AS en, greatest(i, lo) AS st FROM life),
l3 AS (SELECT *, CASE WHEN i IS NULL THEN 'no_install' WHEN r < i THEN 'removed_before_install' WHEN gone AND r < lo THEN 'removed_before_window' WHEN en <= st THEN 'no_time_observed' END AS drop_reason FROM l2)"""


def _life(spark, sf):
    return survival.lifetimes(table(spark, sf, "contracts"), "contract_award_unique_key", "start_date", "end_date", date(2015, 1, 1), P.as_of)


@query(
    f"""WITH {_LIFE} SELECT contract_award_unique_key, drop_reason, CASE WHEN drop_reason IS NULL THEN CAST(gone AS INTEGER) END AS event,
  CASE WHEN drop_reason IS NULL THEN greatest(date_diff('day', i, st) / {P.year_days}, 0) END AS entry_age, CASE WHEN drop_reason IS NULL THEN greatest(date_diff('day', i, en) / {P.year_days}, 0) END AS exit_age,
  CASE WHEN drop_reason IS NULL THEN i < lo END AS left_truncated FROM l3"""
)
def u9_lifetimes(spark, sf):
    return _life(spark, sf).select("contract_award_unique_key", "drop_reason", "event", "entry_age", "exit_age", "left_truncated")


_CUTOFFS = [date(y, 9, 30) for y in range(2019, 2024)]


@query(
    f"""WITH {_LIFE}, c AS (SELECT unnest([{", ".join(f"DATE '{d}'" for d in _CUTOFFS)}]) AS cutoff)
SELECT cutoff, count(*) AS n, CAST(sum(CASE WHEN r <= cutoff + 365 THEN 1 ELSE 0 END) AS BIGINT) AS events FROM l3, c WHERE drop_reason IS NULL AND i <= cutoff AND (r IS NULL OR r > cutoff) GROUP BY 1"""
)
def u8_windows(spark, sf):
    """Rows at risk and events in each of five windows before the cutoff, on which a baseline's direction is learned."""
    return survival.at_risk(_life(spark, sf), "start_date", "end_date", _CUTOFFS, P.horizon_days).groupBy("cutoff").agg(F.count("*").alias("n"), F.sum("label").alias("events"))


_AGE_AUC = f"""{_LIFE}, c AS (SELECT unnest([{", ".join(f"DATE '{d}'" for d in _CUTOFFS)}]) AS cutoff),
w AS (SELECT cutoff, date_diff('day', i, cutoff) AS age, CAST(coalesce(r <= cutoff + {P.horizon_days}, false) AS INTEGER) AS y FROM l3, c WHERE drop_reason IS NULL AND i <= cutoff AND (r IS NULL OR r > cutoff)),
k AS (SELECT *, rank() OVER (PARTITION BY cutoff ORDER BY age) + (count(*) OVER (PARTITION BY cutoff, age) - 1) / 2.0 AS rk FROM w),
a AS (SELECT cutoff, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM k GROUP BY 1 HAVING count(*) >= 50 AND sum(y) > 0)"""


def _age_auc(spark, sf):
    return survival.age_auc(survival.at_risk(_life(spark, sf), "start_date", "end_date", _CUTOFFS, P.horizon_days))


@query(f"WITH {_AGE_AUC} SELECT *, coalesce(auc < 0.5, false) AS inverted FROM a")
def u8_age_auc(spark, sf):
    return _age_auc(spark, sf)


@query(f"WITH {_AGE_AUC} SELECT count(*) AS windows, count(*) FILTER (WHERE auc < 0.5) AS inverted, CASE WHEN 2 * count(*) FILTER (WHERE auc < 0.5) > count(*) THEN 'youngest_first' ELSE 'oldest_first' END AS direction FROM a")
def u8_age_direction(spark, sf):
    """The direction of age as a baseline, by the majority of the windows before the cutoff."""
    return survival.age_direction(_age_auc(spark, sf))


_SCORED = f"""{_EPISODES}, sc AS (SELECT account, count(*) FILTER (WHERE day <= DATE '{P.train_cutoff}') AS past, date_diff('day', max(day) FILTER (WHERE day <= DATE '{P.train_cutoff}'), DATE '{P.train_cutoff}') AS elapsed,
  CAST(bool_or(day > DATE '{P.train_cutoff}' AND day <= DATE '{P.train_cutoff}' + {P.horizon_days}) AS INTEGER) AS y FROM eps GROUP BY 1),
scored AS (SELECT account, y, past, elapsed, 1 / (1 + elapsed / 180.0) AS p FROM sc WHERE past > 0)"""


def _scored(spark, sf):
    """Accounts at the cutoff with a simple score of recency, and whether they bought within the horizon."""
    eps = _episodes(spark, sf)
    cut = F.lit(P.train_cutoff)
    g = eps.groupBy("account").agg(F.sum((F.col("day") <= cut).cast("int")).alias("past"), F.max(F.when(F.col("day") <= cut, F.col("day"))).alias("last"), F.max(((F.col("day") > cut) & (F.col("day") <= F.date_add(cut, P.horizon_days))).cast("int")).alias("y"))
    elapsed = F.datediff(cut, "last")
    return g.where("past > 0").select("account", "y", "past", elapsed.alias("elapsed"), (1 / (1 + elapsed / F.lit(180.0))).alias("p"))


_AVG = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"WITH {_SCORED}, r AS (SELECT *, {_AVG.format('p')} AS rk FROM scored) SELECT (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM r")
def a29_auc(spark, sf):
    return metrics.auc(_scored(spark, sf), "y", "p")


_BINNED = "b AS (SELECT *, CAST(greatest(1, ceil((row_number() OVER (ORDER BY p, account) - 1) * 10.0 / (count(*) OVER () - 1))) AS INTEGER) AS bin FROM scored), cal AS (SELECT bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed, avg(y) - avg(p) AS gap FROM b GROUP BY 1)"


@query(f"WITH {_SCORED}, {_BINNED} SELECT * FROM cal")
def a27_calibration(spark, sf):
    return metrics.calibration(_scored(spark, sf), "y", "p", "account")


@query(f"WITH {_SCORED}, {_BINNED} SELECT (SELECT count(*) FROM scored) AS n, (SELECT avg((p - y) * (p - y)) FROM scored) AS brier, (SELECT avg(p) FROM scored) AS predicted, (SELECT avg(y) FROM scored) AS observed, (SELECT sum(n * abs(gap)) / sum(n) FROM cal) AS ece")
def a28_brier_ece(spark, sf):
    s = _scored(spark, sf)
    return metrics.brier(s, "y", "p").withColumn("ece", metrics.calibration_error(metrics.calibration(s, "y", "p", "account")).scalar())


@query(f"WITH {_SCORED}, r AS (SELECT {_AVG.format('p')} AS a, {_AVG.format('past')} AS b FROM scored) SELECT corr(a, b) AS spearman FROM r")
def a33_spearman(spark, sf):
    return metrics.spearman(_scored(spark, sf), "p", "past")


@query(f"WITH {_SCORED} SELECT account, past, elapsed, row_number() OVER (ORDER BY past DESC, account) AS rank FROM scored")
def r2_global_rank(spark, sf):
    return ordered.ranked(_scored(spark, sf).select("account", "past", "elapsed"), ["-past", "account"])


@query(f"WITH {_SCORED} SELECT count(*) AS shared, count(*) / 50.0 AS overlap FROM (SELECT account FROM scored ORDER BY p DESC, account LIMIT 50) JOIN (SELECT account FROM scored ORDER BY past DESC, account LIMIT 50) USING (account)")
def t3_top_overlap(spark, sf):
    return metrics.top_overlap(_scored(spark, sf), "account", "p", "past", 50)


_MARGINS, _COSTS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8], [4000.0, 8000.0, 12000.0, 20000.0, 40000.0]


_VALUE = "va AS (SELECT account_id AS account, median(award_amount) AS med FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY base_obligation_date DESC, contract_award_unique_key) AS rn FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date IS NOT NULL) WHERE rn <= 5 GROUP BY 1)"


@query(
    f"""WITH {_SCORED}, {_VALUE}, ev AS (SELECT CAST(m AS DOUBLE) AS margin, CAST(c AS DOUBLE) AS cost, p * med * CAST(m AS DOUBLE) - CAST(c AS DOUBLE) AS x
  FROM scored JOIN va USING (account), (SELECT unnest({_MARGINS}) AS m), (SELECT unnest({_COSTS}) AS c) WHERE p IS NOT NULL AND med IS NOT NULL)
SELECT margin, cost, CAST(sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN x > 0 THEN CAST(x AS DECIMAL(28,6)) END) AS DOUBLE) AS total FROM ev GROUP BY 1, 2"""
)
def u12_score_grid(spark, sf):
    value = a9_last_awards(spark, sf).select(F.col("account_id").alias("account"), F.col("med").alias("value"))
    return rules.score_grid(_scored(spark, sf).join(value, "account"), "p", "value", _MARGINS, _COSTS)


def _training(spark, sf):
    f = episodes.running_features(_episodes(spark, sf), ["maint", "hard"], ["recipient_entity_id"], P.train_cutoff)
    return _gaps(spark, sf).select("account", "day", "duration", "event").join(f, ["account", "day"])


_FEATURES = ["log_total", "tenure_years", "mean_gap", "maint_share", "hard_share"]


@query()
def u5_cox(spark, sf):
    """Coefficients of the hazard of a next purchase."""
    return survival.fit_cox(_training(spark, sf), "duration", "event", _FEATURES).coefficients(spark)


@query()
def u5_cox_late_entry(spark, sf):
    """Coefficients of the hazard of an award's end, with awards that were running before the window opened."""
    life = _life(spark, sf).where("drop_reason is null").join(table(spark, sf, "contracts").select("contract_award_unique_key", F.log1p(F.greatest(F.coalesce("award_amount", F.lit(0.0)), F.lit(0.0))).alias("size"), (F.col("segment") == "Defense").cast("int").alias("defense")), "contract_award_unique_key")
    days = lambda c: F.round(F.col(c) * F.lit(P.year_days))
    return survival.fit_cox(life.withColumn("a", days("entry_age")).withColumn("b", days("exit_age")), "b", "event", ["size", "defense"], entry="a").coefficients(spark)


@query()
def u6_conditional_chance(spark, sf):
    """Chance that an account buys within the horizon, given the days since its last purchase."""
    model = survival.fit_cox(_training(spark, sf), "duration", "event", _FEATURES)
    f = episodes.running_features(_episodes(spark, sf), ["maint", "hard"], ["recipient_entity_id"], P.train_cutoff)
    state = episodes.state_at(f, P.train_cutoff, _FEATURES).withColumn("later", F.col("elapsed") + P.horizon_days)
    base = model.baseline(spark)
    s = curves.step_lookup(curves.step_lookup(state, "elapsed", base, "t", "survival", 1.0, "s0"), "later", base, "t", "survival", 1.0, "s1")
    return s.select("account", "elapsed", survival.event_within(F.col("s0"), F.col("s1"), model.score()).alias("chance"))


@query()
def a30_concordance(spark, sf):
    rows = _training(spark, sf)
    model = survival.fit_cox(rows, "duration", "event", _FEATURES)
    return survival.concordance(rows.withColumn("risk", model.score()), "duration", "event", "risk")


@query(
    """WITH r AS (SELECT channel, upper(trim(psc_code)) LIKE '9%' AS said, CASE channel WHEN 'direct' THEN true WHEN 'partner' THEN false END AS t FROM contracts),
c AS (SELECT count(*) FILTER (WHERE said AND t) AS tp, count(*) FILTER (WHERE said AND NOT t) AS fp, count(*) FILTER (WHERE NOT said AND t) AS fn, count(*) FILTER (WHERE NOT said AND NOT t) AS tn, count(*) AS n FROM r WHERE said IS NOT NULL AND t IS NOT NULL)
SELECT *, (tp + tn) / n AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, (tp + fn) / n AS base_rate, greatest((tp + fn) / n, 1 - (tp + fn) / n) AS majority, (tp + tn) / n > greatest((tp + fn) / n, 1 - (tp + fn) / n) AS beats_majority FROM c"""
)
def a14_confusion(spark, sf):
    true = F.when(F.col("channel") == "direct", True).when(F.col("channel") == "partner", False)
    return metrics.confusion(table(spark, sf, "contracts"), F.upper(F.trim("psc_code")).startswith("9"), true)


# names


_NORM = f"""named AS (SELECT DISTINCT recipient_name_raw AS name FROM awards_raw WHERE recipient_name_raw IS NOT NULL),
parted AS (SELECT name, trim(regexp_replace(upper(name), '{fn.ALIASES}.*$', '', 's')) AS main,
  CASE WHEN regexp_matches(upper(name), '{fn.ALIASES}') THEN trim(regexp_extract(upper(name), '{fn.ALIASES}(.*)$', 1, 's')) END AS alias FROM named),
worded AS (SELECT *, list_filter(string_split(regexp_replace(replace(main, '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM parted),
spelled AS (SELECT *, string_split(array_to_string(list_transform(CASE WHEN ws[1] = 'THE' THEN ws[2:] ELSE ws END, lambda w: CASE w {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fn.SPELLED_OUT.items())} ELSE w END), ' '), ' ') AS ss FROM worded),
kept AS (SELECT *, list_filter(ss, lambda w: w NOT IN ({", ".join(f"'{x}'" for x in fn.SUFFIXES)})) AS ks FROM spelled),
norms AS (SELECT name, main, alias, nullif(CASE WHEN len(ks) > 0 THEN array_to_string(ks, ' ') ELSE ss[1] END, '') AS norm FROM kept)"""


@query(f"WITH {_NORM} SELECT name, main, alias, norm FROM norms")
def f2_normal_names(spark, sf):
    n = table(spark, sf, "awards_raw").where("recipient_name_raw is not null").select(F.col("recipient_name_raw").alias("name")).distinct()
    main, alias = fn.split_alias(F.col("name"))
    return n.select("name", main.alias("main"), alias.alias("alias"), fn.normal_name(F.col("name")).alias("norm"))


@query("SELECT recipient_uei, 'E-' || lpad(CAST(row_number() OVER (ORDER BY recipient_uei) AS VARCHAR), 5, '0') AS entity FROM (SELECT DISTINCT recipient_uei FROM awards_raw WHERE recipient_uei IS NOT NULL)")
def r3_numbered_entities(spark, sf):
    return resolve.numbered(table(spark, sf, "awards_raw"), "recipient_uei", "E", "entity")


@query(
    """WITH g AS (SELECT recipient_uei, recipient_name_raw, count(*) AS n, min(raw_row_id) AS p FROM awards_raw WHERE recipient_uei IS NOT NULL AND recipient_name_raw IS NOT NULL GROUP BY 1, 2)
SELECT recipient_uei, recipient_name_raw AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY recipient_uei ORDER BY n DESC, p) AS rn FROM g) WHERE rn = 1"""
)
def r5_canonical_names(spark, sf):
    return resolve.most_common(table(spark, sf, "awards_raw"), "recipient_uei", "recipient_name_raw", "raw_row_id", "canonical")


@query(
    """WITH g AS (SELECT recipient_uei, recipient_name_raw AS name, count(*) AS n FROM awards_raw WHERE recipient_uei IS NOT NULL AND recipient_name_raw IS NOT NULL GROUP BY 1, 2)
SELECT recipient_uei, count(*) AS variants, string_agg(name, ';' ORDER BY n DESC, name) AS names, CAST(sum(n) AS BIGINT) AS rows FROM g GROUP BY 1 HAVING count(*) > 1"""
)
def a34_variants(spark, sf):
    return resolve.variants(table(spark, sf, "awards_raw"), "recipient_uei", "recipient_name_raw")


@query()
def u2_resolver(spark, sf):
    """Names without an identifier resolved against those with one: exact, fuzzy within a margin, ambiguous or unresolved."""
    seen = table(spark, sf, "awards_raw").groupBy("recipient_name_raw", "recipient_uei").agg(F.min("raw_row_id").alias("id"))
    raw = settle(resolve.with_norms(seen, "recipient_name_raw").where("norm is not null"), "norms")  # each spelling once
    known = raw.where("recipient_uei is not null").groupBy("norm", F.col("recipient_uei").alias("entity")).agg(F.min("id").alias("id"))
    asked = raw.where("recipient_uei is null").groupBy("norm").agg(F.min("id").alias("id"))
    return resolve.match_names(asked.select("id", "norm"), known.select("id", "norm", "entity"))


@query(
    f"""WITH f AS (SELECT DISTINCT account_id, upper(trim(psc_code)) AS code FROM contracts WHERE channel = 'direct' AND account_id IS NOT NULL AND trim(psc_code) <> ''),
t AS (SELECT DISTINCT account_id, upper(trim(psc_code)) AS code FROM contracts WHERE channel = 'partner' AND account_id IS NOT NULL AND trim(psc_code) <> ''),
c AS (SELECT (SELECT count(*) FROM f JOIN t USING (account_id, code)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM t) AS nt)
SELECT tp, nf - tp AS fp, nt - tp AS fn, tp / nullif(nf, 0) AS precision, tp / nullif(nt, 0) AS recall FROM c"""
)
def ub_pair_sets(spark, sf):
    c = table(spark, sf, "contracts").withColumn("code", tidy_key(F.col("psc_code"))).where("account_id is not null and code is not null")
    return metrics.pair_sets(c.where("channel = 'direct'"), c.where("channel = 'partner'"), ["account_id", "code"])


@query(
    """WITH m AS (SELECT DISTINCT recipient_parent_uei AS g, recipient_uei AS u FROM awards_raw WHERE recipient_parent_uei IS NOT NULL AND recipient_uei IS NOT NULL)
SELECT x.g AS recipient_parent_uei, x.u AS a, y.u AS b FROM m x JOIN m y ON x.g = y.g AND x.u < y.u"""
)
def j14_pairs_within(spark, sf):
    return resolve.pairs_within(table(spark, sf, "awards_raw"), "recipient_parent_uei", "recipient_uei")


@query(
    """WITH a AS (SELECT recipient_uei, min(recipient_state_code) AS s FROM awards_raw WHERE recipient_uei IS NOT NULL GROUP BY 1),
b AS (SELECT recipient_parent_uei AS recipient_uei, min(recipient_state_code) AS s FROM awards_raw WHERE recipient_parent_uei IS NOT NULL GROUP BY 1)
SELECT u AS subawardee_uei, coalesce(a.s, b.s) AS state FROM (SELECT DISTINCT subawardee_uei AS u FROM subaward_report WHERE subawardee_uei IS NOT NULL) LEFT JOIN a ON a.recipient_uei = u LEFT JOIN b ON b.recipient_uei = u"""
)
def j7_first_match(spark, sf):
    raw = table(spark, sf, "awards_raw")
    own = raw.where("recipient_uei is not null").groupBy("recipient_uei").agg(F.min("recipient_state_code").alias("s"))
    parent = raw.where("recipient_parent_uei is not null").groupBy("recipient_parent_uei").agg(F.min("recipient_state_code").alias("s"))
    asked = table(spark, sf, "subaward_report").where("subawardee_uei is not null").select("subawardee_uei").distinct()
    return conform.first_match(asked, [(own, ["subawardee_uei"], ["recipient_uei"]), (parent, ["subawardee_uei"], ["recipient_parent_uei"])], "s", "state")


@query(
    """SELECT l_orderkey, l_linenumber, o_custkey, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_returnflag = 'R' AND l_shipdate >= DATE '2001-01-01'"""
)
def j4_many_to_one(spark, sf):
    rows = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber")
    o = conform.join_many_to_one(rows, table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"], "inner")
    c = o.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    return c.join(table(spark, sf, "nation"), "n_nationkey").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("l_orderkey", "l_linenumber", "o_custkey", "n_name", "r_name")


@query(
    """SELECT l_orderkey, l_linenumber, o_custkey, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def j4_every_line(spark, sf):
    """The validated join over every row of lineitem, as the reference joins; ``j4_many_to_one`` takes returned late lines only."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    o = conform.join_many_to_one(rows, table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"], "inner")
    c = o.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    return c.join(table(spark, sf, "nation"), "n_nationkey").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("l_orderkey", "l_linenumber", "o_custkey", "n_name", "r_name")


# rules


def _rules(spark, sf):
    c = table(spark, sf, "contracts")
    age = F.datediff(F.lit(P.as_of), F.to_date("base_obligation_date"))
    left = F.datediff(F.to_date("end_date"), F.lit(P.as_of))
    amount, day = F.col("award_amount"), F.unix_date(F.to_date("base_obligation_date"))
    text = lambda what: F.concat(F.col("evidence_count").cast("string"), F.lit(f" {what}, "), v.dollars(F.col("value")))
    mk = lambda code, pri, trig, what, **how: rules.Rule(code, pri, c, "account_id", trig, "contract_award_unique_key", amount, text(what), **how)
    return c, [mk("ENDS_SOON", 0, left.between(0, P.renewal_lookahead_days), "awards end within a year"), mk("RECENT_HARDWARE", 1, hardware() & age.between(0, P.shift_window_days), "hardware awards in two years", order=-day, most=8), mk("NEGATIVE_AMOUNT", 2, F.col("award_amount") < 0, "awards with a negative amount", order=amount, most=3)]


_TRIGGERS = {
    "ENDS_SOON": (0, f"date_diff('day', {AS_OF}, end_date::DATE) BETWEEN 0 AND {P.renewal_lookahead_days}", "contract_award_unique_key", 12, "awards end within a year"),
    "RECENT_HARDWARE": (1, f"psc_role IN {HARD} AND {_AGE} BETWEEN 0 AND {P.shift_window_days}", "base_obligation_date DESC, contract_award_unique_key", 8, "hardware awards in two years"),
    "NEGATIVE_AMOUNT": (2, "award_amount < 0", "award_amount, contract_award_unique_key", 3, "awards with a negative amount"),
}
_FIRED = "fired AS (" + " UNION ALL ".join(
    f"""SELECT *, CAST(evidence_count AS VARCHAR) || ' {w}, ' || CASE WHEN value < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', CAST(round_even(abs(value), 0) AS BIGINT)) AS detail FROM (
  SELECT account_id AS entity, '{c}' AS code, {p} AS priority, list(contract_award_unique_key ORDER BY {o})[1:{m}] AS ids, CAST(count(*) AS INTEGER) AS evidence_count,
    CAST(coalesce(sum({DEC}), 0) AS DOUBLE) AS value FROM contracts WHERE account_id IS NOT NULL AND {t} GROUP BY 1)"""
    for c, (p, t, o, m, w) in _TRIGGERS.items()
) + ")"


@query(f"WITH {_FIRED} SELECT entity, code, priority, 'DERIVED' AS provenance, detail, array_to_string(ids, ';') AS evidence, evidence_count, value FROM fired")
def ud_fired_rules(spark, sf):
    return rules.all_fired(_rules(spark, sf)[1])


@query(f"WITH {_FIRED}, g AS (SELECT entity, arg_min(code, priority) AS action, string_agg(code, ';' ORDER BY priority) AS codes, CAST(count(*) AS INTEGER) AS fired FROM fired GROUP BY 1) SELECT a.account_id AS entity, coalesce(action, 'NO_ACTION') AS action, coalesce(codes, '') AS codes, coalesce(g.fired, 0) AS fired FROM (SELECT DISTINCT account_id FROM contracts WHERE account_id IS NOT NULL) a LEFT JOIN g ON g.entity = a.account_id")
def u11_actions(spark, sf):
    c, rs = _rules(spark, sf)
    return rules.actions(c, "account_id", rules.all_fired(rs))


@query(f"WITH {_FIRED}, n AS (SELECT count(DISTINCT account_id) AS n FROM contracts) SELECT code, count(*) AS plays, count(*) / (SELECT n FROM n) AS share, count(*) / (SELECT n FROM n) > 0.8 AS low_information FROM fired GROUP BY 1")
def a36_selectivity(spark, sf):
    c, rs = _rules(spark, sf)
    return rules.selectivity(rules.all_fired(rs), c.agg(F.countDistinct("account_id").alias("n")).scalar())


# generated and registered


@query()
def u13_telemetry(spark, sf):
    keys = table(spark, sf, "contracts").where("account_id is not null").select("account_id", F.lit(0.5).alias("level"))
    return generate.telemetry(keys, "account_id", F.col("level"), date(2023, 10, 1), 36, P.seed)


@query()
def u13_cases(spark, sf):
    keys = table(spark, sf, "contracts").where("account_id is not null").groupBy("account_id").agg(F.count("*").alias("n"))
    return generate.cases(keys, "account_id", F.least(F.lit(0.6) + F.log10(F.col("n") + 1), F.lit(80.0)), {"S1": 0.08, "S2": 0.22, "S3": 0.42, "S4": 0.28}, P.seed)


@query(
    "SELECT account_id, strftime(m, '%Y-%m-%d') AS month FROM (SELECT DISTINCT account_id FROM contracts WHERE account_id IS NOT NULL), (SELECT unnest(generate_series(DATE '2023-10-01', DATE '2026-09-01', INTERVAL 1 MONTH)) AS m)"
)
def ue_month_frame(spark, sf):
    return generate.month_frame(table(spark, sf, "contracts"), "account_id", date(2023, 10, 1), 36).select("account_id", F.date_format("month", "yyyy-MM-dd").alias("month"))


@query("SELECT tag, count(*) AS fields FROM (VALUES " + ", ".join(f"('{next(t for t in governance.TAGS if t in f[2])}')" for f in governance.FIELDS) + ") x(tag) GROUP BY 1")
def a35_provenance_counts(spark, sf):
    return governance.tag_counts(governance.provenance(spark))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, '{d}', '{e}')" for a, b, c, d, e in governance.ASSUMPTIONS) + ") x(id, name, value, unit, basis)")
def o3_assumptions(spark, sf):
    return governance.assumptions(spark)


@query()
def k4_json_lines(spark, sf):
    return sinks.json_lines(table(spark, sf, "contracts"))
