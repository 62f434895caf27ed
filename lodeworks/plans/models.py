"""Queries over models and tables that others are put together from, with an SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import values as v
from lodeworks.functions.columns import tidy_key
from lodeworks.operators import accounts, conform, curves, episodes, flows, generate, resolve, rules, survival
from lodeworks.params import DEFAULT as P
from lodeworks.plans import reference as r
from lodeworks.plans.reference import AS_OF, DEC, table
from lodeworks.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# names and identifiers


@query(
    """WITH g AS (SELECT recipient_parent_name, recipient_uei, count(*) AS n FROM awards_raw WHERE recipient_uei IS NOT NULL AND recipient_parent_name IS NOT NULL GROUP BY 1, 2)
SELECT recipient_parent_name, count(*) AS keys, string_agg(recipient_uei, ';' ORDER BY n DESC, recipient_uei) AS ids, string_agg(CAST(n AS VARCHAR), ';' ORDER BY n DESC, recipient_uei) AS counts FROM g GROUP BY 1 HAVING count(*) > 1"""
)
def u3_name_conflicts(spark, sf):
    """Parents' names that stand beside several identifiers."""
    return resolve.conflicts(table(spark, sf, "awards_raw"), "recipient_parent_name", "recipient_uei")


_FORMS = f"""{r._NORM.replace("recipient_name_raw", "recipient_parent_name")},
forms AS (SELECT DISTINCT norm, recipient_uei FROM awards_raw JOIN norms ON recipient_parent_name = name WHERE norm IS NOT NULL AND recipient_uei IS NOT NULL)"""


def _forms(spark, sf):
    names = table(spark, sf, "awards_raw").where("recipient_uei is not null and recipient_parent_name is not null").select("recipient_parent_name", "recipient_uei").distinct()
    return resolve.with_norms(names, "recipient_parent_name")


@query(f"WITH {_FORMS} SELECT norm, count(*) AS keys, string_agg(recipient_uei, ';' ORDER BY recipient_uei) AS ids FROM forms GROUP BY 1 HAVING count(*) > 1")
def u3_same_parent(spark, sf):
    """Normal forms of parents' names that several identifiers share: candidates for children of one parent."""
    return resolve.shared_forms(_forms(spark, sf), "norm", "recipient_uei")


@query(
    f"""WITH {_FORMS}, par AS (SELECT recipient_uei AS k, max(recipient_parent_uei) AS p FROM awards_raw WHERE recipient_uei IS NOT NULL AND recipient_parent_uei IS NOT NULL GROUP BY 1),
fl AS (SELECT DISTINCT x.recipient_uei AS a, y.recipient_uei AS b FROM forms x JOIN forms y ON x.norm = y.norm AND x.recipient_uei < y.recipient_uei),
fam AS (SELECT count(*) AS n FROM par GROUP BY p HAVING count(*) > 1),
m AS (SELECT count(*) AS flagged, count(*) FILTER (WHERE pa.p = pb.p) AS tp, count(*) FILTER (WHERE pa.p <> pb.p) AS fp FROM fl LEFT JOIN par pa ON pa.k = a LEFT JOIN par pb ON pb.k = b),
t AS (SELECT m.*, (SELECT count(*) FROM fam) AS families, (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM fam) AS true_pairs FROM m)
SELECT *, true_pairs - tp AS fn, tp / greatest(tp + fp, 1) AS precision, tp / greatest(true_pairs, 1) AS recall FROM t"""
)
def u4_graded(spark, sf):
    """How well shared normal forms find children of one parent, graded by the parents that were held back."""
    flagged = resolve.pairs_within(_forms(spark, sf), "norm", "recipient_uei")
    return resolve.graded(flagged, table(spark, sf, "awards_raw"), "recipient_uei", "recipient_parent_uei")


_ASKED = f"""{r._NORM}, seen AS (SELECT norm, recipient_uei, min(raw_row_id) AS id FROM awards_raw JOIN norms ON recipient_name_raw = name WHERE norm IS NOT NULL GROUP BY 1, 2),
kn AS (SELECT norm, recipient_uei, id FROM seen WHERE recipient_uei IS NOT NULL), ask AS (SELECT norm, id FROM seen WHERE recipient_uei IS NULL)"""


def _asked_and_known(spark, sf):
    raw = resolve.with_norms(table(spark, sf, "awards_raw").groupBy("recipient_name_raw", "recipient_uei").agg(F.min("raw_row_id").alias("id")), "recipient_name_raw").where("norm is not null")
    return raw.where("recipient_uei is null").groupBy("norm").agg(F.min("id").alias("id")), raw.where("recipient_uei is not null").groupBy("norm", F.col("recipient_uei").alias("entity")).agg(F.min("id").alias("id"))


@query(
    f"""WITH {_ASKED}, kw AS (SELECT DISTINCT id, unnest(string_split(norm, ' ')) AS w FROM kn), aw AS (SELECT DISTINCT id, unnest(string_split(norm, ' ')) AS w FROM ask),
rare AS (SELECT w FROM kw GROUP BY 1 HAVING count(*) <= 20) SELECT DISTINCT aw.id AS a, kw.id AS b FROM aw JOIN rare USING (w) JOIN kw USING (w)"""
)
def j15_blocked_pairs(spark, sf):
    """Names without an identifier and those with one that share a word which at most twenty have."""
    asked, known = _asked_and_known(spark, sf)
    return resolve.sharing_rare_words(asked, known, 20)


@query(
    f"""WITH {_ASKED} SELECT ask.id, CASE WHEN count(DISTINCT recipient_uei) = 1 THEN min(recipient_uei) END AS entity, CASE WHEN count(DISTINCT recipient_uei) = 1 THEN 'exact' ELSE 'ambiguous' END AS outcome
FROM ask JOIN kn ON ask.norm = kn.norm GROUP BY 1"""
)
def u2_exact_names(spark, sf):
    """Outcomes of the resolver where a name has the very normal form of a known one."""
    asked, known = _asked_and_known(spark, sf)
    return resolve.match_names(asked, known).where("score = 1.0").join(asked.join(known, "norm", "left_semi").select("id"), "id", "left_semi").select("id", "entity", "outcome")


@query(
    f"""WITH o AS (SELECT trim(coalesce(awarding_agency_name, '')) AS agency, trim(coalesce(awarding_sub_agency_code, '')) AS sub, trim(coalesce(awarding_office_code, '')) AS office, min(recipient_state_code) AS state
  FROM awards_raw WHERE award_base_action_date >= TIMESTAMP '2023-01-01' GROUP BY 1, 2, 3),

k AS (SELECT DISTINCT trim(coalesce(awarding_agency_name, '')) AS agency, trim(coalesce(awarding_sub_agency_code, '')) AS sub, trim(coalesce(awarding_office_code, '')) AS office FROM awards_raw)
SELECT k.*, o.state AS recent_state FROM k LEFT JOIN o USING (agency, sub, office)"""
)
def j6_composite_lookup(spark, sf):
    """Offices by three columns, looked up in what was awarded lately."""
    keys = ["agency", "sub", "office"]
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    raw = table(spark, sf, "awards_raw").select(text("awarding_agency_name").alias("agency"), text("awarding_sub_agency_code").alias("sub"), text("awarding_office_code").alias("office"), "recipient_state_code", "award_base_action_date")
    lately = raw.where(F.col("award_base_action_date") >= F.lit("2023-01-01").cast("timestamp_ntz"))
    return conform.first_match(raw.select(*keys).distinct(), [(lately, keys, keys)], "recipient_state_code", "recent_state")


@query(
    "SELECT contract_award_unique_key, nullif(concat_ws('|', trim(coalesce(account_id, '')), trim(coalesce(psc_code, '')), coalesce(CAST(award_fy AS VARCHAR), '')), '||') AS key FROM contracts"
)
def joined_key(spark, sf):
    return table(spark, sf, "contracts").select("contract_award_unique_key", conform.joined_key(F.col("account_id"), F.col("psc_code"), F.col("award_fy")).alias("key"))


@query("SELECT code, arg_min(coalesce(psc_role, '?'), contract_award_unique_key) AS described FROM (SELECT *, upper(trim(psc_code)) AS code FROM contracts WHERE trim(psc_code) <> '') GROUP BY 1")
def uf_first_seen(spark, sf):
    """What the first award of each code says of it."""
    c = table(spark, sf, "contracts").withColumn("code", tidy_key(F.col("psc_code"))).withColumn("role", F.coalesce("psc_role", F.lit("?")))
    return resolve.first_seen(c, "code", "role", "contract_award_unique_key", "described")


@query(
    """WITH w AS (SELECT account_id, count(*) AS n_old FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date < TIMESTAMP '2022-01-01' GROUP BY 1),
x AS (SELECT account_id, count(*) AS n_new FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date >= TIMESTAMP '2022-01-01' GROUP BY 1)
SELECT w.account_id, n_old, x.n_new FROM w LEFT JOIN x USING (account_id)"""
)
def suffixed_sides(spark, sf):
    """The same counts of two periods side by side, told apart by suffixes."""
    c = table(spark, sf, "contracts").where("account_id is not null")
    cut = F.lit("2022-01-01").cast("timestamp_ntz")
    n = lambda rows, suffix: conform.suffixed(rows.groupBy("account_id").agg(F.count("*").alias("n")), ["n"], suffix)
    return n(c.where(F.col("base_obligation_date") < cut), "_old").join(n(c.where(F.col("base_obligation_date") >= cut), "_new"), "account_id", "left")


_DIRECT, _PARTNER = ("9", "7"), ("R", "D", "M")


@query(
    f"""WITH k AS (SELECT contract_award_unique_key, upper(substr(trim(psc_code), 1, 1)) AS s, upper(sub_agency) AS n FROM contracts),
t AS (SELECT *, coalesce(n LIKE '%FLEET%' OR n LIKE '%COMMAND%', false) AS maker, coalesce(n LIKE '%OFFICE%' OR n LIKE '%SERVICE%' OR n LIKE '%COMMAND%', false) AS seller FROM k)
SELECT contract_award_unique_key, CASE WHEN seller AND NOT maker THEN 'partner' WHEN maker AND NOT seller THEN 'direct' WHEN s IN {_DIRECT} THEN 'direct' WHEN s IN {_PARTNER} THEN 'partner' ELSE 'unknown' END AS side FROM t"""
)
def two_sided_rule(spark, sf):
    """A code's sector decides, unless words of one side alone stand in the name."""
    c = table(spark, sf, "contracts")
    side = v.two_sided(F.col("sub_agency"), {"partner": ["OFFICE", "SERVICE", "COMMAND"], "direct": ["FLEET", "COMMAND"]}, F.substring(F.upper(F.trim("psc_code")), 1, 1), {"direct": _DIRECT, "partner": _PARTNER})
    return c.select("contract_award_unique_key", side.alias("side"))


@query(
    """WITH d AS (SELECT DISTINCT recipient_parent_name, recipient_name_raw FROM awards_raw WHERE recipient_parent_name IS NOT NULL AND recipient_name_raw IS NOT NULL)
SELECT *, (SELECT count(*) FROM d) AS total, (SELECT count(*) FROM d) > 200 AS capped FROM d ORDER BY recipient_parent_name, recipient_name_raw LIMIT 200"""
)
def uc_capped_pairs(spark, sf):
    """Distinct pairs of names, the first 200 of them for a page, with how many there are."""
    d = table(spark, sf, "awards_raw").where("recipient_parent_name is not null and recipient_name_raw is not null").select("recipient_parent_name", "recipient_name_raw").distinct()
    return conform.capped(d, ["recipient_parent_name", "recipient_name_raw"], 200)


# accounts


@query(
    f"""WITH d AS (SELECT DISTINCT account_id AS a, base_obligation_date::DATE AS d, CAST(year(base_obligation_date::DATE + INTERVAL 3 MONTH) AS INTEGER) AS fy FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date IS NOT NULL),
f AS (SELECT a, min(fy) AS cohort_fy, round_even(date_diff('day', max(d), {AS_OF}) / {P.month_days}, 1) AS idle FROM d GROUP BY 1),
s AS (SELECT cohort_fy, count(*) AS accounts, CAST(sum(CASE WHEN idle >= {P.dormancy_months} THEN 1 ELSE 0 END) AS BIGINT) AS dormant FROM f GROUP BY 1),
t AS (SELECT cohort_fy, fy, count(DISTINCT d.a) AS active FROM d JOIN f ON d.a = f.a GROUP BY 1, 2)
SELECT cohort_fy, accounts, dormant, fy, active, active / accounts AS rate FROM s JOIN t USING (cohort_fy)"""
)
def a16_retention(spark, sf):
    return accounts.retention(table(spark, sf, "contracts"), "account_id", "base_obligation_date", P.as_of, P.dormancy_months)


_COVERED = f"""cov AS (SELECT h.account_id, EXISTS (SELECT 1 FROM contracts m WHERE {r.KEPT} AND m.account_id = h.account_id
  AND m.base_obligation_date::DATE BETWEEN h.base_obligation_date::DATE - {P.coverage_window_days} AND h.base_obligation_date::DATE + {P.coverage_window_days}) AS covered FROM contracts h WHERE psc_role IN {r.HARD} AND h.account_id IS NOT NULL)"""
_GAPS = f"""{r._PEERS}, bought AS (SELECT DISTINCT account_id, upper(trim(psc_code)) AS code FROM contracts WHERE account_id IS NOT NULL AND trim(psc_code) <> ''),
sz AS (SELECT peer_group, count(*) AS members FROM peers GROUP BY 1), ad AS (SELECT peer_group, code, count(*) AS adopters FROM bought JOIN peers USING (account_id) GROUP BY 1, 2),
ov AS (SELECT ad.* FROM ad JOIN sz USING (peer_group) WHERE adopters / members >= {P.adoption_floor}),
gp AS (SELECT m.account_id, count(*) AS gaps FROM peers m JOIN ov USING (peer_group) WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.account_id = m.account_id AND b.code = ov.code) GROUP BY 1)"""


@query(
    f"""WITH RECURSIVE {r._CLUSTERS}, {_COVERED}, {_GAPS},
cs AS (SELECT *, count(*) OVER (PARTITION BY account_id, cluster) AS size FROM clustered),
rn AS (SELECT account_id, count(DISTINCT contract_award_unique_key) AS expiring, CAST(coalesce(sum({DEC}), 0) AS DOUBLE) AS expiring_value, min(end_date)::DATE AS next_expiry, bool_or(size > 1) AS in_cluster FROM cs GROUP BY 1),
cv AS (SELECT account_id, count(*) AS assets, CAST(sum(CAST(covered AS INTEGER)) AS BIGINT) AS covered_assets FROM cov GROUP BY 1)
SELECT peers.account_id, total, segment, coalesce(assets, 0) AS assets, coalesce(covered_assets, 0) AS covered_assets, coalesce(assets, 0) - coalesce(covered_assets, 0) AS uncovered_assets, covered_assets / nullif(assets, 0) AS coverage_rate,
  coalesce(expiring, 0) AS expiring, coalesce(expiring_value, 0) AS expiring_value, next_expiry, coalesce(in_cluster, false) AS in_cluster, coalesce(gaps, 0) AS gaps
FROM peers LEFT JOIN cv USING (account_id) LEFT JOIN rn USING (account_id) LEFT JOIN gp USING (account_id)"""
)
def a37_account_table(spark, sf):
    """Accounts with their coverage, renewals and gaps joined back."""
    from lodeworks.operators import coverage

    c, peers = r._peers(spark, sf)
    covered = coverage.covered(c.select("account_id", "base_obligation_date", "psc_role"), ["account_id"], "base_obligation_date", r.maintained(), r.hardware(), P.coverage_window_days, "covered").where("account_id is not null")
    clustered = r._clusters(spark, sf)
    sizes = clustered.groupBy("account_id", "cluster").agg(F.count("*").alias("cluster_size"))
    renewals = clustered.join(sizes, ["account_id", "cluster"]).select("account_id", F.col("contract_award_unique_key").alias("key"), F.col("award_amount").alias("amount"), F.col("end_date").alias("end"), "cluster_size")
    return accounts.with_sides(peers.select("account_id", "total", "segment"), "account_id", covered, renewals, r.a18_peer_gaps(spark, sf))


@query(
    f"""WITH {r._PRIMES}, g AS (SELECT {r._PRIME_KEY} AS key, count(*) AS subs, count(DISTINCT subaward_number) AS numbers, count(DISTINCT subawardee_uei) AS subawardees,
  CAST(coalesce(sum(CAST(subaward_amount AS DECIMAL(28,6))), 0) AS DOUBLE) AS flow FROM subaward_report WHERE coalesce(trim(prime_award_unique_key), '') <> '' GROUP BY 1)
SELECT g.*, p.award_id_piid, p.recipient_uei, p.product_or_service_code, p.awarding_office_code FROM g JOIN primes p ON p.key = g.key"""
)
def a11_whole_flows(spark, sf):
    """Flows with what the prime says of itself, and distinct sub numbers and parties."""
    carried = ["award_id_piid", "recipient_uei", "product_or_service_code", "awarding_office_code"]
    subs = table(spark, sf, "subaward_report").withColumn("key", tidy_key(F.col("prime_award_unique_key")))
    f = flows.prime_flows(subs, r._primes(spark, sf), "key", "subaward_amount", "subawardee_name", "total_obligated_amount", distinct={"numbers": "subaward_number", "subawardees": "subawardee_uei"}, carried=carried)
    return f.select("key", "subs", "numbers", "subawardees", "flow", *carried)


_RIGHT = [-1e18, 0.0, 10_000.0, 100_000.0, 1e18]


@query("SELECT CASE " + " ".join(f"WHEN award_amount > {a} AND award_amount <= {b} THEN {i}" for i, (a, b) in enumerate(zip(_RIGHT, _RIGHT[1:]))) + " END AS band, count(*) AS n FROM contracts GROUP BY 1")
def r8_right_closed(spark, sf):
    return table(spark, sf, "contracts").groupBy(v.bucket(F.col("award_amount"), _RIGHT, right=True).alias("band")).agg(F.count("*").alias("n"))


# time-to-event


_STATE = f"st AS (SELECT account, CAST(date_diff('day', max(day), DATE '{P.train_cutoff}') AS INTEGER) AS elapsed FROM eps WHERE day <= DATE '{P.train_cutoff}' GROUP BY 1)"
_BUCKET = lambda c: "CASE " + " ".join(f"WHEN {c} >= {a} AND {c} < {b} THEN {i}" for i, (a, b) in enumerate(zip(r._EDGES, r._EDGES[1:]))) + " END"


@query(
    f"""WITH {r._GAPS}, {_STATE}, few AS (SELECT * FROM gaps WHERE duration < 730), rt AS (SELECT {_BUCKET("duration")} AS b, avg(event) AS rate FROM few GROUP BY 1)
SELECT account, elapsed, coalesce(rate, (SELECT avg(event) FROM few)) AS rate FROM st LEFT JOIN rt ON rt.b = {_BUCKET("elapsed")}"""
)
def a32_rate_with_fallback(spark, sf):
    """The rate of the bucket of each account's days since; learned from short gaps, so long ones fall back to the mean."""
    state = episodes.state_at(r._episodes(spark, sf), P.train_cutoff, []).select("account", "elapsed")
    return episodes.rate_at(state, "elapsed", r._gaps(spark, sf).where("duration < 730"), r._EDGES)


_AT = lambda x: f"coalesce((SELECT CASE WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ({x} - t0) / (t1 - t0) END FROM seg WHERE {x} >= t0 AND (t1 IS NULL OR {x} < t1)), 1.0)"


@query(
    f"""WITH {r._NA}, {_STATE}, sv AS (SELECT t, exp(-cumulative) AS s FROM na), seg AS (SELECT t AS t0, lead(t) OVER (ORDER BY t) AS t1, s AS v0, lead(s) OVER (ORDER BY t) AS v1 FROM sv),
x AS (SELECT account, elapsed, {_AT("elapsed")} AS s0, {_AT(f"(elapsed + {P.horizon_days})")} AS s1 FROM st)
SELECT account, elapsed, round(greatest(0, least(1, 1 - s1 / nullif(s0, 0))), 9) AS chance FROM x"""
)
def u6_interpolated_chance(spark, sf):
    """Chance of a purchase within the horizon, from the survival curve of all gaps read between its points."""
    base = curves.nelson_aalen(r._gaps(spark, sf)).select("t", F.exp(-F.col("cumulative")).alias("survival"))
    state = episodes.state_at(r._episodes(spark, sf), P.train_cutoff, []).select("account", "elapsed").withColumn("later", F.col("elapsed") + P.horizon_days)
    s = curves.interpolated(curves.interpolated(state, "elapsed", base, "t", "survival", 1.0, "s0"), "later", base, "t", "survival", 1.0, "s1")
    return s.select("account", "elapsed", F.round(survival.event_within(F.col("s0"), F.col("s1"), F.lit(0.0)), 9).alias("chance"))


_RANK = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
_AUC = lambda c: f"(sum({c}) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)"


@query(
    f"""WITH {r._SCORED}, b AS (SELECT *, past / (past + 5.0) AS q FROM scored), k AS (SELECT *, {_RANK("p")} AS rp, {_RANK("q")} AS rq FROM b),
m AS (SELECT {_AUC("rp")} AS auc_model, {_AUC("rq")} AS auc_baseline, avg((p - y) * (p - y)) AS brier_model, avg((q - y) * (q - y)) AS brier_baseline, abs(avg(p) - avg(y)) AS mean_error FROM k)
SELECT *, CASE WHEN auc_model > auc_baseline AND brier_model < brier_baseline THEN 'model' ELSE 'baseline' END AS by_brier, CASE WHEN auc_model > auc_baseline AND mean_error <= 0.05 THEN 'model' ELSE 'baseline' END AS by_error FROM m"""
)
def u7_preferred(spark, sf):
    """Which of two scores of recency and of frequency is used, by either rule."""
    s = r._scored(spark, sf).withColumn("q", F.col("past") / (F.col("past") + 5.0))
    return survival.preferred(s, "y", "p", "q", "account")


_SWITCH = f"""tr AS (SELECT account, day, CAST(maint AS INTEGER) AS x, lead(day) OVER (PARTITION BY account ORDER BY day) AS nxt FROM eps WHERE day <= DATE '{P.train_cutoff}'),
g2 AS (SELECT greatest(CAST(date_diff('day', day, coalesce(nxt, DATE '{P.train_cutoff}')) AS DOUBLE), 0.5) AS t, CAST(nxt IS NOT NULL AS INTEGER) AS e, x FROM tr)"""


@query(
    f"""WITH RECURSIVE {r._EPISODES}, {_SWITCH},
tt AS (SELECT t, sum(e) AS d, sum(e * x) AS d1, sum(1 - x) AS n0, sum(x) AS n1 FROM g2 GROUP BY 1),
rk AS (SELECT t, d, d1, sum(n0) OVER (ORDER BY t DESC) AS r0, sum(n1) OVER (ORDER BY t DESC) AS r1 FROM tt),
lv AS (SELECT d1 / CAST(d AS DOUBLE) AS c, CAST(l AS DOUBLE) / d AS u, CAST(d AS DOUBLE) AS d, CAST(d1 AS DOUBLE) AS d1, CAST(r0 AS DOUBLE) AS r0, CAST(r1 AS DOUBLE) AS r1 FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM rk WHERE d > 0)),
fit AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS h
  UNION ALL SELECT k + 1, b + sum(c - (r1 - u * d1) * exp(b) / ((r0 - u * (d - d1)) + (r1 - u * d1) * exp(b)))
    / sum((r1 - u * d1) * exp(b) * (r0 - u * (d - d1)) / pow((r0 - u * (d - d1)) + (r1 - u * d1) * exp(b), 2)),
    sum((r1 - u * d1) * exp(b) * (r0 - u * (d - d1)) / pow((r0 - u * (d - d1)) + (r1 - u * d1) * exp(b), 2)) FROM fit, lv WHERE k < 12 GROUP BY k, b)
SELECT 'maint' AS feature, round(b, 6) AS beta, round(1 / sqrt(h), 6) AS se FROM fit WHERE k = 12"""
)
def u5_cox_switch(spark, sf):
    """The effect of one yes-or-no feature with its error, ties as Efron has them, without a ridge: SQL takes the same steps."""
    rows = episodes.gaps(r._episodes(spark, sf), P.train_cutoff)
    model = survival.fit_cox(rows, "duration", "event", ["maint"], penalty=0.0)
    return model.coefficients(spark).select("feature", F.round("beta_raw", 6).alias("beta"), F.round("se", 6).alias("se"))


@query(
    f"""WITH {r._EPISODES}, nx AS (SELECT account, day, total, lead(day) OVER (PARTITION BY account ORDER BY day) AS nxt FROM eps WHERE day <= DATE '{P.train_cutoff}'),
z AS (SELECT greatest(CAST(date_diff('day', day, coalesce(nxt, DATE '{P.train_cutoff}')) AS DOUBLE), 0.5) AS t, CAST(nxt IS NOT NULL AS INTEGER) AS e, CAST(total AS DOUBLE) AS s FROM nx),
c AS (SELECT t, e, s, count(*) AS n FROM z GROUP BY 1, 2, 3),
p AS (SELECT sum(a.n * b.n) AS pairs, sum(a.n * b.n) FILTER (WHERE a.s > b.s) AS rightly, sum(a.n * b.n) FILTER (WHERE a.s = b.s) AS tied FROM c a JOIN c b ON a.e = 1 AND (b.t > a.t OR b.t = a.t AND b.e = 0))
SELECT CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, CAST(coalesce(rightly, 0) AS BIGINT) AS "right", CAST(coalesce(tied, 0) AS BIGINT) AS tied, (coalesce(rightly, 0) + coalesce(tied, 0) / 2) / nullif(pairs, 0) AS index FROM p"""
)
def a30_size_and_pace(spark, sf):
    """Whether larger purchases are followed sooner: every pair that can be compared counts."""
    rows = episodes.gaps(r._episodes(spark, sf), P.train_cutoff).withColumn("total", F.col("total").cast("double"))
    return survival.concordance(rows, "duration", "event", "total")


# grids, registers, generated values


_VALUE = "va AS (SELECT account_id AS account, median(award_amount) AS med, CAST(sum(CAST(award_amount AS DECIMAL(28,6))) AS DOUBLE) / nullif(count(award_amount), 0) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY base_obligation_date DESC, contract_award_unique_key) AS rn FROM contracts WHERE account_id IS NOT NULL AND base_obligation_date IS NOT NULL) WHERE rn <= 5 GROUP BY 1)"


def _valued(spark, sf):
    value = r.a9_last_awards(spark, sf).select(F.col("account_id").alias("account"), "med", "mean")
    return r._scored(spark, sf).join(value, "account")


_OTHER = {"chance_of_frequency": "past / (past + 5.0) * med * 0.65 - 12000", "mean_value": "p * coalesce(mean, med) * 0.65 - 12000"}


@query(
    f"WITH {r._SCORED}, {_VALUE}, b AS (SELECT account, p * med * 0.65 - 12000 AS x, "
    + ", ".join(f"{e} AS v{i}" for i, e in enumerate(_OTHER.values()))
    + " FROM scored JOIN va USING (account)), tb AS (SELECT account FROM b WHERE x IS NOT NULL ORDER BY x DESC, account LIMIT 50) "
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS variant, (SELECT count(*) FROM b WHERE v{i} > 0) AS positive, (SELECT count(*) FROM tb JOIN (SELECT account FROM b WHERE v{i} IS NOT NULL ORDER BY v{i} DESC, account LIMIT 50) USING (account)) AS shared,
  (SELECT count(*) FROM tb JOIN (SELECT account FROM b WHERE v{i} IS NOT NULL ORDER BY v{i} DESC, account LIMIT 50) USING (account)) / 50.0 AS overlap,
  (SELECT corr(p, q) FROM (SELECT {_RANK("x")} AS p, {_RANK(f"v{i}")} AS q FROM b WHERE x IS NOT NULL AND v{i} IS NOT NULL)) AS spearman"""
        for i, n in enumerate(_OTHER)
    )
)
def u12_variants(spark, sf):
    """What another source of the chance, or the mean in place of the median, does to the order of expected values."""
    return rules.reordered(_valued(spark, sf), "account", F.expr("p * med * 0.65 - 12000"), {n: F.expr(e) for n, e in _OTHER.items()})


@query("SELECT count(DISTINCT account_id) * 36 AS rows, count(DISTINCT account_id) AS keys, CAST(count(DISTINCT account_id) > 0 AS INTEGER) * 36 AS months, 0 AS outside, true AS tagged FROM contracts WHERE account_id IS NOT NULL")
def u13_telemetry_holds(spark, sf):
    """What must hold of the generated series: a value a key and month, within its range, and its origin told."""
    t = r.u13_telemetry(spark, sf)
    return t.agg(F.count("*").alias("rows"), F.countDistinct("account_id").alias("keys"), F.countDistinct("month").cast("int").alias("months"), F.coalesce(F.sum((~F.col("utilisation").between(0.05, 0.99)).cast("int")), F.lit(0)).cast("int").alias("outside"), F.coalesce(F.min(F.col("provenance") == "GENERATED"), F.lit(True)).alias("tagged"))


_SHARES = {"S1": 0.08, "S2": 0.22, "S3": 0.42, "S4": 0.28}


def _cases(spark, sf):
    keys = table(spark, sf, "contracts").where("account_id is not null").groupBy("account_id").agg(F.count("*").alias("n"))
    return generate.cases(keys, "account_id", F.least(F.lit(0.6) + F.log10(F.col("n") + 1), F.lit(80.0)), _SHARES, P.seed, slow=("S1", "S2"))


@query("SELECT unnest(['S1', 'S2', 'S3', 'S4']) AS severity, true AS near_share, true AS positive, true AS keyed")
def u13_cases_hold(spark, sf):
    """What must hold of the generated cases: shares of severities near what was asked, hours that are not negative, keys that exist."""
    c = _cases(spark, sf)
    n = c.agg(F.count("*").alias("n")).scalar()
    share = F.coalesce(*[F.when(F.col("severity") == k, F.lit(s)) for k, s in _SHARES.items()])
    g = c.groupBy("severity").agg(F.count("*").alias("k"), F.min(F.col("hours") >= 0).alias("positive"), F.min(F.col("account_id").isNotNull()).alias("keyed"))
    return g.select("severity", (F.abs(F.col("k") / n - share) <= 5 * F.sqrt(share / n) + 0.01).alias("near_share"), "positive", "keyed")


@query("SELECT count(DISTINCT account_id) AS rows, 0 AS outside, 0 AS wrong_band FROM contracts WHERE account_id IS NOT NULL")
def u13_health_holds(spark, sf):
    """What must hold of the composite: one score a key within its range, in the band it belongs to."""
    c = table(spark, sf, "contracts").where("account_id is not null").groupBy("account_id").agg(F.max("base_obligation_date").alias("last"))
    level = r.u13_telemetry(spark, sf).groupBy("account_id").agg(F.max_by("utilisation", "month").alias("level"), (F.max_by("utilisation", "month") - F.min_by("utilisation", "month")).alias("trend"))
    load = _cases(spark, sf).groupBy("account_id").agg(F.count("*").alias("load"), F.count_if(F.col("severity").isin("S1", "S2")).alias("severe"))
    idle = accounts.months_idle(F.col("last"), P.as_of)
    h = generate.health(c.join(level, "account_id", "left").join(load, "account_id", "left"), "account_id", F.col("level"), F.col("trend"), F.col("load"), F.col("severe"), F.lit(0.5), idle >= P.dormancy_months, P.seed)
    band = F.when(F.col("score") <= 40, "at_risk").when(F.col("score") <= 60, "watch").when(F.col("score") <= 80, "stable").otherwise("strong")
    wrong = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("int")
    return h.agg(F.count("*").alias("rows"), wrong(~F.col("score").between(0, 100)).alias("outside"), wrong(~F.col("band").eqNullSafe(band)).alias("wrong_band"))


@query("SELECT contract_award_unique_key, account_id, round_even(award_amount, 6) AS award_amount, strftime(start_date, '%Y-%m-%d') AS start_day, award_fy, office_missing FROM contracts")
def k4_json_parts(spark, sf):
    """Fields read back from the lines of JSON, nulls and all."""
    lines = sinks.json_lines(table(spark, sf, "contracts"))
    parts = F.from_json("value", "contract_award_unique_key string, account_id string, award_amount double, start_date string, award_fy int, office_missing boolean").alias("j")
    return lines.select(parts).select("j.contract_award_unique_key", "j.account_id", "j.award_amount", F.col("j.start_date").alias("start_day"), "j.award_fy", "j.office_missing")


@query(f"SELECT '{date(2023, 10, 1)}'::DATE AS first_day, count(*) AS rows FROM contracts WHERE base_obligation_date >= TIMESTAMP '2023-10-01'")
def s11_pull_window(spark, sf):
    """Rows of the last window of pulls, which the edge of what may be asked for clamps."""
    from lodeworks.sources import readers

    lo, hi = readers.pull_windows(2016, 2040, 8, date(2010, 1, 1), date(2100, 1, 1))[1][0], date(2100, 1, 1)
    return table(spark, sf, "contracts").where(F.to_date("base_obligation_date").between(F.lit(lo), F.lit(hi))).agg(F.lit(lo).alias("first_day"), F.count("*").alias("rows"))
