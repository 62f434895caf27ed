"""What must hold of results, whatever the data: checked on the smallest test tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodeworks.operators import survival
from lodeworks.params import DEFAULT as P
from lodeworks.plans import governance, reference
from lodeworks.sources import sinks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
TABLES = {
    "accounts": "a37_account_table", "cohorts": "a16_retention", "clusters": "w8_cluster_summary", "episodes": "w2_running_features", "chances": "u6_conditional_chance", "plays": "ud_fired_rules",
    "actions": "u11_actions", "grid": "u12_score_grid", "flows": "a11_whole_flows", "telemetry": "u13_telemetry", "cases": "u13_cases",
}


@pytest.fixture(scope="module")
def run(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = entry.queries()[name](spark, SF).cache()
        return made[name]

    return get


@pytest.mark.parametrize("table", TABLES)
def test_every_column_of_a_table_has_an_origin(run, table):
    assert {f for t, f, _, _ in governance.FIELDS if t == table} == set(run(TABLES[table]).columns)


def test_origins_are_told_in_known_words():
    assert all(any(t in tags for t in governance.TAGS) and len(how) > 3 for _, _, tags, how in governance.FIELDS)
    assert {next(t for t in governance.TAGS if t in tags) for _, _, tags, _ in governance.FIELDS} == set(governance.TAGS)
    assert len({(t, f) for t, f, *_ in governance.FIELDS}) == len(governance.FIELDS) > 60


def test_assumptions_say_their_unit_and_basis():
    assert all(unit and len(basis) > 5 for *_, unit, basis in governance.ASSUMPTIONS) and len({a[0] for a in governance.ASSUMPTIONS}) == len(governance.ASSUMPTIONS)


def test_generated_tables_are_tagged_and_feed_no_model(run):
    assert run("u13_telemetry").where("provenance <> 'GENERATED'").count() == 0
    generated = {f for t, f, tags, _ in governance.FIELDS if tags.startswith("GENERATED")}
    assert not generated & set(reference._FEATURES) and not generated & set(run("u12_score_grid").columns)


def test_every_account_has_one_action(spark, run):
    acts = run("u11_actions")
    ids = spark.read.parquet(f"{SF}/contracts.parquet").where("account_id is not null").select("account_id").distinct()
    assert acts.count() == acts.select("entity").distinct().count() == ids.count()
    assert acts.where("action = 'NO_ACTION'").where("fired > 0").count() == 0


def test_every_play_has_evidence_and_says_why(run):
    plays = run("ud_fired_rules")
    assert plays.count() > 0 and plays.where("evidence = '' or evidence_count < 1 or length(detail) <= 10 or provenance is null").count() == 0
    assert plays.where(F.size(F.split("evidence", ";")) > F.least(F.lit(12), F.col("evidence_count"))).count() == 0


def test_identifiers_are_never_merged(run):
    n = run("r3_numbered_entities")
    assert n.count() == n.select("entity").distinct().count() == n.select("recipient_uei").distinct().count()
    assert run("u2_resolver").groupBy("id").count().where("count > 1").count() == 0
    assert run("u2_resolver").where("outcome in ('ambiguous', 'unresolved') and entity is not null").count() == 0
    assert run("u2_resolver").where("outcome = 'fuzzy' and score < 0.92").count() == 0


def test_rates_are_rates(run):
    for name, column in (("a16_retention", "rate"), ("a4_rates_by_group", "rate"), ("a37_account_table", "coverage_rate"), ("a18_peer_gaps", "adoption"), ("u6_conditional_chance", "chance"), ("u6_interpolated_chance", "chance"), ("a32_rate_with_fallback", "rate"), ("u4_graded", "precision"), ("u4_graded", "recall"), ("a30_concordance", "index")):
        assert run(name).where(~F.col(column).between(0, 1)).count() == 0, name


def test_training_is_censored_at_the_cutoff(spark, run):
    gaps, cut = run("w9_gaps"), F.lit(P.train_cutoff)
    assert gaps.where(F.col("day") > cut).count() == 0
    assert gaps.where(F.date_add("day", F.floor("duration").cast("int")) > cut).count() == 0
    assert gaps.where("event = 1").count() + gaps.where("event = 0").count() == gaps.count()
    assert gaps.where("event = 0").groupBy("account").count().where("count > 1").count() == 0  # one open gap an account
    assert run("j9_state_at").where(F.col("day") > cut).count() == 0


def test_late_entry_is_applied(run):
    life = run("u9_lifetimes").where("drop_reason is null")
    assert life.where("exit_age <= entry_age").count() == 0
    assert life.where("left_truncated and entry_age <= 0").count() == 0 and life.where("not left_truncated and entry_age > 0").count() == 0
    assert run("u9_lifetimes").where("drop_reason is not null and event is not null").count() == 0


def test_a_model_is_used_only_if_it_wins(run):
    r = run("u7_preferred").first()
    assert (r.by_brier == "model") == (r.auc_model > r.auc_baseline and r.brier_model < r.brier_baseline)
    assert (r.by_error == "model") == (r.auc_model > r.auc_baseline and r.mean_error <= 0.05)
    assert survival.prefer_model({"auc": 0.9, "brier": 0.2}, {"auc": 0.9, "brier": 0.3}) == "baseline"


def test_the_direction_of_a_baseline_is_learned_before_the_cutoff(run):
    assert all(d < P.train_cutoff for d in reference._CUTOFFS) and run("u8_age_direction").first().direction in ("oldest_first", "youngest_first")


def test_dormancy_is_told_under_several_scopes(run):
    assert run("a19_dormancy_scopes").count() >= 3


def test_a_rule_is_scored_against_the_majority(run):
    r = run("a14_confusion").first()
    assert r.beats_majority == (r.accuracy > r.majority) and r.tp + r.fp + r.fn + r.tn == r.n


def test_margins_move_no_order_but_other_values_do(run):
    grid = run("u12_score_grid")
    assert grid.groupBy("margin").agg(F.max("positive").alias("p")).where("p is null").count() == 0
    assert run("u12_variants").where(~F.col("overlap").between(0, 1)).count() == 0


def test_pages_tell_their_caps_and_their_numbers_are_numbers(spark, run):
    capped = run("uc_capped_pairs")
    assert capped.where("capped <> (total > 200)").count() == 0 and capped.count() <= 200
    assert run("k4_json_lines").where("value rlike 'NaN|Infinity'").count() == 0
    s = sinks.section(run("a37_account_table"), [F.desc("total"), F.col("account_id")], 5)
    assert s["capped"] == (s["total"] > 5) and len(s["rows"]) == min(5, s["total"])


def test_the_two_pulls_keep_their_names(run):
    assert {r.pull for r in run("s11_union_of_pulls").select("pull").collect()} <= {"psc", "naics"}


def test_periods_never_overlap(run):
    p = run("p7_found").where("kind = 'period'")
    clash = p.alias("x").join(p.alias("y"), (F.col("x.account_id") == F.col("y.account_id")) & (F.col("x.day_from") < F.col("y.day_from")) & (F.col("y.day_from") <= F.col("x.day_to")))
    assert clash.count() == 0
