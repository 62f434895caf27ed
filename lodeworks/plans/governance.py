"""Where every field comes from, what is assumed, and the order of steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of origin, in the order in which they are looked for.
TAGS = ["SOURCED", "DERIVED", "GENERATED", "ASSUMED"]

#: Table, field, tags and how each came about, of the tables that this engine makes.
FIELDS = [
    (*name.split(), tags.strip(), how.strip())
    for name, tags, how in (
        line.split("|")
        for line in """
accounts account_id | SOURCED | awarding office as delivered
accounts segment | DERIVED from SOURCED | most frequent value, smallest among equals
accounts total | DERIVED | exact sum of award amounts
accounts assets | DERIVED | hardware awards
accounts covered_assets | DERIVED, ASSUMED window | hardware awards with a maintenance award near
accounts uncovered_assets | DERIVED, ASSUMED window | the others
accounts coverage_rate | DERIVED, ASSUMED window | covered by all
accounts expiring | DERIVED, ASSUMED look-ahead | awards that end within the look-ahead
accounts expiring_value | DERIVED, ASSUMED look-ahead | their exact sum
accounts next_expiry | SOURCED | earliest of their ends
accounts in_cluster | DERIVED, ASSUMED span | whether any ends in a cluster of several
accounts gaps | DERIVED, ASSUMED floor | codes that most peers buy and the account doesn't
cohorts cohort_fy | DERIVED | fiscal year of the first award
cohorts accounts | DERIVED | accounts of the cohort
cohorts dormant | DERIVED, ASSUMED months | accounts idle for so many months
cohorts fy | DERIVED | fiscal year
cohorts active | DERIVED | accounts of the cohort with an award in it
cohorts rate | DERIVED | active by accounts
clusters account_id | SOURCED | awarding office
clusters cluster | DERIVED, ASSUMED span | greedy clusters of ends, in order
clusters size | DERIVED | awards
clusters vendors | DERIVED | distinct recipients
clusters total | DERIVED | exact sum of amounts
clusters first_day | SOURCED | earliest end
clusters last_day | SOURCED | latest end
clusters span_days | DERIVED | days between
episodes account | SOURCED | awarding office
episodes day | SOURCED | obligation date
episodes ordinal | DERIVED | number of the episode
episodes running_total | DERIVED | amounts so far
episodes gap_before | DERIVED | days since the episode before
episodes tenure_years | DERIVED, ASSUMED length of a year | since the first
episodes mean_gap | DERIVED | span by gaps so far, the typical one for a first episode
episodes vendors_so_far | DERIVED | distinct recipients so far
episodes maint_share | DERIVED | share of episodes with maintenance
episodes log_total | DERIVED | logarithm of the running total
chances account | SOURCED | awarding office
chances elapsed | DERIVED | days since the last episode
chances chance | DERIVED | proportional hazards, given the days since
plays entity | SOURCED | awarding office
plays code | DERIVED | the rule that fired
plays priority | ASSUMED | order of the rules
plays provenance | DERIVED | origin of the rule's input
plays detail | DERIVED | what fired it, in words
plays evidence | SOURCED | first awards that fired it
plays evidence_count | DERIVED | their number
plays value | DERIVED | their exact sum
actions entity | SOURCED | awarding office
actions action | DERIVED | rule of the smallest priority number that is not generated
actions codes | DERIVED | all rules that fired
actions fired | DERIVED | their number
grid margin | ASSUMED | grid of margins
grid cost | ASSUMED | grid of costs
grid positive | DERIVED, ASSUMED margin and cost | accounts worth more than they cost
grid total | DERIVED, ASSUMED margin and cost | their sum
flows key | SOURCED | prime award
flows subs | DERIVED | subawards
flows numbers | DERIVED | distinct subaward numbers
flows subawardees | DERIVED | distinct parties
flows flow | DERIVED | exact sum of subawards
flows award_id_piid | SOURCED | the prime's identifier
flows recipient_uei | SOURCED | the prime's recipient
flows product_or_service_code | SOURCED | the prime's code
flows awarding_office_code | SOURCED | the prime's office
telemetry account_id | SOURCED | awarding office
telemetry month | GENERATED | month of the frame
telemetry utilisation | GENERATED | seeded walk and wave
telemetry provenance | GENERATED | the tag itself
cases account_id | SOURCED | awarding office
cases case_no | GENERATED | number of the case
cases severity | GENERATED | seeded draw by share
cases hours | GENERATED | seeded gamma time
""".strip().splitlines()
    )
]

#: (id, name, value, unit, basis) of what is assumed.
ASSUMPTIONS = [
    ("R-1", "month length", 30.4375, "days", "a twelfth of the mean year"),
    ("R-2", "year length", 365.25, "days", "mean year"),
    ("R-3", "coverage window", 365.0, "days", "one support year either way"),
    ("R-4", "cluster span", 90.0, "days", "a quarter"),
    ("R-5", "look-ahead", 365.0, "days", "one year"),
    ("R-6", "adoption floor", 0.40, "share", "most of a peer group"),
    ("R-7", "shift delta", 0.30, "share", "clear of noise in shares"),
    ("R-8", "session gap", 45.0, "days", "a month and a half without a purchase"),
]


def provenance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, "table_name string, field_name string, tags string, how string")


def tag_counts(registry: DataFrame) -> DataFrame:
    """(tag, fields): each field counts for the first of the tags that it names."""
    tag = F.coalesce(*[F.when(F.col("tags").contains(t), F.lit(t)) for t in TAGS])
    return registry.groupBy(tag.alias("tag")).agg(F.count("*").alias("fields"))


def tagged(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the origin of each registered field in its schema's metadata."""
    tags = {f: t for tb, f, t, _ in FIELDS if tb == table}
    return df.select(*[F.col(c).alias(c, metadata={"provenance": tags[c]}) if c in tags else F.col(c) for c in df.columns])


def assumptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASSUMPTIONS, "id string, name string, value double, unit string, basis string")


def anchored(register: DataFrame, id: str, newest: DataFrame, value: str, order: str, source: str) -> DataFrame:
    """The register with one assumption taken from the newest row of a table (greatest ``order``), its basis saying from which
    ``source``; as it was where the table has none."""
    last = newest.where(F.col(value).isNotNull()).agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))).alias("m"))
    v, o = last.select("m.v").scalar(), last.select(F.col("m.o").cast("string")).scalar()
    mine = (F.col("id") == id) & v.isNotNull()
    return register.withColumn("basis", F.when(mine, F.concat(F.lit(f"{source}, "), o)).otherwise(F.col("basis"))).withColumn("value", F.when(mine, v).otherwise(F.col("value")))


@dataclass
class Step:
    name: str
    run: Callable[[dict], object]
    critical: bool = True


@dataclass
class Pipeline:
    """Steps in order over a shared dictionary of tables; only a critical step's failure ends the run."""

    steps: list[Step]
    failed: dict[str, str] = field(default_factory=dict)

    def run(self, state: dict, start: str | None = None, only: list[str] | None = None, skip: tuple[str, ...] = (), force: bool = False) -> dict:
        """From ``start`` on, or ``only`` some steps, leaving out ``skip``; a step whose table is in ``state`` already runs only by ``force``."""
        names = [s.name for s in self.steps]
        begin = names.index(start) if start else 0
        for s in self.steps[begin:]:
            if only and s.name not in only or s.name in skip or s.name in state and not force:
                continue
            try:
                state[s.name] = s.run(state)
            except Exception as e:  # noqa: BLE001 - recorded, and raised if the step is critical
                self.failed[s.name] = f"{type(e).__name__}: {e}"
                if s.critical:
                    raise
        return state
