"""Rules over entities: each rule is a trigger that carries the rows that fired it; rules are ranked by priority."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.columns import exact
from lodeworks.operators.metrics import spearman, top_overlap

SCHEMA = ["entity", "code", "priority", "provenance", "detail", "evidence", "evidence_count", "value"]


@dataclass(frozen=True)
class Rule:
    """``rows`` are the rows that can fire; those that meet ``trigger`` are folded to one row per entity: evidence ids (the
    first ``most`` by ``order``, then by id), ``value`` as the exact sum of ``amount``, ``detail`` as text over (evidence_count, value)."""

    code: str
    priority: int
    rows: DataFrame
    entity: str
    trigger: Column
    evidence: str
    amount: Column
    detail: Column
    provenance: str = "DERIVED"
    most: int = 12
    #: what comes first among the evidence, ascending; the ids themselves if not given
    order: Column | None = None


def fired(rule: Rule) -> DataFrame:
    """One row per entity for which the rule fires."""
    return all_fired([rule])


def all_fired(rules: list[Rule]) -> DataFrame:
    """One row per entity and rule that fires, as one relation. ``evidence_count`` is the number of distinct non-null ids, of which
    the first stay.

    Scale: rules over the same rows are told apart in one scan of them. Ids fold on the map side and are counted; the first
    ones are found by a rank that Spark limits before it shuffles, so no list ever holds more than ``most``.
    """
    shared: dict[tuple[int, str], list[Rule]] = {}
    for r in rules:
        shared.setdefault((id(r.rows), r.entity), []).append(r)
    return reduce(DataFrame.unionByName, map(_fired_together, shared.values()))


def _fired_together(rules: list[Rule]) -> DataFrame:
    rows, entity = rules[0].rows, rules[0].entity
    order = [r.order if r.order is not None else F.lit(None).cast("int") for r in rules]
    hit = lambda r, o: F.when(r.trigger, F.struct(F.lit(r.code).alias("code"), F.col(r.evidence).cast("string").alias("id"), exact(r.amount).alias("x"), o.cast("double").alias("o")))
    hits = rows.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), F.explode(F.array_compact(F.array(*map(hit, rules, order)))).alias("h")).select("entity", "h.*")
    ids = hits.groupBy("entity", "code", "id").agg(F.sum("x").alias("x"), F.min("o").alias("o"))
    totals = ids.groupBy("entity", "code").agg(F.count("id").cast("int").alias("evidence_count"), F.coalesce(F.sum("x").cast("double"), F.lit(0.0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("entity", "code").orderBy(F.asc_nulls_last("o"), "id"))
    of = lambda what: F.coalesce(*[F.when(F.col("code") == r.code, what(r)) for r in rules])
    first = ids.where("id is not null").withColumn("rank", rank).where(F.col("rank") <= max(r.most for r in rules)).where(F.col("rank") <= of(lambda r: F.lit(r.most)))
    lists = first.groupBy("entity", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"]), ";").alias("evidence"))
    out = totals.join(lists, ["entity", "code"], "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    return out.withColumns({"priority": of(lambda r: F.lit(r.priority)), "provenance": of(lambda r: F.lit(r.provenance)), "detail": of(lambda r: r.detail)}).select(*SCHEMA)


def actions(entities: DataFrame, entity: str, plays: DataFrame, never: str = "SYNTHETIC") -> DataFrame:
    """(entity, action, codes, fired): of each entity the code with the smallest priority number, all its codes in order of
    priority, and their number. Codes of provenance ``never`` are listed but don't lead; an entity without any gets NO_ACTION."""
    lead = F.min(F.when(F.col("provenance") != never, F.struct("priority", "code")))
    g = plays.groupBy("entity").agg(lead.alias("m"), F.array_sort(F.collect_list(F.struct("priority", "code"))).alias("s"))
    g = g.select("entity", F.col("m.code").alias("action"), F.array_join(F.col("s.code"), ";").alias("codes"), F.size("s").alias("fired"))
    base = entities.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity")).distinct()
    return base.join(g, "entity", "left").select("entity", F.coalesce("action", F.lit("NO_ACTION")).alias("action"), F.coalesce("codes", F.lit("")).alias("codes"), F.coalesce("fired", F.lit(0)).alias("fired"))


def selectivity(plays: DataFrame, entities: int | Column) -> DataFrame:
    """(code, plays, share, low_information): how many entities a rule fires for; a rule that fires for over 0.8 says little."""
    g = plays.groupBy("code").agg(F.count("*").alias("plays"))
    share = F.col("plays") / (F.lit(entities) if isinstance(entities, int) else entities)
    return g.withColumn("share", share).withColumn("low_information", share > 0.8)


def reordered(scored: DataFrame, key: str, base: Column, variants: dict[str, Column], n: int = 50) -> DataFrame:
    """(variant, positive, shared, overlap, spearman): what another way to value does to the order of ``base``: how many of the ``n``
    with the greatest value stay among them (ties by key), and the rank correlation over all. A null value counts for nothing."""
    frame = scored.select(key, base.alias("_base"), *[c.alias(f"_v{i}") for i, c in enumerate(variants.values())])
    rows = []
    for i, name in enumerate(variants):
        top = top_overlap(frame, key, f"_v{i}", "_base", n)
        cor = spearman(frame, f"_v{i}", "_base")
        rows.append(top.select(F.lit(name).alias("variant"), frame.agg(F.coalesce(F.sum((F.col(f"_v{i}") > 0).cast("bigint")), F.lit(0)).alias("p")).scalar().alias("positive"), "shared", "overlap", cor.select("spearman").scalar().alias("spearman")))
    return reduce(DataFrame.unionByName, rows)


def score_grid(scored: DataFrame, chance: str, value: str, margins: list[float], costs: list[float]) -> DataFrame:
    """(margin, cost, positive, total) of chance * value * margin - cost over a grid: rows are unfolded to the grid in their
    task and folded there again, so only one row a cell leaves it."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.lit(c).alias("cost")) for m in margins for c in costs])).alias("g")
    ev = F.col(chance) * F.col(value) * F.col("g.margin") - F.col("g.cost")
    return scored.where(F.col(chance).isNotNull() & F.col(value).isNotNull()).select(chance, value, cells).withColumn("ev", ev).groupBy("g.margin", "g.cost").agg(F.sum((F.col("ev") > 0).cast("bigint")).alias("positive"), F.sum(F.when(F.col("ev") > 0, F.col("ev").try_cast("decimal(28,6)"))).cast("double").alias("total"))
