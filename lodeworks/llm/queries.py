"""Queries over names and texts, with the parameters they run with in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import leaks, names, splitting, tokens

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


# 5. variant spellings of names


def _names(spark: SparkSession, sf: str) -> DataFrame:
    awards = table(spark, sf, "awards_raw").select(F.explode(F.array("recipient_name_raw", "recipient_parent_name")).alias("name"))
    return awards.unionByName(table(spark, sf, "subaward_report").select(F.col("subawardee_name").alias("name")))


@query()
def p5_found(spark, sf):
    return names.same_entity_pairs(names.entities(_names(spark, sf)))


@query()
def p5_entities(spark, sf):
    """One row per spelling with the spelling that stands for its entity and the number of spellings linked."""
    linked = names.entities(_names(spark, sf))
    size = linked.groupBy("root").agg(F.count("*").alias("spellings"), F.min("name").alias("entity"))
    return linked.join(size, "root").select("name", "entity", "spellings")


# 8. encoding by a public tokenizer


@query()
def p8_ids(spark, sf):
    return tokens.encoded(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_round_trip(spark, sf):
    """Every text encoded and decoded again; a null text has no ids and comes back empty."""
    return tokens.decoded(p8_ids(spark, sf), "doc_id")


# 9. evaluation texts leaking into training text

_ITEMS = ("doc_id", "text", "item_id", "text")


@query()
def p9_found(spark, sf):
    return leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"), *_ITEMS).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@query()
def p9_spans(spark, sf):
    s = leaks.leaked_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items"), *_ITEMS)
    return s.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


# 10. splitting oversized items


@query()
def p10_found(spark, sf):
    return splitting.split_oversized(table(spark, sf, "documents"), "doc_id", "text").where("piece = 0").select("doc_id")


@query()
def p10_pieces(spark, sf):
    return splitting.split_oversized(table(spark, sf, "documents"), "doc_id", "text")
