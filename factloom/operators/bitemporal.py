"""Backfill of the two time axes, chains of replacement, and slot histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import instant
from .components import components


def backfilled(facts: DataFrame) -> DataFrame:
    """(fact_id, valid_to, expired_at): missing ends copied from known clocks, never invented.

    A retired row's world end is its successor's start where that is known;
    its transaction end is its retirement.
    """
    successor = facts.select(F.col("fact_id").alias("_id"), F.col("valid_from").alias("_start"))
    joined = facts.join(successor, facts.superseded_by == F.col("_id"), "left")
    retired = F.col("invalid_at").isNotNull() & F.col("superseded_by").isNotNull()
    return joined.select(
        "fact_id",
        F.coalesce("valid_to", F.when(retired, F.col("_start"))).alias("valid_to"),
        F.coalesce("expired_at", F.when(retired, F.col("invalid_at"))).alias("expired_at"),
    )


def chains(facts: DataFrame) -> DataFrame:
    """(fact_id, chain_id): facts linked by superseded_by in either direction; links to missing facts are ignored."""
    links = facts.where("superseded_by is not null and superseded_by != fact_id").select(F.col("fact_id").alias("a"), F.col("superseded_by").alias("b"))
    known = links.join(facts.select(F.col("fact_id").alias("b")), "b", "left_semi").select("a", "b")
    return components(known, "a", "b").withColumnsRenamed({"node": "fact_id", "root": "chain_id"})


def chain_history(facts: DataFrame) -> DataFrame:
    """Each chain's facts in order of their raw creation text, then identifier."""
    rows = chains(facts).join(facts.select("fact_id", "created_at", "superseded_by"), "fact_id")
    w = Window.partitionBy("chain_id").orderBy(F.col("created_at").asc_nulls_first(), "fact_id")
    return rows.withColumn("position", F.row_number().over(w)).select("chain_id", "position", "fact_id", "superseded_by")


def slot_history(facts: DataFrame) -> DataFrame:
    """Every typed slot's rows in text order of valid_from, else created_at, then identifier."""
    slot = ["scope", "subject_key", "predicate_key"]
    w = Window.partitionBy(*slot).orderBy(F.coalesce("valid_from", "created_at").asc_nulls_first(), "fact_id")
    rows = facts.where("subject_key is not null and predicate_key is not null")
    return rows.withColumn("position", F.row_number().over(w)).select(*slot, "position", "fact_id", "object_value")


def lww_intervals(facts: DataFrame) -> DataFrame:
    """Last writer wins: each state row valid from its instant to the next row's of its slot."""
    slot = ["scope", "subject_key", "predicate_key"]
    at = instant(F.coalesce("valid_from", "created_at"))
    rows = facts.where("memory_kind = 'state' and subject_key is not null and predicate_key is not null and object_value is not null").withColumn("at", at).where("at is not null")
    w = Window.partitionBy(*slot).orderBy("at", "fact_id")
    return rows.select(*slot, "fact_id", "at", F.lead("at").over(w).alias("until"))
