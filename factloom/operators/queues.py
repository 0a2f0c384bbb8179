"""Durable work queues as pure planners over a snapshot and an explicit clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import instant

MAX_ATTEMPTS = 5
LEASE_SECONDS = 300


def jobs(observations: DataFrame) -> DataFrame:
    """A job per observation with text: what the extraction queue would hold, with a state derived from the row.

    The store keeps no queue table in the test data, so attempts, lease and
    status follow from identifier arithmetic and the recorded times.
    """
    i = F.col("observation_id")
    status = F.when(i % 11 == 0, "dead").when(i % 5 == 0, "processing").otherwise("pending")
    return observations.where("observation_content is not null and recorded_at is not null").select(
        i.alias("id"), F.col("content_sha256").alias("payload_hash"), instant(F.col("recorded_at")).alias("created"), (i % 7).cast("int").alias("attempts"),
        status.alias("status"), F.when(i % 5 == 0, instant(F.col("recorded_at")) + (i % 13) * 100).alias("lease_until"), (instant(F.col("recorded_at")) + (i % 3) * 60).alias("not_before"),
    )


def enqueue(jobs_: DataFrame) -> DataFrame:
    """First active job of every payload hash; later ones are replays of it."""
    w = Window.partitionBy("payload_hash").orderBy("id")
    live = jobs_.where(F.col("status").isin("pending", "processing"))
    return live.withColumn("n", F.row_number().over(w)).select("id", "payload_hash", (F.col("n") == 1).alias("accepted"), F.first("id").over(w).alias("existing_id"))


def due(jobs_: DataFrame, now: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs a worker may claim now: pending and due, or processing with an expired lease."""
    free = (F.col("status") == "pending") & (F.coalesce("not_before", F.lit(0)) <= now)
    expired = (F.col("status") == "processing") & (F.col("lease_until") <= now)
    return jobs_.where((F.col("attempts") < max_attempts) & (free | expired))


def claim_plan(jobs_: DataFrame, now: int, n: int) -> DataFrame:
    """The oldest ``n`` due jobs and the lease each would get."""
    return due(jobs_, now).orderBy("created", "id").limit(n).select("id", (F.col("attempts") + 1).alias("attempts"), F.lit(now + LEASE_SECONDS).cast("long").alias("lease_until"))


def after_failure(jobs_: DataFrame, now: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """State of every processing job if it failed now: retry with doubling delay up to 300 s, or dead."""
    a = F.col("attempts") + 1
    dead = a >= max_attempts
    return jobs_.where("status = 'processing'").select(
        "id", a.alias("attempts"), F.when(dead, "dead").otherwise("pending").alias("status"), F.when(~dead, F.lit(now) + F.least(F.lit(300), F.pow(F.lit(2), a).cast("int"))).cast("long").alias("not_before"),
    )


def revivable(jobs_: DataFrame) -> DataFrame:
    """The lowest dead job of every payload hash without an active twin."""
    live = jobs_.where("status != 'dead'").select("payload_hash").distinct()
    return jobs_.where("status = 'dead'").groupBy("payload_hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("dead")).join(live, "payload_hash", "left_anti")


def health(jobs_: DataFrame, now: int) -> DataFrame:
    """Counts by status, the oldest waiting age, and exhausted jobs."""
    return jobs_.groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"), F.max(F.lit(now) - F.col("created")).cast("long").alias("oldest_age"), F.count_if(F.col("attempts") >= MAX_ATTEMPTS).alias("exhausted"),
    )
