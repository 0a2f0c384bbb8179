"""Sinks and filtered copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.eligibility import active, reviewed, visible


def export_partition(facts: DataFrame) -> DataFrame:
    """(fact_id, section): where a fact goes in the export: current, conflict, unreviewed, or omitted."""
    section = (
        F.when(F.col("content").isNull() | (F.col("content") == "") | F.col("invalid_at").isNotNull() | F.col("superseded_by").isNotNull(), "omitted")
        .when(F.col("conflict_group").isNotNull(), "conflict").when(~reviewed(), "unreviewed").otherwise("current")
    )
    return facts.select("fact_id", section.alias("section"))


def markdown(facts: DataFrame) -> DataFrame:
    """(section, fact_id, block): one Markdown block per exported fact."""
    f = facts.join(export_partition(facts), "fact_id").where("section != 'omitted' and coalesce(sensitivity, 'normal') = 'normal'")
    block = F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce("subject_key", F.lit("fact")), F.lit(" "), F.col("fact_id").cast("string")), F.col("content"), F.concat(F.lit("tags: "), F.col("tags")))
    return f.select("section", "fact_id", block.alias("block"))


def write_markdown(facts: DataFrame, path: str) -> None:
    """The export as text files, one folder per section."""
    markdown(facts).select("section", F.col("block").alias("value")).write.mode("overwrite").partitionBy("section").text(path)


def browse_snapshot(facts: DataFrame, scopes: list[str]) -> DataFrame:
    """A copy for browsing: active rows of normal sensitivity in allowed scopes, without internals."""
    return facts.where(active() & visible(scopes)).drop("hrr_vector", "conflict_group", "schema_version")


def write_snapshot(df: DataFrame, path: str) -> int:
    """Write, read back, and compare row counts; the number of rows."""
    df.write.mode("overwrite").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    if n != df.count():
        raise ValueError(f"{path} holds {n} rows, not those written")
    return n
