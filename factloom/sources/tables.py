"""Readers for the parquet tables.

A table is one file or a folder of files. Readers select no rows and infer
nothing: the parquet footer carries the schema, and pruning happens where a
query selects its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``folder``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
