"""Consecutive numbers in a given order, without gathering the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Cut


def numbered(rows: DataFrame, order: str, after: int, name: str) -> DataFrame:
    """The rows with ``name``: after + 1, after + 2, ... by ``order``, whose values must differ.

    Rows are range-sorted and counted by range; only the counts (one per
    partition) reach the driver. The ranges are written once, so that counts and
    numbers see the same ones.
    """
    ranged = rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    ranged = Cut(rows.sparkSession, "numbered")(ranged, "ranges")
    before, total = {}, after
    for r in sorted(ranged.groupBy("_p").count().collect()):
        before[r["_p"]], total = total, total + r["count"]
    offset = F.coalesce(*[F.when(F.col("_p") == p, F.lit(n)) for p, n in before.items()], F.lit(after))
    return ranged.withColumn(name, (offset + F.row_number().over(Window.partitionBy("_p").orderBy(order))).cast("long")).drop("_p")
