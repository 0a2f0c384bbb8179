"""Equal keys into one group each, with hot keys on a path of their own.

A key's copies may be a third of all rows. Keys that hold at least one row in
``HOT_SHARE`` are found exactly from partial counts; there are at most
``HOT_SHARE`` of them, so their list may be broadcast at any input size. Their
rows are aggregated in two levels, by (key, salt) and then by key; all other
rows in one level. The representative is the smallest identifier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from one row in this many on; so at most this many keys are hot.
HOT_SHARE = 200
SALTS = 64


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k] == b[k] for k in keys))


def hot_keys(rows: DataFrame, keys: list[str], total: int, share: int = HOT_SHARE) -> DataFrame:
    """The keys with at least ``max(2, total / share)`` rows: at most ``share`` of them."""
    least = max(2, -(-total // share))
    return rows.groupBy(*keys).count().where(F.col("count") >= least).select(*keys)


def groups(rows: DataFrame, keys: list[str], ident: str, total: int, share: int = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """(groups with ``first`` and ``copies``, members with ``first``) of all keys with two or more rows.

    ``rows`` holds one row per identifier with non-null keys. Repeated
    identifiers count once each time they occur; callers remove them before.
    An empty input gives empty results.
    """
    rows = rows.select(ident, *keys)
    hot = F.broadcast(hot_keys(rows, keys, total, share).withColumn("_hot", F.lit(True)))
    flagged = rows.join(hot, keys, "left")
    cold_rows, hot_rows = flagged.where(F.col("_hot").isNull()), flagged.where(F.col("_hot"))
    agg = (F.min(ident).alias("first"), F.count(F.lit(1)).alias("copies"))
    cold = cold_rows.groupBy(*keys).agg(*agg).where(F.col("copies") > 1)
    salted = hot_rows.groupBy(*keys, F.pmod(F.xxhash64(ident), F.lit(SALTS)).alias("_salt")).agg(*agg)
    warm = salted.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("copies").alias("copies")).where(F.col("copies") > 1)
    found = cold.unionByName(warm)
    members = (
        cold_rows.select(ident, *keys).join(cold, keys).select("first", ident)
        .unionByName(hot_rows.select(ident, *keys).join(F.broadcast(warm), keys).select("first", ident))
    )
    return found, members
