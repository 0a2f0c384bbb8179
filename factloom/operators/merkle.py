"""Merkle comparison of snapshots by hierarchically hashed key buckets.

A snapshot's rows fall into ``16 ** depth`` leaf buckets by the leading bits of
their key's hash. A bucket's digest is an order-free combination of its rows'
hashes, an inner node's that of its children. Two snapshots are compared from
the root down: a level's nodes are compared only below parents that differ, so
equal regions cost nothing further.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT_BITS = 4


def depth_for(rows: int, per_leaf: int = 64) -> int:
    """Levels below the root such that a leaf holds about ``per_leaf`` rows; 1 to 8 (four billion leaves)."""
    return max(1, min(8, math.ceil(math.log(max(rows, 2) / per_leaf, 1 << FANOUT_BITS)))) if rows > per_leaf else 1


def leaf(key_hash: Column, depth: int) -> Column:
    """The leaf bucket of a 64-bit key hash."""
    return F.shiftrightunsigned(key_hash, 64 - FANOUT_BITS * depth)


def leaves(rows: DataFrame, key_hash: str, depth: int) -> DataFrame:
    """(node, d1, d2, n): the leaf digests of distinct rows, over all their columns."""
    cols = rows.columns
    hashed = rows.select(leaf(F.col(key_hash), depth).alias("node"), F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(1), *cols).alias("h2"))
    return hashed.groupBy("node").agg(F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"), F.count(F.lit(1)).alias("n"))


def levels(leaf_digests: DataFrame, depth: int) -> list[DataFrame]:
    """The tree from the children of the root (index 0) down to the leaves (index depth - 1)."""
    out = [leaf_digests]
    for _ in range(depth - 1):
        below = out[0]
        out.insert(
            0,
            below.groupBy(F.shiftright("node", FANOUT_BITS).alias("node"))
            .agg(F.bit_xor(F.xxhash64("node", "d1", "n")).alias("d1"), F.bit_xor(F.xxhash64("node", "d2", "n")).alias("d2"), F.sum("n").alias("n")),
        )
    return out


def differing_leaves(old: list[DataFrame], new: list[DataFrame]) -> DataFrame:
    """(node): leaves that differ, reached only through differing ancestors."""
    parents = None
    for a, b in zip(old, new, strict=True):
        if parents is not None:
            up = F.shiftright("node", FANOUT_BITS)
            a = a.withColumn("_p", up).join(parents, "_p", "left_semi").drop("_p")
            b = b.withColumn("_p", up).join(parents, "_p", "left_semi").drop("_p")
        both = a.alias("a").join(b.alias("b"), "node", "full")
        same = F.col("a.d1").eqNullSafe(F.col("b.d1")) & F.col("a.d2").eqNullSafe(F.col("b.d2")) & F.col("a.n").eqNullSafe(F.col("b.n"))
        differ = both.where(~same).select("node")
        parents = differ.withColumnRenamed("node", "_p")
    return differ
