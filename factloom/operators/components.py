"""Connected components of an edge list, all in DataFrame joins.

Alternating large-star and small-star rounds move every node's edges to the
smallest node known so far; a node with many neighbours is never gathered,
as each star is a minimum (combined before the shuffle) and a join. Each
round is written to the shared folder, which cuts the lineage; the only
thing the driver sees of a round is a count of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Cut


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component.

    Null ends, self loops and repeated edges are ignored; an empty edge list
    gives an empty result.
    """
    cut = Cut(edges.sparkSession, "components")
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(),
        "edges",
    )
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_low, "u")
        small = (
            linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_low.select("u", F.col("m").alias("v"))).distinct()
        )
        new = cut(small, "round")
        # stars map to themselves: equal digests of two rounds' edge sets mean that all is settled
        h = F.xxhash64("u", "v")
        digest = new.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h))).first()
        done, last = digest == last, digest
        cut.drop(e)
        e = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
