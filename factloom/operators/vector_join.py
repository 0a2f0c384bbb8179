"""Pairs of near vectors, exactly, by cells around pivots.

Angles obey the triangle inequality, so two vectors within an angle t of each
other lie in cells whose pivots differ in distance to either by at most 2 t.
Each vector is held in the cell of its nearest pivot and asks in every later
cell within that bound; all other cells cannot hold a partner and are skipped.
Rows meet only within a group of equal keys. Crowded cells are cut into chunks,
so no task holds more than a chunk and those who ask there come in batches.
Within a chunk the products are matrix products.

Only groups of more than a chunk need cells: a smaller one meets in one place,
and a row without a partner of its keys is not sent at all. Where the threshold
is so low that a row would ask in more cells than a group has chunks, the large
groups are cut into chunks alone.

The pivots are a hash sample of the rows, ``ROWS_A_PIVOT`` rows each and at most
``MAX_PIVOTS`` per dimension: they go to every task, and any pivots give the
same pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Cut, partitions, ship

ROWS_A_PIVOT = 500
MAX_PIVOTS = 2048
CHUNK = 4096
SLACK = 1e-5
#: Rows compared at once with the pivots, or with a chunk: what a task holds is so many rows of angles.
TILE = 512


def _units(batch):
    """(dimension, row numbers, vectors, unit vectors) of a batch; unusable vectors are left out."""
    import numpy as np

    lists = batch.column("embedding")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    off = lists.offsets.to_numpy().astype(np.int64)
    off -= off[0]
    n = np.diff(off)
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        v = flat[off[rows][:, None] + np.arange(d)[None, :]]
        norm = np.linalg.norm(v, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        yield int(d), rows[good], v[good].astype(np.float32), v[good] / norm[good][:, None]


def _places(pivots, reach: float):
    """(group, id, cell, asks, v): a row's own cell, and the later cells where it asks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in (whole.slice(s, TILE) for whole in batches for s in range(0, whole.num_rows, TILE)):
            for d, rows, raw, v in _units(b):
                p = pivots.value.get(d)
                angle = np.arccos(np.clip(v @ p.T, -1, 1)) if p is not None else np.zeros((len(v), 1))
                own = angle.argmin(axis=1)
                near = (angle - angle[np.arange(len(v)), own][:, None] <= reach + SLACK) & (np.arange(angle.shape[1])[None, :] > own[:, None])
                r, c = np.nonzero(near)
                row, cell, asks = np.r_[np.arange(len(v)), r], np.r_[own, c], np.r_[np.zeros(len(v), bool), np.ones(len(r), bool)]
                packed = pa.array([x.tobytes() for x in raw], pa.binary())
                at = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays(
                    [b.column("grp").take(at), b.column("id").take(at), pa.array(cell.astype(np.int32)), pa.array(asks), pa.array(np.full(len(row), d, np.int32)), packed.take(pa.array(row))],
                    ["grp", "id", "cell", "asks", "d", "v"],
                )

    return run


def spanning(n: int, i, j):
    """For nodes 0 to n - 1 and edges (i, j): the smallest node each one is connected with."""
    import numpy as np

    low = np.arange(n)
    while len(i):
        m = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, low[i], m)
        np.minimum.at(low, low[j], m)
        low = low[low]
        if (low == before).all():
            break
    return low


def _compare(least: float, forest: bool = False):
    """Sorted rows of chunks, held ones first, to pairs; with ``forest`` to so many of them as connect the same rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key = ids = held = None

        def pairs(x_ids, x, y_ids, y, inside):
            plain = x.astype(np.float32)
            for s in range(0, len(y), TILE):
                sim = y[s : s + TILE].astype(np.float32) @ plain.T
                i, j = np.nonzero(sim >= least - 1e-5)
                if inside:
                    keep = y_ids[s + i] > x_ids[j]
                    i, j = i[keep], j[keep]
                if forest and len(i):
                    close = sim[i, j] < least + 1e-5
                    at = np.flatnonzero(close)
                    close[at] = np.round(np.einsum("ij,ij->i", x[j[at]], y[s + i[at]]), 6) < least
                    i, j = s + i[~close], j[~close]
                    if inside:
                        low, of = spanning(len(x), i, j), x_ids
                    else:
                        low, of = spanning(len(x) + len(y), j, len(x) + i), np.r_[x_ids, y_ids]
                    at = np.flatnonzero(low != np.arange(len(low)))
                    a, b = of[low[at]], of[at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), 1.0))], ["a", "b", "cosine"])
                elif len(i):
                    a, b = x_ids[j], y_ids[s + i]
                    exact = np.einsum("ij,ij->i", x[j], y[s + i])
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(exact)], ["a", "b", "cosine"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(n).to_numpy() for n in ("grp", "cell", "chunk", "d", "role", "id")}
            k = np.stack([cols[n].astype(np.int64) for n in ("grp", "cell", "chunk", "d", "role")], axis=1)
            edges = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            for s, e in zip(np.r_[0, edges], np.r_[edges, len(k)], strict=True):
                block, role = tuple(k[s, :4].tolist()), int(k[s, 4])
                v = np.frombuffer(b"".join(b.column("v").slice(s, e - s).to_pylist()), np.float32).reshape(e - s, -1).astype(np.float64)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                if block != key:
                    key, ids, held = block, np.empty(0, np.int64), np.empty((0, v.shape[1]))
                mine = cols["id"][s:e]
                if role == 0:  # held rows: against those before and among themselves
                    yield from pairs(ids, held, mine, v, False)
                    yield from pairs(mine, v, mine, v, True)
                    ids, held = np.r_[ids, mine], np.concatenate([held, v])
                elif len(ids):
                    yield from pairs(ids, held, mine, v, False)

    return run


def near(rows: DataFrame, keys: list[str], least: float, forest: bool = False) -> DataFrame:
    """(a, b, cosine): pairs of rows (id, embedding and ``keys``) with equal keys and a cosine of at least ``least``, each once.

    With ``forest`` only as many pairs as connect the same rows, and no cosine.
    """
    import numpy as np

    spark = rows.sparkSession
    ship(spark)
    cut = Cut(spark, "near")
    base = cut(rows.select(F.xxhash64(*keys).alias("grp"), "id", F.size("embedding").alias("d"), "embedding"), "rows")
    groups = cut(base.groupBy("grp", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    block = ["grp", "cell", "chunk", "d"]

    def compared(df: DataFrame) -> DataFrame:
        ordered = df.repartition(partitions(spark), *block).sortWithinPartitions(*block, "role").select(*block, "role", "id", "v")
        return ordered.mapInArrow(_compare(least, forest), "a long, b long, cosine double")

    few = base.join(groups.where(F.col("n") <= CHUNK).select("grp", "d"), ["grp", "d"], "left_semi").select("grp", "id", "embedding")
    none = spark.sparkContext.broadcast({})
    small = few.mapInArrow(_places(none, 0.0), "grp long, id long, cell int, asks boolean, d int, v binary").select("grp", "id", "cell", "d", "v", F.lit(0).alias("chunk"), F.lit(0).alias("role"))
    found = compared(small)
    large = groups.where(F.col("n") > CHUNK)
    sizes = {r["d"]: (r["n"], r["most"]) for r in large.groupBy("d").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}  # one row per dimension
    if sizes:
        many = cut(base.join(large.select("grp", "d"), ["grp", "d"], "left_semi").select("grp", "id", "d", "embedding"), "large")
        reach = 2 * math.acos(max(-1.0, min(1.0, least)))
        pivots = {}
        for d, (n, most) in sizes.items():
            want = min(MAX_PIVOTS, max(1, n // ROWS_A_PIVOT))
            picked = many.where(F.col("d") == d).orderBy(F.xxhash64("id", "grp")).limit(want).select("embedding").collect()
            m = np.array([r["embedding"] for r in picked], np.float64)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
            asks = (m @ m.T >= math.cos(min(reach, math.pi))).sum() / len(m)
            if asks <= max(2, most / CHUNK):
                pivots[d] = m
        placed = cut(many.drop("d").mapInArrow(_places(spark.sparkContext.broadcast(pivots), reach), "grp long, id long, cell int, asks boolean, d int, v binary"), "placed")
        cell = ["grp", "cell", "d"]
        chunks = cut(placed.where("not asks").groupBy(*cell).agg(F.count(F.lit(1)).alias("n")), "cells").where(F.col("n") > 0)
        met = placed.join(chunks.select(*cell, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), cell)
        mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
        # a held row lies in its chunk and asks in the later ones of its cell; a visitor asks in all
        to = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.sequence(mine, F.col("chunks") - 1))
        spread = met.select(*cell, "id", "v", F.posexplode(to).alias("i", "chunk"), "asks").withColumn("role", ((F.col("i") > 0) | F.col("asks")).cast("int"))
        found = found.unionByName(compared(spread))
    return found.withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") >= least)
