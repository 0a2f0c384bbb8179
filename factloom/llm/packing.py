"""Problem 8: documents into containers of fixed capacity, by bulk-synchronous best fit.

Documents are dealt by a hash to shards of about ``SHARD`` containers, range-
sorted within them, and every shard is packed on its own, on the executors and
in parallel; the driver sees two totals. A shard's size does not grow with the
table, so neither does a task, and what a shard may leave unused (less than one
container in a thousand) does not add up to more.

Sizes are integers up to the capacity, so a shard's sorted documents and its
sorted gaps are kept as runs: (size, how many) and (gap, which containers). A
round is a sweep over both sorted run lists:

* every waiting size claims its successor, the tightest gap that holds it;
* sizes that claim the same gap are served by rank, the larger first, each
  container taking one item a round;
* served containers move to the run of their smaller gap; what is left waits
  for the next round; where no gap holds any waiting size, the largest opens
  new containers.

Sizes enter in descending bands (more than a half, a third, ... of the
capacity), so large items are placed before small ones can spoil their gaps.
The runs (size, first rank, count, first container) then place each document
by its rank within its size.

A document above the capacity is split into pieces that fill whole containers
and a rest that is packed like any other item; no other document is split.

Defined cases: null and empty texts have no tokens and lie in container 0
without using room; repeated identifiers are items of their own; ties are
broken by identifier; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Cut, partitions, ship

CAPACITY = 2048
#: Containers of a shard, about; and rows of one at most, about, for tables of many empty items.
SHARD = 16_384
SHARD_ROWS = 1 << 19
#: Containers of shard k are numbered from k * STRIDE + 1 on.
STRIDE = 1 << 40


def plan(sizes: dict[int, int], capacity: int = CAPACITY, first: int = 0) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first rank, count, first container) that place every item, and the next free container number."""
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of containers (start, count)
    sorted_gaps: list[int] = []
    waiting = {s: n for s, n in sizes.items() if n > 0}
    rank = dict.fromkeys(waiting, 0)
    next_free = first

    def add(gap: int, start: int, count: int) -> None:
        if count and gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(sorted_gaps, gap)
            gaps[gap].append((start, count))

    def take(gap: int, want: int) -> list[tuple[int, int]]:
        out = []
        have = gaps[gap]
        while want and have:
            start, count = have.pop()
            used = min(want, count)
            out.append((start, used))
            if used < count:
                have.append((start + used, count - used))
            want -= used
        if not have:
            del gaps[gap]
            sorted_gaps.pop(bisect_left(sorted_gaps, gap))
        return out

    left = sorted(waiting, reverse=True)
    while left:
        k = capacity // left[0]
        band = [s for s in left if capacity // s == k] if k < 12 else [s for s in left if s > left[0] // 2]
        while band:
            claims: dict[int, list[int]] = {}
            for s in band:  # descending: the order is the rank in which a gap's claims are served
                i = bisect_left(sorted_gaps, s)
                if i < len(sorted_gaps):
                    claims.setdefault(sorted_gaps[i], []).append(s)
            if not claims:
                s = band[0]
                fill = capacity // s
                n = -(-waiting[s] // fill)
                add(capacity, next_free, n)
                next_free += n
                continue
            moved: list[tuple[int, int, int]] = []
            for gap, who in claims.items():
                for s in who:
                    if gap not in gaps:
                        break
                    for start, count in take(gap, waiting[s]):
                        runs.append((s, rank[s], count, start))
                        rank[s] += count
                        waiting[s] -= count
                        moved.append((gap - s, start, count))
            for gap, start, count in moved:
                add(gap, start, count)
            band = [s for s in band if waiting[s]]
        left = [s for s in left if waiting[s]]
    return runs, next_free


def _packed(n, capacity: int, first: int):
    """One shard: (container, row, piece, first unit, units) of items sorted by their rest above whole containers."""
    import numpy as np

    rest, whole = n % capacity, n // capacity
    sizes, start, count = np.unique(rest, return_index=True, return_counts=True)
    rank = np.arange(len(n)) - np.repeat(start, count)
    first_whole = first + np.cumsum(whole) - whole
    runs, _ = plan(dict(zip(sizes.tolist(), count.tolist(), strict=True)) | {0: 0}, capacity, first + int(whole.sum()))
    container = np.zeros(len(n), np.int64)
    by_size: dict[int, list[tuple[int, int]]] = {}
    for s, at, _, c in sorted(runs):
        by_size.setdefault(s, []).append((at, c))
    for s, a, k in zip(sizes.tolist(), start.tolist(), count.tolist(), strict=True):
        if s:
            at, c = np.array(by_size[s]).T
            i = np.searchsorted(at, rank[a : a + k], side="right") - 1
            container[a : a + k] = c[i] + rank[a : a + k] - at[i]
    # pieces: whole containers first, then the rest (or the one empty piece of an item without units)
    reps = whole + ((rest > 0) | (n == 0))
    row = np.repeat(np.arange(len(n)), reps)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
    full = piece < whole[row]
    return np.where(full, first_whole[row] + piece, container[row]), row, piece, piece * capacity, np.where(full, capacity, rest[row])


def _shards(capacity: int):
    """Batches sorted by (shard, rest, id) to placed pieces; one shard is held at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[pa.RecordBatch] = []

        def flush():
            full = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            shard = full.column("shard")[0].as_py()
            container, row, piece, unit, units = _packed(full.column("n").to_numpy(), capacity, shard * STRIDE + 1)
            return pa.RecordBatch.from_arrays(
                [pa.array(container), full.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(unit), pa.array(units)],
                ["container_id", "id", "piece_no", "first_unit", "units"],
            )

        current = None
        for b in batches:
            shard = b.column("shard").to_numpy()
            if not len(shard):
                continue
            edges = np.flatnonzero(np.diff(shard)) + 1
            for s, e in zip(np.r_[0, edges], np.r_[edges, len(shard)], strict=True):
                if shard[s] != current:
                    if held:
                        yield flush()
                    held, current = [], shard[s]
                held.append(b.slice(s, e - s))
        if held:
            yield flush()

    return run


def pack(items: DataFrame, ident: str, size: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(container_id, ident, piece_no, first_unit, units) of every item of ``items`` (ident, size)."""
    spark = items.sparkSession
    ship(spark)
    cut = Cut(spark, "packing")
    kind = items.schema[ident].dataType.simpleString()
    base = cut(items.select(F.col(ident).alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")), "items")
    rows, units = base.agg(F.count(F.lit(1)), F.sum("n")).first()
    shards = max(1, -(-(units or 0) // (capacity * shard)), -(-rows // SHARD_ROWS))
    dealt = base.select("id", "n", F.pmod(F.xxhash64("id", "n"), F.lit(shards)).alias("shard"))
    ordered = dealt.repartition(min(shards, partitions(spark)), "shard").sortWithinPartitions("shard", F.col("n") % capacity, "id", "n")
    return ordered.mapInArrow(_shards(capacity), f"container_id long, id {kind}, piece_no int, first_unit long, units long").withColumnRenamed("id", ident)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, units, unused share, and the least number of containers that could do."""
    used = packed.where("units > 0").groupBy("container_id").agg(F.sum("units").alias("units"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("units").alias("units"), F.ceil(F.sum("units") / capacity).alias("lower_bound"), F.max("units").alias("fullest"),
    ).withColumn("unused_share", F.round(1 - F.col("units") / (F.col("containers") * capacity), 5))
