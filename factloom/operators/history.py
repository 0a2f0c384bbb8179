"""Problem 3: the full history of changing attributes, by Merkle comparison of snapshots.

Statements (facts with subject, predicate and value) speak about a slot
(scope, subject, predicate) from an instant on. Snapshots hold the statements
recorded up to a cutoff. Between two snapshots only slots in differing Merkle
leaves are looked at, and only those with changed rows are folded again; their
new versions are appended and the versions they replace are closed on the axis
of snapshots. Versions of unchanged slots stay.

The fold is sequential within a slot: a version lasts over consecutive
statements of equal value and ends at the next version's start or the earliest
``valid_to`` of its statements, whichever is earlier; a statement at or after
that end starts a new version. It runs over batches of sorted rows in numpy and
keeps one state between them; only runs of a value in which a ``valid_to``
occurs are walked row by row. A slot with more than ``HOT_ROWS`` rows is split
into epochs of about that many by its own quantiles of time. Epochs fold in
parallel; a value that lasts through several is carried over all of them at
once, and epochs whose incoming state turns out different are folded again
until all states agree, so no task holds a hot slot.

Defined cases: rows without subject, predicate, value, identifier or instant
are no statements; a null scope is a scope of its own; statements superseded
by another statement of the same slot and instant are ignored from the first
snapshot on that holds the other one; ties at an instant go in order of
identifier; repeated rows count once; versions without an end have an empty
``valid_to``; an empty table gives an empty history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import instant, utc_text
from ..runtime import Cut, partitions, ship
from .merkle import depth_for, differing_leaves, leaves, levels

HOT_ROWS = 100_000
#: So many hot slots may be broadcast; more are joined as Spark sees fit.
HOT_LIST = 20_000
_OPEN = 1 << 62


def statements(facts: DataFrame) -> DataFrame:
    """(s1, s2, at, fact_id, v, until, recorded, gone): compact statements; gone: when one that replaces it at its instant was recorded."""
    blank = F.regexp_replace(F.col("object_value"), r"\s+", " ")
    value = F.replace(F.lower(F.trim(blank)), F.lit("ß"), F.lit("ss"))
    slot = ("scope", "subject_key", "predicate_key")
    at = instant(F.coalesce("valid_from", "created_at"))
    rows = (
        facts.where("fact_id is not null and subject_key is not null and predicate_key is not null and object_value is not null")
        .select(
            F.xxhash64(*slot).alias("s1"), F.xxhash64(F.lit(7), *slot).alias("s2"), at.alias("at"), "fact_id", F.xxhash64(value).alias("v"),
            instant(F.col("valid_to")).alias("until"), F.coalesce(instant(F.col("created_at")), at).alias("recorded"), "superseded_by",
        )
        .where("at is not null").distinct()
    )
    replacing = rows.groupBy(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("at").alias("_at"), F.col("fact_id").alias("_id")).agg(F.min("recorded").alias("gone"))
    maybe = rows.where("superseded_by is not null and superseded_by != fact_id")
    dated = maybe.join(
        replacing, (F.col("superseded_by") == F.col("_id")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("at") == F.col("_at")), "left"
    )
    sole = rows.where("superseded_by is null or superseded_by = fact_id").withColumn("gone", F.lit(None).cast("long"))
    return sole.unionByName(dated.select(*sole.columns)).drop("superseded_by")


def snapshot(every: DataFrame, cutoff: int | None) -> DataFrame:
    """The statements recorded by a cutoff and not replaced by then; all that stand without one."""
    stands = F.col("gone").isNull()
    return (every.where(stands) if cutoff is None else every.where((F.col("recorded") <= cutoff) & (stands | (F.col("gone") > cutoff)))).drop("gone")


def _split(at, until, starts, stops) -> list[int]:
    """Where a new version begins inside runs of one value, as an earlier end has passed."""
    out = []
    for a, b in zip(starts, stops, strict=True):
        end = until[a]
        for i in range(a + 1, b):
            if at[i] >= end:
                out.append(i)
                end = until[i]
            else:
                end = min(end, until[i])
    return out


def _fold(batches):
    """Sorted rows (s1, s2, epoch, kind, at, fact_id, v, until) to versions; kind 0 is a state carried in, which reads like a statement."""
    import numpy as np
    import pyarrow as pa

    names = ["s1", "s2", "epoch", "at", "fact_id", "v", "until"]

    def rows_of(b):
        return {n: b.column(n).fill_null(_OPEN).to_numpy() if n == "until" else b.column(n).to_numpy() for n in names}

    def emit(c, at, stop, last):
        arrays = [c["s1"][at], c["s2"][at], c["epoch"][at], c["fact_id"][at], c["at"][at], stop, c["v"][at], last]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["s1", "s2", "epoch", "fact_id", "start", "stop", "v", "last"])

    open_ = None  # the version that may go on: one row of each column
    for b in batches:
        if not b.num_rows:
            continue
        c = rows_of(b)
        if open_:
            c = {n: np.concatenate([open_[n], c[n]]) for n in names}
        n = len(c["at"])
        group = np.r_[True, (c["s1"][1:] != c["s1"][:-1]) | (c["s2"][1:] != c["s2"][:-1]) | (c["epoch"][1:] != c["epoch"][:-1])]
        run = group | np.r_[True, c["v"][1:] != c["v"][:-1]]
        first = np.flatnonzero(run)
        after = np.r_[first[1:], n]
        ended = (np.minimum.reduceat(c["until"], first) < _OPEN) & (after - first > 1)
        run[_split(c["at"].tolist(), c["until"].tolist(), first[ended].tolist(), after[ended].tolist()) if ended.any() else []] = True
        first = np.flatnonzero(run)
        stop = np.minimum.reduceat(c["until"], first)
        last = np.r_[group[first[1:]], True]
        stop[:-1] = np.where(last[:-1], stop[:-1], np.minimum(stop[:-1], c["at"][first[1:]]))
        tail = first[-1:]
        open_ = {k: c[k][tail] for k in names} | {"until": stop[-1:]}
        if len(first) > 1:
            yield emit(c, first[:-1], stop[:-1], last[:-1])
    if open_:
        yield emit(open_, np.array([0]), open_["until"], np.array([True]))


_SCHEMA = "s1 long, s2 long, epoch int, fact_id long, start long, stop long, v long, last boolean"
_SUB = ["s1", "s2", "epoch"]


def _run(rows: DataFrame) -> DataFrame:
    cols = [*_SUB, "kind", "at", "fact_id", "v", "until"]
    n = partitions(rows.sparkSession)
    return rows.select(*cols).repartition(n, *_SUB).sortWithinPartitions(*_SUB, "kind", "at", "fact_id").mapInArrow(_fold, _SCHEMA)


def fold(rows: DataFrame, cut: Cut, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(s1, s2, fact_id, start, stop, v): every version of every slot; stop is null without an end."""
    plain = rows.withColumns({"epoch": F.lit(0), "kind": F.lit(1)})
    end = F.when(F.col("stop") < _OPEN, F.col("stop")).alias("stop")
    done = ["s1", "s2", "fact_id", "start", end, "v"]
    hot = cut(rows.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows), "hot")
    slots, most = hot.agg(F.count(F.lit(1)), F.max("n")).first()
    if not slots:
        return _run(plain).select(*done)
    listed = F.broadcast if slots <= HOT_LIST else lambda df: df
    epochs = -(-most // hot_rows)
    marks = [i / epochs for i in range(1, epochs)]
    bounds = cut(
        rows.join(listed(hot.select("s1", "s2")), ["s1", "s2"], "left_semi").groupBy("s1", "s2").agg(F.array_distinct(F.percentile_approx("at", marks, max(10_000, 20 * epochs))).alias("bounds")),
        "bounds",
    )
    split = plain.drop("epoch").join(listed(bounds), ["s1", "s2"], "left").withColumn(
        "epoch", F.coalesce(F.size(F.filter("bounds", lambda x: x <= F.col("at"))), F.lit(0)).cast("int")
    )
    cold = _run(split.where("bounds is null")).select(*done)
    hot_split = cut(split.where("bounds is not null").drop("bounds"), "epochs")
    folded = cut(_run(hot_split), "folded")
    w = Window.partitionBy("s1", "s2").orderBy("epoch")  # one row an epoch
    carried = None
    while True:
        ends = folded.groupBy(*_SUB).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("last"), F.struct("fact_id", "start", "stop", "v"))).alias("z")).select(*_SUB, "n", "z.*")
        # an epoch of one version that goes on with an open version of the epoch before has that one's beginning
        goes_on = (F.col("n") == 1) & (F.col("v") == F.lag("v").over(w)) & (F.lag("stop").over(w) == _OPEN)
        begin = F.last(F.when(~F.coalesce(goes_on, F.lit(False)), F.struct("fact_id", "start")), ignorenulls=True).over(w)
        nxt = ends.select("s1", "s2", F.lead("epoch").over(w).alias("epoch"), begin.alias("b"), F.col("stop").alias("until"), "v").where("epoch is not null")
        carry = cut(nxt.select("s1", "s2", "epoch", "b.fact_id", "b.start", "until", "v"), "carry")
        if carried is not None and carry.exceptAll(carried).isEmpty():
            break
        carried = carry
        states = carry.select(*_SUB, F.lit(0).alias("kind"), F.col("start").alias("at"), "fact_id", "v", "until")
        folded = cut(_run(hot_split.select(*states.columns).unionByName(states)), "folded")
    last_epoch = folded.groupBy("s1", "s2").agg(F.max("epoch").alias("final"))
    # a state handed to the next epoch is reported there
    out = folded.join(last_epoch, ["s1", "s2"]).where("not last or epoch = final")
    return cold.unionByName(out.select(*done))


def moved_slots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(s1, s2): slots with a row that only one of two snapshots holds; nulls are equal."""

    def only(a: DataFrame, b: DataFrame) -> DataFrame:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in a.columns]
        return a.alias("a").join(b.alias("b"), same, "left_anti").select("s1", "s2")

    return only(after, before).unionByName(only(before, after)).distinct()


def build(facts: DataFrame, cutoffs: list[int], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(fact_id, valid_from, valid_to, since, replaced): all versions believed at any snapshot.

    ``cutoffs``: ascending instants of the snapshots before the present one.
    ``since`` is the number of the snapshot that introduced a version,
    ``replaced`` that of the one that changed it, or null while it stands.
    """
    spark = facts.sparkSession
    ship(spark)
    cut = Cut(spark, "history")
    every = cut(statements(facts), "statements")
    total = every.count()
    depth = depth_for(total)
    history: DataFrame | None = None
    previous = snapshot(every, None).where(F.lit(False))
    tree = levels(leaves(previous, "s1", depth), depth)
    for i, cutoff in enumerate([*cutoffs, None]):
        now = snapshot(every, cutoff)
        digests = cut(leaves(now, "s1", depth), "leaves")
        new_tree = levels(digests, depth)
        if history is None:
            versions = fold(now, cut, hot_rows).withColumns({"since": F.lit(i), "replaced": F.lit(None).cast("int")})
            history = cut(versions, "versions")
        else:
            changed = cut(differing_leaves(tree, new_tree), "changed")
            here = F.shiftrightunsigned("s1", 64 - 4 * depth)
            part = now.withColumn("node", here).join(changed, "node", "left_semi").drop("node")
            before = previous.withColumn("node", here).join(changed, "node", "left_semi").drop("node")
            moved = cut(moved_slots(before, part), "slots")
            fresh = fold(part.join(moved, ["s1", "s2"], "left_semi"), cut, hot_rows).withColumns({"since": F.lit(i), "replaced": F.lit(None).cast("int")})
            fresh = cut(fresh, "fresh")
            same = ["s1", "s2", "fact_id", "start", "v", "stop"]
            stays = history.where("replaced is null").alias("h").join(
                fresh.alias("f"), [F.col(f"h.{c}").eqNullSafe(F.col(f"f.{c}")) if c == "stop" else F.col(f"h.{c}") == F.col(f"f.{c}") for c in same], "left_semi"
            ).select("s1", "s2", "fact_id", "start", F.lit(True).alias("_stays"))
            flagged = history.join(moved.withColumn("_moved", F.lit(True)), ["s1", "s2"], "left").join(stays, ["s1", "s2", "fact_id", "start"], "left")
            closed = flagged.withColumn("replaced", F.coalesce("replaced", F.when(F.col("_moved") & F.col("_stays").isNull(), F.lit(i)))).drop("_moved", "_stays")
            standing = history.where("replaced is null")
            added = fresh.join(standing.select(*same), [fresh[c].eqNullSafe(standing[c]) for c in same], "left_anti")
            history = cut(closed.select(*history.columns).unionByName(added.select(*history.columns)), "versions")
        previous, tree = now, new_tree
    return history.select("fact_id", utc_text(F.col("start")).alias("valid_from"), F.coalesce(utc_text(F.col("stop")), F.lit("")).alias("valid_to"), "since", "replaced")


def snapshot_cutoffs(facts: DataFrame, share: float = 0.9) -> list[int]:
    """One earlier snapshot: the instant by which ``share`` of the rows were recorded."""
    at = facts.agg(F.percentile_approx(instant(F.col("created_at")), share, 1000)).first()[0]
    return [] if at is None else [int(at)]


def current_versions(facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """p3_found: the versions that stand after comparing the earlier snapshot with the present one."""
    return build(facts, snapshot_cutoffs(facts), hot_rows).where("replaced is null").select("fact_id", "valid_from", "valid_to")
