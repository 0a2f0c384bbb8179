"""Typed state slots: current values, duplicates, conflicts, and the write fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import instant
from .eligibility import active

SLOT = ["scope", "subject_key", "predicate_key"]
_SLOTTED = "memory_kind = 'state' and subject_key is not null and predicate_key is not null"


def current_state(facts: DataFrame) -> DataFrame:
    """Active state rows with an open interval."""
    return facts.where(_SLOTTED).where(active() & F.col("valid_to").isNull())


def believed_state(facts: DataFrame) -> DataFrame:
    """State rows not expired; retired ones only with a known world end."""
    return facts.where(_SLOTTED).where(F.col("expired_at").isNull() & (F.col("invalid_at").isNull() | F.col("valid_to").isNotNull()))


def read_current(facts: DataFrame) -> DataFrame:
    """(slot, n, value): the one current value of a slot, null where several disagree."""
    g = current_state(facts).groupBy(*SLOT).agg(F.count(F.lit(1)).alias("n"), F.min("object_value").alias("lo"), F.max("object_value").alias("hi"))
    return g.select(*SLOT, "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"))


def duplicate_current(facts: DataFrame) -> DataFrame:
    """Slots with more than one current row, and their identifiers as a text."""
    g = current_state(facts).groupBy(*SLOT).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("fact_id")).alias("ids"))
    return g.where("n > 1").select(*SLOT, "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("fact_ids"))


def conflicting_slots(facts: DataFrame) -> DataFrame:
    """Slots whose current rows state more than one value."""
    norm = F.lower(F.trim("object_value"))
    g = current_state(facts).groupBy(*SLOT).agg(F.countDistinct(norm).alias("values"), F.min("fact_id").alias("first_fact_id"))
    return g.where("values > 1")


def write_log(facts: DataFrame) -> DataFrame:
    """The state facts as an ordered log of writes: (seq, slot, value, content, authority, start, stop)."""
    rows = facts.where(_SLOTTED).where("object_value is not null")
    return rows.select(
        F.col("fact_id").alias("seq"), F.coalesce("scope", F.lit("private")).alias("scope"), "subject_key", "predicate_key", F.col("object_value").alias("value"), F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("source_authority", F.lit(0.5)).alias("authority"), instant(F.col("valid_from")).alias("start"), instant(F.col("valid_to")).alias("stop"),
    )


FOLD_SCHEMA = (
    "scope string, subject_key string, predicate_key string, seq long, action string, target long, value string, start long, stop long, status string, conflict boolean"
)


def _overlaps(a0, a1, b0, b1) -> bool:
    return (a1 is None or b0 is None or b0 < a1) and (b1 is None or a0 is None or a0 < b1)


def decide(write: dict, rows: list[dict]) -> tuple[str, int | None]:
    """(action, target) of one write against a slot's believed rows, in order of their numbers.

    add, dedup, supersede, supersede_all (every open member) or conflict. Rows
    are current or closed; a current row may be a member of an open conflict.
    """
    current = [r for r in rows if r["status"] == "current"]
    near = [r for r in rows if _overlaps(write["start"], write["stop"], r["start"], r["stop"])]
    if not current and not near:
        return "add", None
    start, authority = write["start"], write["authority"]
    exact = next((r for r in current or near if r["content"] == write["content"] or (write["value"] is not None and r["value"] == write["value"])), None)
    if len(current) > 1 or any(r["conflict"] for r in current):
        wins = start is not None and all(
            authority >= r["authority"] and (r["start"] is None or start > r["start"] or (start == r["start"] and authority > r["authority"])) for r in current
        )
        if wins or authority > max(r["authority"] for r in current):
            return "supersede_all", None
        return "conflict", exact["seq"] if exact else None
    if exact:
        return "dedup", exact["seq"]
    if not near:
        return "add", None
    target = near[0]
    older = target["start"] is not None and (start is None or start < target["start"])
    newer = start is not None and (target["start"] is None or start > target["start"])
    if (authority > target["authority"] and not older) or (authority == target["authority"] and newer):
        return "supersede", target["seq"]
    return "conflict", target["seq"]


def apply_write(write: dict, rows: list[dict]) -> tuple[str, int | None, list[dict]]:
    """(action, target, rows no longer believed): decides one write and brings the believed rows up to date in place."""
    action, target = decide(write, rows)
    if action == "dedup":
        return action, target, []
    row = {**write, "conflict": False, "status": "current" if write["stop"] is None else "closed"}
    gone = []
    if action in ("supersede", "supersede_all"):
        for r in rows:
            if r["seq"] == target if action == "supersede" else r["status"] == "current":
                r["status"], r["conflict"] = "superseded", False
                r["stop"] = write["start"] if r["stop"] is None else r["stop"]
                gone.append(r)
        rows[:] = [r for r in rows if r["status"] != "superseded"]
    elif action == "conflict":
        row["conflict"] = True
        open_ = [r for r in rows if r["status"] == "current"]
        for r in open_:
            r["conflict"] = r["conflict"] or len(open_) > 1 or r["seq"] == target
    rows.append(row)
    return action, target, gone


def _result(row: dict) -> dict:
    return {n: row[n] for n in ("scope", "subject_key", "predicate_key", "seq", "action", "target", "value", "start", "stop", "status", "conflict")}


def fold_stream(log):
    """A final row for each write of one slot's ordered log, as soon as it is final; only believed rows are kept."""
    rows: list[dict] = []
    for w in log:
        before = dict(w)
        action, target, gone = apply_write(before, rows)
        for r in gone:
            yield _result(r)
        if action == "dedup":
            yield _result({**w, "action": action, "target": target, "status": "dropped", "conflict": False})
        else:
            rows[-1] |= {"action": action, "target": target}
    for r in rows:
        yield _result(r)


def fold_rows(log: list[dict]) -> list[dict]:
    """The whole log of one slot: a decision and a final row for each write, in order."""
    return sorted(fold_stream(sorted(log, key=lambda w: w["seq"])), key=lambda r: r["seq"])


def fold(log: DataFrame) -> DataFrame:
    """The write fold of every slot. Slots are independent, and the order within one is (seq).

    Writes stream through sorted partitions, and a slot's state is its believed
    rows: a current one or the members of a conflict, and closed ones. A
    decision depends on all before it in its slot, so one slot is one sequence;
    its length costs time in one task, but not memory.
    """
    from itertools import groupby

    from ..runtime import partitions, ship

    ship(log.sparkSession)
    cols = log.columns

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in FOLD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

        def batch(got):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in got], k) for n, k in zip(names, kinds, strict=True)], names)

        writes = (r for b in batches for r in b.to_pylist())
        got: list[dict] = []
        for _, slot in groupby(writes, key=lambda r: (r["scope"], r["subject_key"], r["predicate_key"])):
            for r in fold_stream(slot):
                got.append(r)
                if len(got) == 10_000:
                    yield batch(got)
                    got = []
        if got:
            yield batch(got)

    return log.repartition(partitions(log.sparkSession), *SLOT).sortWithinPartitions(*SLOT, "seq").select(*cols).mapInArrow(run, FOLD_SCHEMA)


def fold_summary(log: DataFrame) -> DataFrame:
    """How often the fold took each action."""
    return fold(log).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def conflict_members(facts: DataFrame) -> DataFrame:
    """Members of open conflicts with their place and the conflict's size."""
    w = Window.partitionBy("conflict_group")
    rows = facts.where("conflict_group is not null")
    return rows.select(
        "conflict_group", "fact_id", "object_value", F.row_number().over(w.orderBy("fact_id")).alias("ordinal"), F.count(F.lit(1)).over(w).alias("members")
    )


def conflict_page(facts: DataFrame, scopes: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of conflicts with a visible member, in scope order."""
    order = facts.sparkSession.createDataFrame([(s, i) for i, s in enumerate(scopes)], "scope string, scope_order int")
    g = facts.where("conflict_group is not null").groupBy("conflict_group").agg(F.min("scope").alias("scope"), F.min("subject_key").alias("subject_key"), F.count(F.lit(1)).alias("members"))
    shown = facts.where(F.col("conflict_group").isNotNull() & (F.coalesce("sensitivity", F.lit("normal")) == "normal")).select("conflict_group")
    page = g.join(shown, "conflict_group", "left_semi").join(F.broadcast(order), "scope")
    return page.orderBy("scope_order", "conflict_group").offset(offset).limit(limit).select("conflict_group", "scope", "subject_key", "members")


def conflict_receipts(facts: DataFrame) -> DataFrame:
    """One line per conflict: its slot and how many members disagree."""
    g = facts.where("conflict_group is not null").groupBy("conflict_group").agg(
        F.min("subject_key").alias("s"), F.min("predicate_key").alias("p"), F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("f")
    )
    return g.select("conflict_group", F.format_string("%s %s: %d facts disagree, first %d", F.coalesce("s", F.lit("untyped")), F.coalesce("p", F.lit("claim")), "n", "f").alias("receipt"))


def resolve(facts: DataFrame) -> DataFrame:
    """Each conflict's winner (authority, then the newest, then the smallest identifier) and its losers' new columns."""
    rows = facts.where("conflict_group is not null").withColumn("_a", F.coalesce("source_authority", F.lit(0.0))).withColumn("_t", F.coalesce(instant(F.col("created_at")), F.lit(0)))
    w = Window.partitionBy("conflict_group").orderBy(F.col("_a").desc(), F.col("_t").desc(), "fact_id")
    first = F.first("fact_id").over(w)
    start = F.first("valid_from").over(w)
    return rows.select("conflict_group", "fact_id", first.alias("winner"), (F.col("fact_id") == first).alias("wins"), F.when(F.col("fact_id") != first, start).alias("new_valid_to"))
