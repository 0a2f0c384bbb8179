"""The slot fold and queue deduplication on Structured Streaming.

The batch fold and the streaming fold share ``apply_write``; fed the same log
in the same order they end in the same state. The store accepts writes in any
order of validity and resolves them by authority and valid time, so there is no
watermark and nothing is dropped as late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.slots import SLOT, apply_write
from ..runtime import ship

OUT = "scope string, subject_key string, predicate_key string, seq long, action string, target long"
STATE = "rows string"
_FIELDS = ("seq", "value", "content", "authority", "start", "stop")


def _step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
    import pandas as pd

    rows = json.loads(state.get[0]) if state.exists else []
    writes = []
    for f in frames:
        writes += f.astype(object).where(f.notna(), None).to_dict("records")
    out = []
    for w in sorted(writes, key=lambda w: w["seq"]):
        w = {k: w[k] for k in _FIELDS}
        for k in ("seq", "start", "stop"):
            w[k] = None if w[k] is None else int(w[k])
        action, target, _ = apply_write(w, rows)
        out.append((*key, w["seq"], action, target))
    state.update((json.dumps(rows),))  # believed rows only: those that can still matter
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"target": "Int64"})


def fold_stream(log: DataFrame) -> DataFrame:
    """Decisions on a stream of writes, one state per slot; within a batch writes go in order of ``seq``."""
    ship(log.sparkSession)
    return log.groupBy(*SLOT).applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def accepted_once(jobs: DataFrame, delay: str = "7 days") -> DataFrame:
    """Queue payloads accepted once: repeats of a hash within the delay are replays (``jobs`` has payload_hash and a timestamp ``at``)."""
    return jobs.withWatermark("at", delay).dropDuplicatesWithinWatermark(["payload_hash"])


def hourly_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Engine extra: tumbling hourly counts per event type, late rows admitted for the given time."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select("event_type", F.col("window.start").alias("hour"), "n", "total")
    )


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drives a bounded stream to its end into an in-memory table: for tests and small replays."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(300)
    q.stop()
    return stream.sparkSession.table(name)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends every micro-batch to a parquet table under its batch number, so that a replayed batch replaces itself."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
