"""Transitions of durable jobs as pure functions of a snapshot, an owner and an explicit clock.

Queue rows: id, payload_hash, created, attempts, status (pending, processing,
dead), not_before, lease_owner, lease_until, last_error, proposal_json.
Embedding jobs: job_id, fact_id, document_identity, content_sha256, status
(pending, processing, completed, dead_letter), attempts, available_at,
lease_token. All instants are seconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .screens import credential_shaped

# Parts of messages that mean a quota, delays in seconds, the greatest age of a row, and the longest payload in bytes.
QUOTA = ("429", "usage_limit_reached", "usage_limit", "rate limit", "quota")
QUOTA_FALLBACK = 1800
MAX_AGE = 48 * 3600
AGE_NOTE = " (dead: 48h age cap)"
MAX_PAYLOAD = 12 * 1024
ERROR_CODES = ("timeout", "rate_limited", "invalid_response", "provider_unavailable", "credential_shaped", "oversized", "lease_lost", "invalid_envelope")


def quota_error(message: Column) -> Column:
    """Whether a failure is the provider's limit, not the row's fault."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for p in QUOTA:
        out |= low.contains(p)
    return out


def quota_delay(message: Column, now: int, jitter: int = 60) -> Column:
    """Seconds until a quota opens again, as the message says; a fixed time where it says nothing. ``jitter`` is given, not drawn."""
    text = F.coalesce(message, F.lit(""))
    said = F.regexp_extract(text, r"(?i)resets_in_seconds\D{0,12}(\d+)", 1)
    at = F.regexp_extract(text, r"(?i)resets_at\D{0,12}(\d{9,12})", 1)
    return (
        F.when(said != "", said.cast("long") + jitter).when(at != "", F.greatest(F.lit(0).cast("long"), at.cast("long") - now) + jitter).otherwise(F.lit(QUOTA_FALLBACK).cast("long"))
    )


def safe_error(code: Column) -> Column:
    """The error code where it is one of the known ones."""
    return F.when(code.isin(*ERROR_CODES), code).otherwise("internal_error")


def fenced(owner: str, until: int | None = None) -> Column:
    """Rows that an owner holds, in the very lease it was given where that is named."""
    held = (F.col("status") == "processing") & F.col("lease_owner").eqNullSafe(owner)
    return held if until is None else held & F.col("lease_until").eqNullSafe(F.lit(until))


def _changed(queue: DataFrame, when: Column, new: dict[str, Column]) -> DataFrame:
    return queue.select(*[F.when(when, new[c]).otherwise(F.col(c)).cast(queue.schema[c].dataType).alias(c) if c in new else F.col(c) for c in queue.columns])


def done(queue: DataFrame, ids: DataFrame, owner: str, until: int | None = None) -> DataFrame:
    """The queue without finished rows; only the holder of the lease can finish one."""
    return queue.join(ids.select("id").join(queue.where(fenced(owner, until)).select("id"), "id"), "id", "left_anti").select(*queue.columns)


def failed(queue: DataFrame, failures: DataFrame, owner: str, now: int, most: int = 5) -> DataFrame:
    """The queue after failures (id, error): a quota reschedules without an attempt, others count; old rows die either way."""
    f = failures.select("id", F.substring(F.coalesce("error", F.lit("")), 1, 500).alias("_e"))
    r = queue.join(f, "id", "left")
    hit = F.col("_e").isNotNull() & fenced(owner)
    old, quota = F.lit(now) - F.col("created") > MAX_AGE, quota_error(F.col("_e"))
    attempts = F.col("attempts") + F.when(quota, 0).otherwise(1)
    dead = old | (~quota & (attempts >= most))
    new = {
        "attempts": attempts, "status": F.when(dead, "dead").otherwise("pending"), "last_error": F.concat("_e", F.when(old, AGE_NOTE).otherwise("")), "lease_owner": F.lit(None), "lease_until": F.lit(None),
        "not_before": F.when(quota & ~old, F.lit(now) + quota_delay(F.col("_e"), now)).when(quota, F.lit(None)).otherwise(F.col("not_before")),
    }
    return _changed(r, hit, new).select(*queue.columns)


def released(queue: DataFrame, ids: DataFrame, owner: str, until: int | None = None) -> DataFrame:
    """The queue with claims given back, no attempt counted."""
    r = queue.join(ids.select("id", F.lit(True).alias("_x")), "id", "left")
    return _changed(r, F.col("_x").isNotNull() & fenced(owner, until), {"status": F.lit("pending"), "lease_owner": F.lit(None), "lease_until": F.lit(None)}).select(*queue.columns)


def saved(queue: DataFrame, proposals: DataFrame, owner: str) -> DataFrame:
    """The queue with parsed proposals (id, n, content) kept, screened, and only the first time."""
    good = proposals.where(~credential_shaped(F.col("content")))
    j = good.groupBy("id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n", "content"))), lambda x: F.struct(x.content.alias("content")))).alias("_p"))
    every = proposals.select("id").distinct().join(j, "id", "left").select("id", F.coalesce("_p", F.lit("[]")).alias("_p"))
    r = queue.join(every, "id", "left")
    return _changed(r, F.col("_p").isNotNull() & fenced(owner), {"proposal_json": F.coalesce("proposal_json", "_p")}).select(*queue.columns)


def claimed(queue: DataFrame, owner: str, now: int, n: int, lease: int = 300, most: int = 5) -> DataFrame:
    """The queue after a claim: exhausted rows die first, then the oldest due ones are leased and their attempt is counted."""
    waiting = (F.col("status") == "pending") & (F.coalesce("not_before", F.lit(0)) <= now)
    lapsed = (F.col("status") == "processing") & (F.coalesce("lease_until", F.lit(0)) <= now)
    due = waiting | lapsed
    first = queue.where(due & (F.col("attempts") < most)).orderBy("created", "id").limit(n).select("id", F.lit(True).alias("_mine"))
    r = queue.join(F.broadcast(first), "id", "left")  # at most n rows
    mine, spent = F.col("_mine").isNotNull(), due & (F.col("attempts") >= most)
    new = {
        "status": F.when(mine, "processing").otherwise("dead"), "attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "lease_owner": F.when(mine, F.lit(owner)), "lease_until": F.when(mine, F.lit(now + lease)),
    }
    return _changed(r, mine | spent, new).select(*queue.columns)


def drained(queue: DataFrame, now: int, n: int) -> DataFrame:
    """The next rows of a run that takes at most ``n``, oldest first."""
    due = ((F.col("status") == "pending") & (F.coalesce("not_before", F.lit(0)) <= now)) | ((F.col("status") == "processing") & (F.coalesce("lease_until", F.lit(0)) <= now))
    return queue.where(due).orderBy("created", "id").limit(n)


def kept_hashes(queue: DataFrame) -> DataFrame:
    """The queue with the hash of the first active row of each payload; later ones and finished ones have none."""
    active = F.col("status").isin("pending", "processing")
    n = F.row_number().over(Window.partitionBy("payload_hash", active).orderBy("id"))
    return queue.withColumn("_n", n).withColumn("payload_hash", F.when(active & (F.col("_n") == 1), F.col("payload_hash"))).drop("_n")


def envelopes(payloads: DataFrame) -> DataFrame:
    """(id, envelope, reason): payloads (id, payload) decoded as version 1 envelopes; others are set aside with a reason."""
    shape = "version int, client_id string, session_id string, transcript string"
    e = F.from_json("payload", shape)
    reason = (
        F.when(F.octet_length("payload") > MAX_PAYLOAD, "oversized").when(F.try_parse_json(F.concat(F.lit("["), "payload", F.lit("]"))).isNull() | ~F.ltrim("payload").startswith("{"), "legacy_payload").when(~F.col("e.version").eqNullSafe(1), "unsupported_version")
        .when(F.coalesce(F.trim("e.client_id"), F.lit("")) == "", "missing_client").when(F.coalesce(F.trim("e.session_id"), F.lit("")) == "", "missing_session")
        .when(F.coalesce(F.trim("e.transcript"), F.lit("")) == "", "missing_transcript")
    )
    return payloads.withColumn("e", e).select("id", F.when(reason.isNull(), F.col("e")).alias("envelope"), reason.alias("reason"))


def enqueued(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """(n, payload_hash, id, accepted): envelopes (n, client_id, session_id, transcript) in canonical form; a replay gets the row that stands for it.

    Longer transcripts keep their end; the row of a new payload is numbered by ``n``.
    """
    from .extraction import canonical_sha256

    text = F.when(F.length("transcript") > MAX_PAYLOAD, F.substring("transcript", -MAX_PAYLOAD, MAX_PAYLOAD)).otherwise(F.col("transcript"))
    c = incoming.withColumns({"transcript": text, "version": F.lit(1)}).withColumn("payload_hash", canonical_sha256("client_id", "session_id", "transcript", "version"))
    live = queue.where(F.col("status").isin("pending", "processing") & F.col("payload_hash").isNotNull()).groupBy("payload_hash").agg(F.min("id").alias("_id"))
    first = F.min("n").over(Window.partitionBy("payload_hash"))
    r = c.withColumn("_first", first).join(live, "payload_hash", "left")
    return r.select("n", "payload_hash", F.col("_id").alias("id"), F.col("_first").alias("stands_for"), (F.col("_id").isNull() & (F.col("n") == F.col("_first"))).alias("accepted"))


def capture_state(meta: DataFrame) -> DataFrame:
    """One row of what key-value rows (key, value) say of automatic capture: opted in, paused, and so on or off."""
    at = lambda k: F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit("0")) == "1"
    return meta.agg(at("capture.enabled").alias("enabled"), at("capture.paused").alias("paused")).withColumn("active", F.col("enabled") & ~F.col("paused"))


def with_setting(meta: DataFrame, key: str, value: str) -> DataFrame:
    """Key-value rows with one key set."""
    new = meta.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return meta.where(F.col("key") != key).select("key", "value").unionByName(new)


# ---- embedding jobs -----------------------------------------------------------------------------

def digest(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def _inactive(f: str = "") -> Column:
    return F.col(f + "invalid_at").isNotNull() | F.col(f + "superseded_by").isNotNull() | F.col(f + "conflict_group").isNotNull()


def backfill(facts: DataFrame, vectors: DataFrame, jobs: DataFrame, identity: str, dim: int, now: int) -> DataFrame:
    """The jobs with one for each active fact without a vector: new ones pending, completed ones revived, dead ones left."""
    have = vectors.where((F.col("embedding_identity") == identity) & (F.col("dim") == dim)).select("fact_id").distinct()
    need = facts.where(~_inactive()).join(have, "fact_id", "left_anti").select("fact_id", digest(F.col("content")).alias("_sha"))
    r = jobs.join(need.withColumn("document_identity", F.lit(identity)), ["fact_id", "document_identity"], "full")
    new = F.col("status").isNull()
    back = F.col("_sha").isNotNull() & (new | (F.col("status") == "completed"))
    return r.select(
        "fact_id", "document_identity", F.when(back, F.col("_sha")).otherwise(F.col("content_sha256")).alias("content_sha256"), F.when(back, "pending").otherwise(F.col("status")).alias("status"),
        F.when(back, 0).otherwise(F.col("attempts")).cast("int").alias("attempts"), F.when(back, F.lit(now)).otherwise(F.col("available_at")).cast("long").alias("available_at"), F.when(back, F.lit(None)).otherwise(F.col("lease_token")).cast("string").alias("lease_token"),
    )


def settled(claimed_jobs: DataFrame, facts: DataFrame, results: DataFrame, now: int, most: int = 5) -> DataFrame:
    """(fact_id, outcome, status, content_sha256, available_at): claimed jobs after their model calls.

    ``results``: (fact_id, sha, error): the digest of the text that was embedded,
    or what went wrong. Facts that are gone or inactive are skipped, those that
    changed meanwhile wait again, failures wait 2 ** attempts seconds up to 300
    or are dead letters.
    """
    f = facts.select("fact_id", digest(F.col("content")).alias("_now"), _inactive().alias("_off"))
    r = claimed_jobs.join(f, "fact_id", "left").join(results, "fact_id", "left")
    outcome = (
        F.when(F.coalesce("_off", F.lit(True)), F.when(F.col("sha").isNull() & F.col("error").isNull(), "skipped_inactive").otherwise("skipped_stale"))
        .when(F.col("error").isNotNull(), F.when(F.col("attempts") >= most, "dead_letter").otherwise("pending"))
        .when(F.col("sha").isNull(), "requeued_active").when(F.col("sha") != F.col("_now"), "requeued_changed").otherwise("embedded")
    )
    r = r.withColumn("outcome", outcome)
    waits = F.col("outcome").isin("pending", "requeued_active", "requeued_changed")
    delay = F.when(F.col("outcome") == "pending", F.least(F.lit(300), F.pow(F.lit(2), F.col("attempts")).cast("int"))).otherwise(0)
    return r.select(
        "fact_id", "outcome", F.when(waits, "pending").when(F.col("outcome") == "dead_letter", "dead_letter").otherwise("completed").alias("status"),
        F.when(F.col("outcome").isin("requeued_active", "requeued_changed", "embedded"), F.col("_now")).otherwise(F.col("content_sha256")).alias("content_sha256"), F.when(waits, F.lit(now) + delay).cast("long").alias("available_at"),
    )
