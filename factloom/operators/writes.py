"""The write path as set operations: policy, protection of targets, supersession, conflicts, review, batches.

Requests are rows: client_id, scope, sensitivity, relation, source_type,
correction_status, content, source_authority, trust_score, supersede_fact_id.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_of, stemmed, tokens, words_of
from ..runtime import Cut
from .contradictions import label, shared_stems
from .keys import RUN_SCOPE, checked_scope
from .numbering import numbered
from .screens import credential_shaped, ephemeral_reason

REVIEWED = ("human_corrected", "human_confirmed")


def claims_correction() -> Column:
    """Whether a request asserts a correction by a human."""
    return F.coalesce((F.col("source_type") == "human_correction") | (F.col("relation") == "corrects") | F.col("correction_status").isin(*REVIEWED), F.lit(False))


def evaluated(requests: DataFrame, may_see_sensitive: Collection[str], may_correct: Collection[str]) -> DataFrame:
    """``requests`` with outcome and reason of the policy; null where the request may go on."""
    who = lambda names: F.coalesce(F.col("client_id").isin(*names), F.lit(False)) if names else F.lit(False)
    rules = [
        ((F.col("scope") == "secret") | (F.col("sensitivity") == "secret"), "rejected", "secret durable writes are disabled"),
        ((F.col("sensitivity") == "sensitive") & ~who(may_see_sensitive), "rejected", "sensitive durable write is not authorized"),
        (claims_correction() & ~who(may_correct), "needs_review", "client is not authorized to assert human correction"),
        (credential_shaped(F.col("content")), "rejected", "credential-shaped content"),
    ]
    decided = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(o).alias("outcome"), F.lit(r).alias("reason"))) for c, o, r in rules])
    return requests.withColumn("_d", decided).withColumns({"outcome": F.col("_d.outcome"), "reason": F.col("_d.reason")}).drop("_d")


def superseding(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """``requests`` that name a target, with why it may not be replaced, or null: protected truth is never replaced silently."""
    target = facts.select(
        F.col("fact_id").alias("supersede_fact_id"), F.col("scope").alias("_scope"), F.coalesce("source_authority", F.lit(0.5)).alias("_authority"), F.col("correction_status").alias("_status"),
        F.col("memory_kind").alias("_kind"), F.col("conflict_group").alias("_group"), F.lit(True).alias("_there"),
    )
    r = requests.where("supersede_fact_id is not null").join(target, "supersede_fact_id", "left")
    reason = (
        F.when(F.col("_there").isNull() | ~F.col("_scope").eqNullSafe(F.col("scope")), "supersession target is unavailable")
        .when(F.col("_kind") == "state", "typed state requires state-slot supersession")
        .when(F.col("_group").isNotNull(), "open-conflict members cannot be explicitly superseded")
        .when(F.col("_status").isin(*REVIEWED) & ~claims_correction(), "target is protected by human correction")
        .when(F.col("_authority") > F.coalesce("source_authority", F.lit(0.5)), "target has higher source authority")
    )
    return r.withColumn("reason", reason).drop("_scope", "_authority", "_status", "_kind", "_group", "_there")


def protected(kind: Column, status: Column, authority: Column, incoming: Column) -> Column:
    """Whether a near-duplicate may never lose implicitly: typed state, human corrections and stronger sources."""
    return F.coalesce(kind == "state", F.lit(False)) | F.coalesce(status.isin(*REVIEWED), F.lit(False)) | (F.coalesce(authority, F.lit(0.0)) > incoming)


def near_merged(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(newer, older, winner, loser): of two near-duplicates the incoming (newer) one wins by trust, then by its time, unless the other is protected."""
    cols = ["trust_score", "created_at", "memory_kind", "correction_status", "source_authority"]
    new = facts.select(F.col("fact_id").alias("newer"), *[F.col(c).alias(f"n_{c}") for c in cols])
    old = facts.select(F.col("fact_id").alias("older"), *[F.col(c).alias(f"o_{c}") for c in cols])
    r = pairs.select("newer", "older").join(new, "newer").join(old, "older")
    safe = protected(F.col("o_memory_kind"), F.col("o_correction_status"), F.col("o_source_authority"), F.coalesce("n_source_authority", F.lit(0.5)))
    t = lambda s: F.struct(F.coalesce(f"{s}_trust_score", F.lit(0.0)), F.coalesce(f"{s}_created_at", F.lit("")))
    wins = ~safe & (t("n") > t("o"))
    return r.select("newer", "older", F.when(wins, F.col("newer")).otherwise(F.col("older")).alias("winner"), F.when(wins, F.col("older")).otherwise(F.col("newer")).alias("loser"))


def superseded(facts: DataFrame, losers: DataFrame, at: str) -> DataFrame:
    """The facts with each loser (loser, winner) retired at an instant in favour of its winner; rows no longer current stay."""
    gone = losers.groupBy(F.col("loser").alias("fact_id")).agg(F.min("winner").alias("_winner"))
    live = F.col("_winner").isNotNull() & F.col("invalid_at").isNull() & F.col("superseded_by").isNull()
    r = facts.join(gone, "fact_id", "left")
    new = {"invalid_at": F.when(live, F.lit(at)).otherwise(F.col("invalid_at")), "expired_at": F.when(live, F.lit(at)).otherwise(F.col("expired_at")), "superseded_by": F.when(live, F.col("_winner")).otherwise(F.col("superseded_by"))}
    return r.select(*[new.get(c, F.col(c)).alias(c) for c in facts.columns])


def untyped_conflicts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(newer, older, conflict_id, subject_key, predicate_key): contradicting untyped claims as open conflicts, labelled by what they share.

    Of the facts a newer claim contradicts, it meets the one it shares most
    content tokens with, then the smallest identifier. Conflict identifiers
    are digests of the members.
    """
    cut = Cut(facts.sparkSession, "conflicts")
    c = lambda n: facts.select(F.col("fact_id").alias(n), F.col("content").alias(f"_{n}"))
    r = pairs.select("newer", "older").join(c("newer"), "newer").join(c("older"), "older")
    # texts are split once, and what a label is made of is written before it is made
    r = cut(r.select("newer", "older", tokens(F.col("_newer")).alias("_a"), tokens(F.col("_older")).alias("_b")), "tokens")
    shared = F.size(F.array_intersect(words_of(F.col("_a")), words_of(F.col("_b"))))
    w = Window.partitionBy("newer").orderBy(F.col("_s").desc(), "older")
    best = r.withColumn("_s", shared).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    best = cut(best.select("newer", "older", "_a", stemmed(plain_of(words_of(F.col("_b")))).alias("_r")), "best")
    best = cut(best.select("newer", "older", shared_stems(F.col("_a"), F.col("_r")).alias("_s")), "stems").withColumn("_l", label(F.col("_s")))
    key = F.concat(F.lit("conflict:"), F.substring(F.sha2(F.concat_ws(":", "older", "newer"), 256), 1, 24))
    return best.select("newer", "older", key.alias("conflict_id"), F.col("_l.subject").alias("subject_key"), F.col("_l.predicate").alias("predicate_key"))


def with_conflicts(facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The facts with both members of each open conflict in its group; missing slot keys get its labels. State rows are never members."""
    member = conflicts.select(F.explode(F.array("newer", "older")).alias("fact_id"), F.struct("conflict_id", "subject_key", "predicate_key").alias("x")).groupBy("fact_id").agg(F.min("x").alias("x"))
    can = F.col("x").isNotNull() & F.col("invalid_at").isNull() & F.col("superseded_by").isNull() & F.col("conflict_group").isNull() & ~F.col("memory_kind").eqNullSafe("state")
    r = facts.join(member, "fact_id", "left")
    new = {"conflict_group": F.when(can, F.col("x.conflict_id")).otherwise(F.col("conflict_group"))}
    new |= {k: F.when(can, F.coalesce(F.col(k), F.col(f"x.{k}"))).otherwise(F.col(k)) for k in ("subject_key", "predicate_key")}
    return r.select(*[new.get(c, F.col(c)).alias(c) for c in facts.columns])


def member_problem(members: DataFrame, facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(conflict_id, fact_id, problem): why a fact may not join an open untyped conflict, or null."""
    f = facts.select("fact_id", F.col("scope").alias("_scope"), "conflict_group", "memory_kind", "invalid_at", "superseded_by")
    c = conflicts.select("conflict_id", F.col("scope").alias("_c"), F.lit(True).alias("_open"))
    r = members.join(c, "conflict_id", "left").join(f, "fact_id", "left")
    problem = (
        F.when(F.col("_open").isNull(), "conflict does not exist or is already resolved")
        .when(~(F.col("_scope").eqNullSafe(F.col("_c")) & F.col("conflict_group").eqNullSafe(F.col("conflict_id"))), "member is not in the same scope and group")
        .when(F.col("memory_kind") == "state", "typed state must use the state conflict path")
        .when(F.col("invalid_at").isNotNull() | F.col("superseded_by").isNotNull(), "member is not current")
    )
    return r.select("conflict_id", "fact_id", problem.alias("problem"))


def resolved(facts: DataFrame, choices: DataFrame, may_resolve: Collection[str], at: str) -> DataFrame:
    """The facts after conflicts are resolved: ``choices`` (conflict_group, winner, client_id); an unauthorized client raises.

    Losers are retired in favour of the winner, their world end is its start;
    the winner leaves the group. A winner outside its group changes nothing.
    """
    who = F.col("client_id").isin(*may_resolve) if may_resolve else F.lit(False)
    checked = choices.withColumn("winner", F.when(who, F.col("winner")).otherwise(F.raise_error(F.lit("client may not resolve conflicts")).cast("long")))
    start = facts.select(F.col("fact_id").alias("winner"), F.col("conflict_group"), F.col("valid_from").alias("_start"))
    sound = checked.join(start, ["winner", "conflict_group"]).select("conflict_group", "winner", "_start")
    r = facts.join(sound, "conflict_group", "left")
    wins, loses = F.col("winner") == F.col("fact_id"), F.col("winner").isNotNull() & (F.col("winner") != F.col("fact_id")) & F.col("invalid_at").isNull()
    new = {c: F.when(loses, F.lit(at)).otherwise(F.col(c)) for c in ("invalid_at", "expired_at")}
    new["superseded_by"] = F.when(loses, F.col("winner")).otherwise(F.col("superseded_by"))
    new["valid_to"] = F.when(loses, F.col("_start")).otherwise(F.col("valid_to"))
    new["conflict_group"] = F.when(wins, F.lit(None)).otherwise(F.col("conflict_group"))
    return r.select(*[new.get(c, F.col(c)).alias(c) for c in facts.columns])


def persisted(candidates: DataFrame, at: str) -> DataFrame:
    """State candidates as they are stored: one with a closed interval is historical from its birth on."""
    closed = F.col("valid_to").isNotNull()
    return candidates.withColumns({"memory_kind": F.lit("state"), "invalid_at": F.when(closed, F.lit(at)), "created_at": F.lit(at)})


def inserted(facts: DataFrame, rows: DataFrame, order: str, at: str) -> DataFrame:
    """The facts with validated new rows: identifiers follow the greatest one in the order given; shares outside 0 to 1, empty texts and unknown scopes raise."""
    top = facts.agg(F.coalesce(F.max("fact_id"), F.lit(0))).first()[0]

    def share(name: str) -> Column:
        bad = F.raise_error(F.lit(f"{name} must lie between 0 and 1")).cast("double")
        return F.when(F.col(name).isNull() | F.col(name).between(0, 1), F.col(name)).otherwise(bad)

    text = F.when(F.trim(F.coalesce("content", F.lit(""))) != "", F.col("content")).otherwise(F.raise_error(F.lit("content is required")).cast("string"))
    new = numbered(rows, order, top, "fact_id").withColumns({"content": text, "scope": checked_scope(F.col("scope")), **{c: share(c) for c in ("trust_score", "confidence", "source_authority") if c in rows.columns}})
    new = new.withColumns({"created_at": F.lit(at), "updated_at": F.lit(at)})
    return facts.unionByName(new.select(*[c for c in facts.columns if c in new.columns]), allowMissingColumns=True)


def linked(edges: DataFrame, new: DataFrame) -> DataFrame:
    """(fact_id, entity_id): the links with new ones, each once."""
    return edges.select("fact_id", "entity_id").unionByName(new.select("fact_id", "entity_id")).distinct()


def review_rows(decided: DataFrame, at: str, order: str) -> DataFrame:
    """The review queue of requests that need one: identifier, reason, what was asked, and the instant."""
    digest = F.concat(F.lit("review:"), F.substring(F.sha2(F.concat_ws("\u0001", F.col(order).cast("string"), "content", "reason"), 256), 1, 24))
    keep = [c for c in ("scope", "content", "subject_key", "predicate_key") if c in decided.columns]
    return decided.where("outcome = 'needs_review'").select(digest.alias("review_id"), "reason", *keep, F.lit(at).alias("recorded_at"), F.lit(None).cast("string").alias("resolved_at"))


def review_page(reviews: DataFrame, scope: str, limit: int = 200, offset: int = 0, unresolved_only: bool = True) -> DataFrame:
    """One page of a scope's review rows by time, then identifier."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must lie between 1 and 200, offset must not be negative")
    rows = reviews.where(F.col("scope") == scope)
    if unresolved_only:
        rows = rows.where("resolved_at is null")
    return rows.orderBy("recorded_at", "review_id").offset(offset).limit(limit)


def promoted(facts: DataFrame, target: str, granted: Collection[str]) -> DataFrame:
    """Requests that copy current run-scoped facts onto a durable scope, with where they come from."""
    if target.startswith("run:") or target not in granted:
        raise PermissionError("the target must be a durable granted scope")
    rows = facts.where(F.col("scope").rlike(RUN_SCOPE) & F.col("invalid_at").isNull() & F.col("superseded_by").isNull())
    return rows.select(
        F.col("fact_id").alias("promoted_from_fact_id"), F.col("scope").alias("promoted_from_scope"), "content", F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("tags", F.lit("")).alias("tags"),
        "trust_score", "source_authority", F.lit(target).alias("scope"), F.coalesce("sensitivity", F.lit("normal")).alias("sensitivity"), F.lit("promotion").alias("source_type"),
        F.lit("derived_from").alias("relation"), F.concat(F.lit("fact:"), "fact_id").alias("source_uri"),
    )


def batches(decided: DataFrame, batch: str) -> DataFrame:
    """``decided`` with ``committed``: a batch is written whole, or not at all where one of its requests is rejected."""
    bad = F.max((F.col("outcome") == "rejected").cast("int")).over(Window.partitionBy(batch))
    return decided.withColumn("committed", F.coalesce(bad, F.lit(0)) == 0)


def idempotency_key(client: Column, session: Column, canonical: Column) -> Column:
    """client:session:digest of the request in canonical form."""
    return F.concat_ws(":", client, session, F.sha2(canonical, 256))


def insert_report(proposals: DataFrame, facts: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """(proposal_id, skipped): why an extracted proposal (proposal_id, content, category, tags) is not inserted, or null.

    In order: empty, credential-shaped, not durable, an exact copy of an active
    fact or of an earlier proposal, and one that would retire a fact
    (``updates``: proposal_id), which extraction may not do.
    """
    text = F.trim(F.coalesce("content", F.lit("")))
    reason = F.when(text == "", "empty").when(credential_shaped(F.concat_ws("\n", "content", "category", "tags")), "credential_shaped").otherwise(ephemeral_reason(F.col("content")))
    p = proposals.withColumns({"_t": text, "_r": reason})
    known = facts.where("invalid_at is null and superseded_by is null").select(F.trim("content").alias("_t")).where("_t != ''").distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("_t", F.col("_r").isNull()).orderBy("proposal_id"))
    r = p.withColumn("_n", first).join(known, "_t", "left")
    copy = F.col("_known").isNotNull() | (F.col("_n") > 1)
    if updates is None:
        r = r.withColumn("_u", F.lit(None).cast("boolean"))
    else:
        r = r.join(updates.select("proposal_id").distinct().withColumn("_u", F.lit(True)), "proposal_id", "left")
    return r.select("proposal_id", F.coalesce("_r", F.when(copy, "duplicate"), F.when(F.col("_u"), "refused_update")).alias("skipped"))
