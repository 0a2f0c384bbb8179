"""Who may see which fact, and which facts are current: boolean columns over fact rows."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import instant

# Content prefixes that mark facts retired before lifecycles had columns.
RETIRED_PREFIXES = ("superseded", "stale/disabled", "historical/superseded")


def scope_predicate(scopes: Collection[str] | None) -> Column:
    """None admits every scope, an empty collection none."""
    if scopes is None:
        return F.lit(True)
    return F.col("scope").isin(*scopes) if scopes else F.lit(False)


def scope_authorized(granted: Collection[str]) -> Column:
    """Granted scopes, and any run scope for holders of private."""
    own = F.col("scope").isin(*granted) if granted else F.lit(False)
    return own | (F.col("scope").startswith("run:") & F.lit("private" in granted))


def visible(scopes: Collection[str] | None, capabilities: Collection[str] = ()) -> Column:
    """Scope, and a sensitivity that is normal or held as a capability."""
    level = F.coalesce("sensitivity", F.lit("normal"))
    return scope_predicate(scopes) & ((level == "normal") | (level.isin(*capabilities) if capabilities else F.lit(False)))


def active() -> Column:
    """Neither invalid, nor superseded, nor in a conflict."""
    return F.col("invalid_at").isNull() & F.col("superseded_by").isNull() & F.col("conflict_group").isNull()


def reviewed() -> Column:
    """Null-safe: rows without a status stay."""
    return ~F.col("correction_status").eqNullSafe("unreviewed")


def retired_by_prefix() -> Column:
    head = F.lower(F.ltrim("content"))
    return F.coalesce(head.startswith(RETIRED_PREFIXES[0]) | head.startswith(RETIRED_PREFIXES[1]) | head.startswith(RETIRED_PREFIXES[2]), F.lit(False))


def retirement_plan(facts: DataFrame, at: str) -> DataFrame:
    """(fact_id, invalid_at): rows that their content marks as retired, with an end where they have none."""
    return facts.where(retired_by_prefix()).select("fact_id", F.coalesce("invalid_at", F.lit(at)).alias("invalid_at"))


def overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Half-open intervals; a null bound is open."""
    return (a_to.isNull() | b_from.isNull() | (b_from < a_to)) & (b_to.isNull() | a_from.isNull() | (a_from < b_to))


def as_of(valid_at: int | None = None, known_at: int | None = None) -> Column:
    """Whether a row holds at an instant of the world, of the record, or both (seconds)."""
    start, end = instant(F.col("valid_from")), instant(F.col("valid_to"))
    expired, invalid, created = instant(F.col("expired_at")), instant(F.col("invalid_at")), instant(F.col("created_at"))
    keep = F.lit(True)
    if valid_at is not None:
        keep &= start.isNull() | (start <= valid_at)
        if known_at is None:
            retired = end.isNull() & (F.col("invalid_at").isNotNull() | F.col("superseded_by").isNotNull())
            keep &= ~retired | F.coalesce(invalid > valid_at, F.lit(False))
            keep &= F.col("expired_at").isNull()
        keep &= end.isNull() | (end > valid_at)
    if known_at is not None:
        gone = F.coalesce(expired, F.when(F.col("superseded_by").isNotNull() & F.col("valid_to").isNull(), invalid))
        keep &= (created.isNull() | (created <= known_at)) & (gone.isNull() | (gone > known_at))
    return keep


def eligible(facts: DataFrame, scopes: Collection[str] | None, capabilities: Collection[str] = (), category: str | None = None, min_trust: float | None = None, include_unreviewed: bool = False) -> DataFrame:
    """The rows that ranked retrieval may return; every predicate reaches the scan."""
    keep = active() & visible(scopes, capabilities)
    if category is not None:
        keep &= F.col("category") == category
    if min_trust is not None:
        keep &= F.col("trust_score") >= min_trust
    if not include_unreviewed:
        keep &= reviewed()
    return facts.where(keep)


def newest(facts: DataFrame, scopes: Collection[str] | None, limit: int, category: str | None = None) -> DataFrame:
    """The newest active facts of the scopes, by identifier."""
    keep = active() & visible(scopes)
    if category is not None:
        keep &= F.col("category") == category
    return facts.where(keep).orderBy(F.col("fact_id").desc()).limit(limit)


def by_ids(facts: DataFrame, ids: DataFrame, scopes: Collection[str] | None) -> DataFrame:
    """Facts of an identifier list, whatever their lifecycle, within the scopes."""
    return facts.where(scope_predicate(scopes)).join(ids, "fact_id", "left_semi")
