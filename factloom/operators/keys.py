"""Slot keys and scopes: canonical forms, near misses of extracted keys, the registry of predicates."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import predicate_key, subject_key
from .eligibility import active

# Kinds of subjects, predicates every store knows, scopes, sensitivities, and the shapes of scopes with a name.
SUBJECT_KINDS = "agent bot course course_section cron environment person project service trip".split()
PREDICATES = (
    "clothing_store data_analysis_course decision_council employer cru_schedule_mode job_status keyboard live_version location model model_routing port "
    "quiz_time_accommodation response_style result_format typography threadwell_use"
).split()
BASE_SCOPES = ("private", "work", "public", "sensitive", "secret")
SENSITIVITIES = ("normal", "sensitive", "secret")
PROJECT_SCOPE = r"^project:[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
RUN_SCOPE = r"^run:[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def plural(key: Column) -> Column:
    """The English plural of a key's last part."""
    y = key.rlike("[^aeiou_]y$")
    return F.when(key.rlike("(s|x|z|ch|sh)$"), F.concat(key, F.lit("es"))).when(y, F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("ies"))).otherwise(F.concat(key, F.lit("s")))


def extracted_subject_key(text: Column) -> Column:
    """A subject key with blanks around its colon dropped, a plural kind made singular, and course codes without section; null where it is none."""
    key = subject_key(F.regexp_replace(text, r"\s*:\s*", ":"))
    kind, payload = F.substring_index(key, ":", 1), F.substring(key, F.instr(key, ":") + 1, F.length(key))
    singular = F.coalesce(*[F.when(plural(F.lit(k)) == kind, F.lit(k)) for k in SUBJECT_KINDS])
    kind = F.when(kind.isin(SUBJECT_KINDS), kind).otherwise(F.coalesce(singular, kind))
    payload = F.regexp_replace(payload, "^[_-]+|[_-]+$", "")
    code = r"^([a-z]{2,4})[_-]*(\d{4})(?:[_-]*[a-z][a-z0-9]{1,7})?$"
    payload = F.when((kind == "course") & payload.rlike(code), F.concat(F.regexp_extract(payload, code, 1), F.regexp_extract(payload, code, 2))).otherwise(payload)
    return F.when(~key.contains(":"), key).otherwise(subject_key(F.concat(kind, F.lit(":"), payload)))


def registry(facts: DataFrame, scope: str) -> DataFrame:
    """(predicate): the predicates of a scope's active facts in canonical form, and those every store knows."""
    stored = facts.where(active() & (F.col("scope") == scope)).select(predicate_key(F.col("predicate_key")).alias("predicate")).where("predicate is not null")
    known = facts.sparkSession.createDataFrame([(p,) for p in PREDICATES], "predicate string")
    return stored.unionByName(known).distinct()


def extracted_predicate_keys(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``rows`` with ``resolved``: the canonical key, or the known one of which it is the only plural; ``known``: (predicate)."""
    r = rows.withColumn("_key", predicate_key(F.col(column)))
    plurals = known.groupBy(plural(F.col("predicate")).alias("_key")).agg(F.min("predicate").alias("_one"), F.count(F.lit(1)).alias("_n"))
    r = r.join(plurals, "_key", "left").join(known.select(F.col("predicate").alias("_key"), F.lit(True).alias("_is")), "_key", "left")
    return r.withColumn("resolved", F.when(F.col("_is"), F.col("_key")).when(F.col("_n") == 1, F.col("_one")).otherwise(F.col("_key"))).drop("_key", "_one", "_n", "_is")


def canonical_slots(facts: DataFrame) -> DataFrame:
    """The facts with their slot keys in canonical form; a stored key that has none raises."""
    def strict(column: str, form: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"{column} of a stored fact is no slot key: "), F.col(column))).cast("string")
        both = F.col("subject_key").isNotNull() & F.col("predicate_key").isNotNull()
        return F.when(~both, F.col(column)).when(form.isNull(), bad).otherwise(form)

    return facts.withColumns({"subject_key": strict("subject_key", subject_key(F.col("subject_key"))), "predicate_key": strict("predicate_key", predicate_key(F.col("predicate_key")))})


def scope_known(scope: Column) -> Column:
    return scope.isin(*BASE_SCOPES) | scope.rlike(PROJECT_SCOPE) | scope.rlike(RUN_SCOPE)


def checked_scope(scope: Column) -> Column:
    """The scope; one outside the vocabulary raises."""
    return F.when(scope_known(scope), scope).otherwise(F.raise_error(F.concat(F.lit("unsupported scope: "), F.coalesce(scope, F.lit("null")))).cast("string"))


def run_scope(session: Column) -> Column:
    """The run scope of a session: its token where that fits the vocabulary, else the start of its digest."""
    plain = F.concat(F.lit("run:"), F.trim(session))
    return F.when(plain.rlike(RUN_SCOPE), plain).otherwise(F.concat(F.lit("run:"), F.substring(F.sha2(F.trim(session), 256), 1, 24)))


def granted_scopes(requested: Column, grants: Column) -> Column:
    """The requested scopes that are granted, in their order; none at all raises."""
    both = F.array_intersect(requested, grants)
    return F.when(F.size(both) > 0, both).otherwise(F.raise_error(F.lit("requested scopes do not intersect the grants")).cast("array<string>"))


def requested_scopes(explicit: str | None, granted: Collection[str]) -> list[str]:
    """The one scope a request names, if it is granted, else all granted ones."""
    if explicit is None:
        return list(granted)
    if explicit in granted or (explicit.startswith("run:") and "private" in granted):
        return [explicit]
    raise PermissionError("the requested scope is not authorized")
