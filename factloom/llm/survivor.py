"""Problem 6: one surviving record for each set of copies, field by field.

Fields are unpivoted to long rows (set, field, normalised value, vote); votes
are summed per normalised value; ``max_by`` chooses each field's winner; the
winners are pivoted back to one row per set. Every step is an algebraic
aggregate, so a set that holds a third of all rows is combined before the
shuffle and never gathered.

A vote is a source's trust times the decay of its age, ``trust * 0.5 ** (age /
half_life)``. Values with more votes win, unless the rule measures its values:
then the greatest measure wins and votes decide among equals. Further ties go
to the value whose first bearer is the earliest by ``created_at``, then the
smallest identifier; that first bearer is the value's carrier. A rule with
``every`` keeps all values that got a row.

Defined cases: a null value casts no vote; a null trust counts as 0; a null
``created_at`` counts as the oldest for the decay and comes last at ties; a set
without any value of a field gets null, or an empty text where all are kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import instant

HALF_LIFE_DAYS = 180.0
#: Sorts after every instant in use (year 9999), in seconds.
NEVER = 253402300799
_CELLS = "array<struct<field: string, value: string, norm: string, measure: double>>"


@dataclass(frozen=True)
class Rule:
    """How one field of the survivor is chosen.

    value: the candidate value, or an array of them; norm: the form under which
    votes are summed; measure: what ranks the values before their votes;
    carrier: whether the winner is the identifier that bears the value;
    every: whether all values are kept, sorted and joined by commas.
    """

    field: str
    value: Column
    norm: Callable[[Column], Column] = lambda c: F.lower(F.trim(c))
    measure: Column | None = None
    carrier: bool = False
    every: bool = False


def latest(facts: DataFrame) -> int:
    """The latest instant of creation, in seconds; 0 for none."""
    return facts.agg(F.max(instant(F.col("created_at")))).first()[0] or 0


def trust_decay(now: int, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """Trust times recency: the vote of a member row."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce(F.col("_at"), F.lit(0))).cast("double") / 86400.0)
    return F.coalesce(F.col("trust_score"), F.lit(0.0)) * F.pow(F.lit(0.5), age / F.lit(half_life_days))


def votes(rows: DataFrame, rules: list[Rule], now: int, group: str = "first", ident: str = "fact_id") -> DataFrame:
    """(group, field, norm, votes, measure, value, carrier, tie): the votes of every normalised value of every set.

    ``rows``: members with ``group``, ``ident``, ``trust_score`` and ``created_at``.
    """
    base = rows.withColumn("_at", instant(F.col("created_at"))).withColumn("_vote", trust_decay(now))

    def cell(r: Rule, value: Column) -> Column:
        measure = F.lit(None) if r.measure is None else r.measure
        return F.struct(F.lit(r.field).alias("field"), value.cast("string").alias("value"), r.norm(value.cast("string")).alias("norm"), measure.cast("double").alias("measure"))

    single = F.array(*[cell(r, r.value) for r in rules if not r.every])
    many = [F.transform(r.value, (lambda rule: lambda v: cell(rule, v))(r)) for r in rules if r.every]
    cells = F.concat(single, *[F.coalesce(m, F.array().cast(_CELLS)) for m in many]) if many else single
    long = base.select(F.col(group), F.col(ident).alias("_id"), F.coalesce("_at", F.lit(NEVER)).alias("_tie"), "_vote", F.explode(cells).alias("x"))
    long = long.select(group, "_id", "_tie", "_vote", "x.*").where(F.col("norm").isNotNull())
    first = F.struct("_tie", "_id")
    return long.groupBy(group, "field", "norm").agg(
        F.sum("_vote").alias("votes"), F.max("measure").alias("measure"), F.min_by("value", first).alias("value"), F.min(first).alias("tie")
    )


def elect(rows: DataFrame, rules: list[Rule], now: int, group: str = "first", ident: str = "fact_id") -> DataFrame:
    """(group, one string column per rule): the winners of every set."""
    every = [r.field for r in rules if r.every]
    carriers = [r.field for r in rules if r.carrier]
    rank = F.struct(F.coalesce("measure", "votes").alias("m"), "votes", (-F.col("tie._tie")).alias("a"), (-F.col("tie._id")).alias("b"))
    shown = F.when(F.col("field").isin(carriers), F.col("tie._id").cast("string")).otherwise(F.col("value"))
    kept = F.array_join(F.sort_array(F.collect_list(F.when(F.col("field").isin(every), F.col("norm")))), ",")
    won = votes(rows, rules, now, group, ident).groupBy(group, "field").agg(F.max_by(shown, rank).alias("best"), kept.alias("kept"))
    won = won.select(group, "field", F.when(F.col("field").isin(every), F.col("kept")).otherwise(F.col("best")).alias("value"))
    return won.groupBy(group).pivot("field", [r.field for r in rules]).agg(F.first("value"))


def tag_values(tags: Column) -> Column:
    """The distinct normalised tags of one row: split at commas, trimmed, lower case, no empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(tags, ","), lambda t: F.lower(F.trim(F.regexp_replace(t, r"^\s+|\s+$", "")))), lambda t: t != ""))


def survivors(members: DataFrame, facts: DataFrame) -> DataFrame:
    """p6_found: each set's survivor, newest member and merged tags.

    Three fields are elected: trust times retrieval count, measured by itself,
    whose carrier survives; the instant of creation, measured by itself, whose
    carrier is the newest; and the tags, of which every voted one is kept.
    """
    rows = members.join(facts.select("fact_id", "trust_score", "retrieval_count", "created_at", "tags"), "fact_id")
    worth = F.coalesce(F.col("trust_score"), F.lit(0.0)) * F.coalesce(F.col("retrieval_count"), F.lit(0)) + F.lit(0.0)
    born = F.coalesce(F.col("_at"), F.lit(-NEVER))
    rules = [
        Rule("survivor_fact_id", worth, measure=worth, carrier=True),
        Rule("newest_fact_id", born, measure=born, carrier=True),
        Rule("merged_tags", tag_values(F.col("tags")), every=True),
    ]
    won = elect(rows, rules, latest(facts))
    return won.select(
        F.col("first").alias("first_fact_id"), F.col("survivor_fact_id").cast("long"), F.col("newest_fact_id").cast("long"), F.coalesce("merged_tags", F.lit("")).alias("merged_tags")
    )


#: Descriptive fields that ``golden`` elects.
FIELDS = ("category", "scope", "sensitivity", "memory_kind", "subject_key", "predicate_key", "object_value")


def golden(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(first_fact_id, one column per descriptive field): the best value of each field by votes.

    Missing values cast no vote, so the most complete, trusted and recent
    values win field by field.
    """
    rows = members.join(facts.select("fact_id", "trust_score", "created_at", *FIELDS), "fact_id")
    return elect(rows, [Rule(c, F.col(c)) for c in FIELDS], latest(facts)).withColumnRenamed("first", "first_fact_id")
