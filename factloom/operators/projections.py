"""Events, timelines, entities and dossiers over the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tag_list
from ..functions.times import instant
from .eligibility import active

# Kinds of events in their order at one instant.
KINDS = ("created", "superseded", "conflicted", "resolved")


def _event(rows: DataFrame, kind: str, at) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("kind_order"), instant(at).alias("at"), at.alias("at_text"), "fact_id").where("at is not null")


def settled_events(facts: DataFrame) -> DataFrame:
    """created and superseded events of every fact, and resolved ones of retired conflict members."""
    return (
        _event(facts, "created", F.col("created_at"))
        .unionByName(_event(facts.where("superseded_by is not null"), "superseded", F.coalesce("invalid_at", "expired_at")))
        .unionByName(_event(facts.where("conflict_group is not null and invalid_at is not null"), "resolved", F.col("invalid_at")))
    )


def all_events(facts: DataFrame) -> DataFrame:
    """Settled events, and one conflicted event per conflict at its first member."""
    first = facts.where("conflict_group is not null").groupBy("conflict_group").agg(F.min("fact_id").alias("fact_id"), F.max("created_at").alias("seen"))
    return settled_events(facts).unionByName(_event(first, "conflicted", F.col("seen")))


def changes(facts: DataFrame, since: int, until: int) -> DataFrame:
    """Events in [since, until), numbered in their order."""
    w = Window.partitionBy(F.date_trunc("month", F.timestamp_seconds("at"))).orderBy("at", "at_text", "kind_order", "fact_id")
    rows = all_events(facts).where((F.col("at") >= since) & (F.col("at") < until))
    return rows.select(F.date_format(F.timestamp_seconds("at"), "yyyy-MM").alias("month"), F.row_number().over(w).alias("position"), "kind", "at", "fact_id")


def timeline(facts: DataFrame, needle: str, last: int) -> DataFrame:
    """The last events of facts whose text, tags or slot hold the needle, in any letter case."""
    text = F.lower(F.concat_ws(" ", "content", "tags", "subject_key", "predicate_key", "object_value"))
    hits = facts.where(text.contains(needle.lower()))
    return all_events(hits).orderBy(F.col("at").desc(), F.col("kind_order").desc(), F.col("fact_id").desc()).limit(last).select("kind", "at", "fact_id")


def entity_names(facts: DataFrame) -> DataFrame:
    """(fact_id, name, display, source, place): subjects and tags of every active fact."""
    tags = F.transform(tag_list(F.col("tags")), lambda t: F.struct(t.alias("display"), F.lit("tag").alias("source")))
    own = F.when(F.col("subject_key").isNotNull(), F.array(F.struct(F.col("subject_key").alias("display"), F.lit("subject").alias("source")))).otherwise(F.array().cast("array<struct<display:string,source:string>>"))
    rows = facts.where(active()).select("fact_id", F.posexplode(F.concat(own, tags)).alias("place", "x"))
    return rows.select("fact_id", "place", F.col("x.display").alias("display"), F.col("x.source").alias("source"), F.lower("x.display").alias("name"))


def entities_ranked(facts: DataFrame, min_facts: int = 2) -> DataFrame:
    """Names with their number of facts, where they occur, and the spelling first seen."""
    g = entity_names(facts).groupBy("name").agg(
        F.countDistinct("fact_id").alias("facts"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.min_by("display", F.struct("fact_id", "place")).alias("display"),
    )
    return g.where(F.col("facts") >= min_facts)


def entity_degrees(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Every entity's number of linked facts and of linked active facts."""
    n = facts.where("object_entity_id is not null").groupBy(F.col("object_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("linked"), F.count_if(active()).alias("active"))
    return entities.select("entity_id", "entity_type").join(n, "entity_id", "left").select("entity_id", "entity_type", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("active", F.lit(0)).alias("active"))


def dossier(facts: DataFrame, name: str) -> DataFrame:
    """Current facts whose subject or tags equal the name, in any letter case."""
    hit = (F.lower("subject_key") == name.lower()) | F.array_contains(F.transform(tag_list(F.col("tags")), lambda t: F.lower(t)), name.lower())
    return facts.where(active() & F.coalesce(hit, F.lit(False))).select("fact_id", "subject_key", "predicate_key", "object_value")


def about(name: str) -> Column:
    """Whether a fact's subject or one of its tags is the name, in any letter case."""
    return F.coalesce((F.lower("subject_key") == name.lower()) | F.array_contains(F.transform(tag_list(F.col("tags")), lambda t: F.lower(t)), name.lower()), F.lit(False))


def entity_conflicts(facts: DataFrame, name: str, most: int = 10) -> DataFrame:
    """(conflict_group, members, fact_id, place): open conflicts about the name: by their slot or tags, or through a member, with up to ``most`` members each."""
    rows = facts.where("conflict_group is not null").withColumn("_about", about(name))
    hit = rows.where("_about").select("conflict_group").distinct()
    w = Window.partitionBy("conflict_group")
    r = rows.join(hit, "conflict_group", "left_semi").withColumns({"members": F.count(F.lit(1)).over(w), "place": F.row_number().over(w.orderBy("fact_id"))})
    return r.where(F.col("place") <= most).select("conflict_group", "members", "fact_id", "place")


def full_dossier(facts: DataFrame, events: DataFrame, name: str, budget: int) -> DataFrame:
    """(section, place, item, size): current facts, events and conflicts about a name, taken in turn while the estimated tokens last.

    ``events``: (fact_id, event, at) of all facts. A dossier is one answer.
    """
    size = F.greatest(F.lit(1), F.floor((F.length("item") + 3) / 4)).cast("long")  # so the first ``budget`` items of a section are all that can fit
    mine = facts.where(about(name)).select("fact_id", F.coalesce("content", F.lit("")).alias("item"), active().alias("live"))
    told = events.join(mine.select("fact_id"), "fact_id", "left_semi")
    clash = entity_conflicts(facts, name)
    sections = [
        ("current", mine.where("live"), ["fact_id"], F.col("item")), ("event", told, ["at", "fact_id", "event"], F.concat_ws(" ", "at", "event", "fact_id")),
        ("conflict", clash, ["conflict_group", "place"], F.concat_ws(" ", "conflict_group", "fact_id")),
    ]
    rows = None
    for section, df, order, item in sections:
        first = df.orderBy(*order).limit(budget).withColumn("_o", F.struct(*order)).select(F.lit(section).alias("section"), F.row_number().over(Window.partitionBy(F.lit(section)).orderBy("_o")).alias("place"), item.alias("item"))
        rows = first if rows is None else rows.unionByName(first)
    turn = Window.partitionBy(F.lit(1)).orderBy("place", "section").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("size", size).withColumn("used", F.sum("size").over(turn)).where(F.col("used") <= budget).select("section", "place", "item", "size")


def entity_resolution(entities: DataFrame) -> DataFrame:
    """Names in any letter case with the smallest identifier and how often they occur."""
    return entities.where("name is not null").groupBy(F.lower(F.trim("name")).alias("name_key")).agg(F.min("entity_id").alias("entity_id"), F.count(F.lit(1)).alias("n"))


def hop(facts: DataFrame, seeds: DataFrame, hub: int = 25) -> DataFrame:
    """(seed_id, fact_id): facts that share an entity of degree at most ``hub`` with a seed.

    Hubs are removed before the second join, so an entity contributes at most
    ``hub`` facts to each seed.
    """
    links = facts.where(F.col("object_entity_id").isNotNull() & active()).select("fact_id", F.col("object_entity_id").alias("e"))
    narrow = links.groupBy("e").count().where(F.col("count") <= hub).select("e")
    small = links.join(narrow, "e", "left_semi")
    start = small.join(seeds.select(F.col("fact_id")), "fact_id", "left_semi").select(F.col("fact_id").alias("seed_id"), "e")
    return start.join(small, "e").where("fact_id != seed_id").select("seed_id", "fact_id").distinct()


def two_hops(facts: DataFrame, seeds: DataFrame, hub: int = 25) -> DataFrame:
    """(seed_id, fact_id, hops): facts within two hops over entities or shared slots' subjects."""
    one = hop(facts, seeds, hub)
    keyed = facts.where(active() & F.col("subject_key").isNotNull()).select("fact_id", "subject_key")
    narrow = keyed.groupBy("subject_key").count().where(F.col("count") <= hub).select("subject_key")
    keyed = keyed.join(narrow, "subject_key", "left_semi")
    via = one.join(keyed, "fact_id").select("seed_id", "subject_key").distinct().join(keyed, "subject_key").where("fact_id != seed_id").select("seed_id", "fact_id").distinct()
    return one.withColumn("hops", F.lit(1)).unionByName(via.withColumn("hops", F.lit(2))).groupBy("seed_id", "fact_id").agg(F.min("hops").alias("hops"))
