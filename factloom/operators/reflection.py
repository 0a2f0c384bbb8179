"""Insights over clusters of related facts: selection, grounded answers, and what may be stored."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import band_pairs, clusters
from .eligibility import active, retired_by_prefix
from .expansion import entity_clusters
from .extraction import first_json


def sources(facts: DataFrame) -> DataFrame:
    """Facts that insights may rest on: active, no insights themselves, not marked as retired."""
    return facts.where(active() & ~F.col("category").eqNullSafe("insight") & ~F.col("memory_kind").eqNullSafe("insight") & ~retired_by_prefix())


def selected(facts: DataFrame, vectors: DataFrame | None, most: int, low: float = 0.75, high: float = 0.92, hub: int = 25) -> DataFrame:
    """(cluster, fact_ids): up to ``most`` clusters: those of an entity first, then of vectors that are near but not the same."""
    rows = sources(facts)
    by_entity = entity_clusters(rows, 2, hub).select(F.lit(0).alias("kind"), F.concat(F.lit("entity:"), "entity_id").alias("cluster"), F.split("fact_ids", ",").alias("ids"), "n")
    every = by_entity
    if vectors is not None:
        near = clusters(band_pairs(rows, vectors, low, high)).groupBy("cluster").agg(F.sort_array(F.collect_list("fact_id")).alias("ids"), F.count(F.lit(1)).alias("n"))
        every = by_entity.unionByName(near.select(F.lit(1).alias("kind"), F.concat(F.lit("near:"), "cluster").alias("cluster"), F.transform("ids", lambda x: x.cast("string")).alias("ids"), "n"))
    return every.orderBy("kind", F.col("n").desc(), "cluster").limit(most).select("cluster", F.array_join("ids", ",").alias("fact_ids"))


def parsed(answer: str | None, members: list[int]) -> tuple[str, list[int]] | None:
    """(insight, cited facts) of a model's answer; None unless it is JSON that cites at least two members and no others."""
    text = (answer or "").strip()
    if not text or text.upper() == "NONE":
        return None
    for block in (text, first_json(text, "{")):
        try:
            said = json.loads(block) if block else None
            break
        except ValueError:
            said = None
    if not isinstance(said, dict) or not isinstance(said.get("source_fact_ids"), list):
        return None
    insight = str(said.get("insight", "")).strip()
    try:
        cited = list(dict.fromkeys(int(i) for i in said["source_fact_ids"]))
    except (TypeError, ValueError):
        return None
    if not insight or insight.upper() == "NONE" or len(cited) < 2 or not set(cited) <= set(members):
        return None
    return insight, cited


def grounded(answers: DataFrame) -> DataFrame:
    """(cluster, insight, cited): answers (cluster, fact_ids, answer) that hold up, one Arrow pass."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(c, *got) for c, ids, a in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if (got := parsed(a, [int(x) for x in (ids or "").split(",") if x]))]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int64()))], ["cluster", "insight", "cited"])

    return answers.select("cluster", "fact_ids", "answer").mapInArrow(run, "cluster string, insight string, cited array<bigint>")


def still_active(insights: DataFrame, facts: DataFrame) -> DataFrame:
    """The insights (cluster, insight, cited) all of whose sources may still be rested on."""
    cited = insights.select("cluster", F.explode("cited").alias("fact_id")).distinct()
    good = cited.join(sources(facts).select("fact_id", F.lit(1).alias("_ok")), "fact_id", "left").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count("_ok").alias("ok"))
    return insights.join(good.where("n = ok").select("cluster"), "cluster", "left_semi")


def run(facts: DataFrame, vectors: DataFrame | None, answer, now: int, last_run: int | None, interval_hours: float, most: int) -> DataFrame | None:
    """(content, category, tags): new insights of one pass, or None before the interval has passed.

    ``answer``: a function of clusters (cluster, fact_ids, facts) to (cluster,
    fact_ids, answer); the model behind it is the caller's. An insight that an
    active fact already states is left out.
    """
    if last_run is not None and now - last_run < interval_hours * 3600:
        return None
    chosen = selected(facts, vectors, most)
    ids = chosen.select("cluster", "fact_ids", F.explode(F.split("fact_ids", ",")).alias("x"))
    said = ids.select("cluster", "fact_ids", F.col("x").cast("long").alias("fact_id")).join(facts.select("fact_id", "content"), "fact_id")
    shown = said.groupBy("cluster", "fact_ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fact_id", "content"))), lambda x: F.concat(x.fact_id.cast("string"), F.lit(": "), F.coalesce(x.content, F.lit("")))), "\n").alias("facts"))
    new = still_active(grounded(answer(shown)), facts)
    stated = facts.where(active()).select(F.lower(F.trim("content")).alias("_t")).distinct()
    fresh = new.withColumn("_t", F.lower(F.trim("insight"))).join(stated, "_t", "left_anti")
    return fresh.select(F.col("insight").alias("content"), F.lit("insight").alias("category"), F.concat(F.lit("source_facts:"), F.array_join(F.transform(F.sort_array("cited"), lambda x: x.cast("string")), ",")).alias("tags"))
