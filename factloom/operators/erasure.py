"""Privacy erasure as new snapshots: scrubbed tables, and insights that cited erased facts.

Parquet files are immutable: earlier snapshots must be dropped for the text to
be gone from disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

TOMBSTONE = "[erased]"


def erased_facts(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts with erased rows scrubbed: text, tags, values and slot removed, kind reset."""
    gone = ids.select("fact_id", F.lit(True).alias("_gone"))
    r = facts.join(gone, "fact_id", "left")
    scrub = {c: F.when(F.col("_gone"), F.lit(v)).otherwise(F.col(c)) for c, v in (("content", TOMBSTONE), ("tags", ""), ("object_value", None), ("subject_key", None), ("predicate_key", None), ("conflict_group", None))}
    scrub["memory_kind"] = F.when(F.col("_gone"), F.lit("fact")).otherwise(F.col("memory_kind"))
    return r.withColumns(scrub).drop("_gone")


def erased_observations(provenance: DataFrame, observations: DataFrame, ids: DataFrame) -> DataFrame:
    """(observation_id, shared): observations of erased facts; shared ones also support others and are cloned, not scrubbed."""
    e = provenance.select("observation_id", "fact_id").distinct().join(ids.select("fact_id", F.lit(1).alias("g")), "fact_id", "left")
    g = e.groupBy("observation_id").agg(F.count_if(F.col("g") == 1).alias("gone"), F.count_if(F.col("g").isNull()).alias("kept"))
    return g.where("gone > 0").join(observations.select("observation_id"), "observation_id", "left_semi").select("observation_id", (F.col("kept") > 0).alias("shared"))


def clones(provenance: DataFrame, observations: DataFrame, ids: DataFrame) -> DataFrame:
    """(observation_id, clone_id): shared observations of erased facts and the new identifiers under which the others keep them."""
    shared = erased_observations(provenance, observations, ids).where("shared").select("observation_id")
    top = observations.agg(F.coalesce(F.max("observation_id"), F.lit(0))).first()[0]
    return numbered(shared, "observation_id", top, "clone_id")


def after_erasure(facts: DataFrame, provenance: DataFrame, observations: DataFrame, vectors: DataFrame, ids: DataFrame, erasure: str, at: str) -> dict[str, DataFrame]:
    """Every table as it is after an erasure: texts and evidence scrubbed, shared evidence kept as clones, vectors dropped, lone conflict members released."""
    copy = clones(provenance, observations, ids)
    touched = erased_observations(provenance, observations, ids).select("observation_id", F.lit(True).alias("_x"))
    o = observations.join(touched, "observation_id", "left")
    x = F.col("_x").isNotNull()
    new = {"source_uri": F.lit(None), "observation_content": F.lit(TOMBSTONE), "content_sha256": F.concat(F.lit(f"erased:{erasure}:"), "observation_id"), "asserted_by": F.lit(None), "metadata_json": F.lit("{}"), "redacted_at": F.lit(at)}
    scrubbed = o.select(*[F.when(x, new[c]).otherwise(F.col(c)).cast(observations.schema[c].dataType).alias(c) if c in new else F.col(c) for c in observations.columns])
    kept = observations.join(copy, "observation_id").withColumns({"content_sha256": F.concat(F.lit(f"clone:{erasure}:"), "observation_id"), "observation_id": F.col("clone_id")}).select(*observations.columns)
    gone = ids.select("fact_id", F.lit(True).alias("_g")).distinct()
    p = provenance.join(gone, "fact_id", "left").join(copy, "observation_id", "left")
    own = F.col("_g").isNotNull()
    moved = {"observation_id": F.when(own, F.col("observation_id")).otherwise(F.coalesce("clone_id", "observation_id")), "evidence_excerpt": F.when(~own, F.col("evidence_excerpt"))}
    f = erased_facts(facts, ids)
    size = f.where("conflict_group is not null").groupBy("conflict_group").agg(F.count(F.lit(1)).alias("_n"))
    f = f.join(size, "conflict_group", "left").withColumn("conflict_group", F.when(F.col("_n") > 1, F.col("conflict_group")))
    end = F.when(F.col("content") == TOMBSTONE, F.coalesce("invalid_at", F.lit(at))).otherwise(F.col("invalid_at"))
    return {
        "facts": f.withColumn("invalid_at", end).select(*facts.columns), "observations": scrubbed.unionByName(kept),
        "fact_provenance": p.select(*[moved.get(c, F.col(c)).alias(c) for c in provenance.columns]), "fact_embeddings": vectors.join(gone.select("fact_id"), "fact_id", "left_anti").select(*vectors.columns),
    }


def is_clone() -> Column:
    """Evidence that only repeats what an erasure kept: exports hide it."""
    return F.coalesce(F.col("content_sha256").startswith("clone:"), F.lit(False))


def cascade(facts: DataFrame, provenance: DataFrame, vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """(what, n): rows of each table that erasure of ``ids`` touches."""
    own = ids.select("fact_id").distinct()
    members = facts.where("conflict_group is not null").select("conflict_group", "fact_id").join(own.withColumn("g", F.lit(1)), "fact_id", "left")
    closed = members.groupBy("conflict_group").agg(F.count_if(F.col("g").isNull()).alias("kept"), F.count_if(F.col("g") == 1).alias("gone")).where("gone > 0 and kept <= 1")
    parts = [
        ("facts", facts.select("fact_id").join(own, "fact_id", "left_semi")), ("provenance", provenance.select("fact_id").join(own, "fact_id", "left_semi")),
        ("vectors", vectors.select("fact_id").join(own, "fact_id", "left_semi")), ("conflicts closed", closed),
        ("links", facts.where("superseded_by is not null").select(F.col("superseded_by").alias("fact_id")).join(own, "fact_id", "left_semi")),
    ]
    out = None
    for what, df in parts:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def cited(facts: DataFrame) -> DataFrame:
    """(insight_id, fact_id): citations ``source_facts:1,2`` in tags, and replaced sources of insights."""
    ids = F.split(F.regexp_extract(F.coalesce("tags", F.lit("")), r"source_facts:([0-9]+(?:,[0-9]+)*)", 1), ",")
    tagged = facts.where(F.col("tags").contains("source_facts:")).select(F.col("fact_id").alias("insight_id"), F.explode(ids).alias("x")).where("x != ''").select("insight_id", F.col("x").cast("long").alias("fact_id"))
    return tagged.distinct()


def invalidated_insights(facts: DataFrame, provenance: DataFrame, ids: DataFrame) -> DataFrame:
    """(fact_id): active insights that cite an erased fact, or derive from an observation that one rests on."""
    insight = facts.where("memory_kind = 'insight' and invalid_at is null").select("fact_id")
    direct = cited(facts).join(ids.select("fact_id"), "fact_id", "left_semi").select(F.col("insight_id").alias("fact_id"))
    touched = provenance.join(ids.select("fact_id"), "fact_id", "left_semi").select("observation_id").distinct()
    derived = provenance.where("relation = 'derived_from'").join(touched, "observation_id", "left_semi").select("fact_id")
    return insight.join(direct.unionByName(derived).distinct(), "fact_id", "left_semi").join(ids.select("fact_id"), "fact_id", "left_anti")
