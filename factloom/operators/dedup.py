"""Near-duplicate clusters, survivors, merge plans and reference rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import merge_states, merge_value_tokens, negated, tag_list
from .components import components
from .eligibility import active, retired_by_prefix
from .vector_join import near


def guard_key(text: Column) -> Column:
    """Facts may merge only if these agree: value tokens in order, polarity, states. An exact blocking key."""
    return F.concat_ws("\u0001", F.array_join(merge_value_tokens(text), " "), negated(text).cast("string"), F.array_join(merge_states(text), " "))


def guarded_blocks(facts: DataFrame) -> DataFrame:
    """(scope, guard, n, first): blocks of at least two active facts that the guard lets merge."""
    rows = facts.where(active() & F.col("content").isNotNull()).select("scope", "fact_id", F.xxhash64(guard_key(F.col("content"))).alias("guard"))
    return rows.groupBy("scope", "guard").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first")).where("n > 1")


def exact_duplicates(facts: DataFrame) -> DataFrame:
    """Active facts of equal scope and content, with the lowest identifier."""
    w = facts.where(active() & F.col("content").isNotNull())
    return w.groupBy("scope", F.md5("content").alias("digest")).agg(F.min("fact_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("scope", "first", "n")


def mergeable(facts: DataFrame) -> DataFrame:
    """Active facts with a text whose content does not mark them as retired."""
    return facts.where(active() & F.col("content").isNotNull() & ~retired_by_prefix())


def the_identity(vectors: DataFrame, identity: str | None = None) -> str | None:
    """The one embedding identity of the vectors; several raise unless one is named; None where there are none."""
    names = [r[0] for r in vectors.where("embedding_identity is not null").select("embedding_identity").distinct().limit(2).collect()]
    if identity is None and len(names) > 1:
        raise ValueError("several embedding identities are present: name one")
    return identity if identity is not None else names[0] if names else None


def near_pairs(facts: DataFrame, vectors: DataFrame, threshold: float, forest: bool = False) -> DataFrame:
    """(a, b, cosine): pairs of active facts of one scope, guard and embedding identity whose vectors are near; with
    ``forest`` only as many as connect the same facts, which is all that clusters need."""
    rows = mergeable(facts).select("scope", F.col("fact_id"), guard_key(F.col("content")).alias("guard"))
    v = vectors.select("fact_id", "embedding", "embedding_identity")
    return near(rows.join(v, "fact_id").withColumnRenamed("fact_id", "id"), ["scope", "guard", "embedding_identity"], threshold, forest)


def band_pairs(facts: DataFrame, vectors: DataFrame, low: float, high: float, newest: int = 2000) -> DataFrame:
    """(a, b, cosine) in [low, high) among the newest active facts: the population is capped as a feature."""
    rows = facts.where(active()).select("fact_id").join(vectors.select("fact_id", "embedding", "embedding_identity"), "fact_id")
    rows = rows.orderBy(F.col("fact_id").desc()).limit(newest).withColumnRenamed("fact_id", "id")
    return near(rows, ["embedding_identity"], low).where(F.col("cosine") < high)


def clusters(pairs: DataFrame) -> DataFrame:
    """(fact_id, cluster): connected components of near pairs."""
    return components(pairs, "a", "b").withColumnsRenamed({"node": "fact_id", "root": "cluster"})


def survivors(rows: DataFrame) -> DataFrame:
    """(cluster, survivor): active rows first, then those created before the cutoff, then the greatest trust times
    retrieval count, the earliest creation, the smallest identifier."""
    use = F.coalesce("trust_score", F.lit(0.0)) * F.coalesce("retrieval_count", F.lit(0))
    order = F.struct((~F.col("live")).alias("a"), (~F.col("early")).alias("b"), (-use).alias("c"), F.coalesce("created_at", F.lit("~")).alias("d"), F.col("fact_id").alias("e"))
    return rows.groupBy("cluster").agg(F.min_by("fact_id", order).alias("survivor"))


def merge_members(facts: DataFrame, members: DataFrame, flood_cutoff: str | None = None) -> DataFrame:
    """(cluster, survivor, fact_id and what a merge adds up): the members whose guard agrees with the survivor's, chosen again among these."""
    early = F.lit(False) if flood_cutoff is None else F.col("created_at") < flood_cutoff
    r = members.join(
        facts.select("fact_id", "trust_score", "retrieval_count", "helpful_count", "created_at", "tags", active().alias("live"), F.coalesce(early, F.lit(False)).alias("early"), F.xxhash64(guard_key(F.col("content"))).alias("guard")), "fact_id"
    )
    first = survivors(r).join(r.select("cluster", F.col("fact_id").alias("survivor"), F.col("guard").alias("_g")), ["cluster", "survivor"])
    safe = r.join(first.select("cluster", "_g"), "cluster").where("guard = _g").drop("guard", "_g")
    return safe.join(survivors(safe), "cluster")


def merge_plan(facts: DataFrame, members: DataFrame, flood_cutoff: str | None = None, suspicious: int = 25) -> DataFrame:
    """(cluster, survivor, dropped, retrieval_count, helpful_count, tags, suspicious): what a merge would write.

    Tags keep their first spelling in order of members.
    """
    r = merge_members(facts, members, flood_cutoff)
    g = r.groupBy("cluster").agg(
        F.first("survivor").alias("survivor"), (F.count(F.lit(1)) - 1).alias("dropped"), F.sum(F.coalesce("retrieval_count", F.lit(0))).alias("retrieval_count"),
        F.sum(F.coalesce("helpful_count", F.lit(0))).alias("helpful_count"),
    ).where("dropped > 0")
    t = r.select("cluster", "fact_id", F.posexplode(tag_list(F.col("tags"))).alias("i", "tag")).groupBy("cluster", "tag").agg(F.min(F.struct("fact_id", "i")).alias("at"))
    t = t.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "tag"))), lambda x: x.tag), ",").alias("tags"))
    return g.join(t, "cluster", "left").select("cluster", "survivor", "dropped", "retrieval_count", "helpful_count", F.coalesce("tags", F.lit("")).alias("tags"), (F.col("dropped") + 1 > suspicious).alias("suspicious"))


def merged_ids(facts: DataFrame, members: DataFrame, flood_cutoff: str | None = None) -> DataFrame:
    """(fact_id, survivor): the losers of a merge and who stands for them."""
    return merge_members(facts, members, flood_cutoff).where("fact_id != survivor").select("fact_id", "survivor")


def check_merge(facts: DataFrame, plan: DataFrame, least: int, most: int, fraction: float = 0.5) -> None:
    """Raises where a plan would drop fewer or more facts than expected, or too large a part of the active ones."""
    drop = plan.agg(F.coalesce(F.sum("dropped"), F.lit(0))).first()[0]
    start = mergeable(facts).count()
    if not least <= drop <= most:
        raise ValueError(f"the plan drops {drop} facts, outside of {least} to {most}")
    if start and drop > fraction * start:
        raise ValueError(f"the plan drops {drop} of {start} facts, more than {fraction:.0%}")


def merged_facts(facts: DataFrame, plan: DataFrame, losers: DataFrame) -> DataFrame:
    """The facts after a merge: survivors with their counts and tags, losers gone, links and citations led to survivors."""
    new = plan.select(F.col("survivor").alias("fact_id"), F.col("retrieval_count").alias("_r"), F.col("helpful_count").alias("_h"), F.col("tags").alias("_t"))
    kept = facts.join(losers.select("fact_id"), "fact_id", "left_anti").join(new, "fact_id", "left")
    kept = kept.withColumns({"retrieval_count": F.coalesce("_r", "retrieval_count"), "helpful_count": F.coalesce("_h", "helpful_count"), "tags": F.coalesce("_t", "tags")}).drop("_r", "_h", "_t")
    to = losers.select(F.col("fact_id").alias("superseded_by"), F.col("survivor").alias("_to"))
    linked = kept.join(to, "superseded_by", "left")
    link = F.coalesce("_to", "superseded_by")
    linked = linked.withColumn("superseded_by", F.when(link != F.col("fact_id"), link)).drop("_to")
    cites = rewritten_citations(linked, losers)
    return linked.join(cites, "fact_id", "left").withColumn("tags", F.coalesce("_tags", "tags")).drop("_tags").select(*facts.columns)


def rewritten_citations(facts: DataFrame, losers: DataFrame) -> DataFrame:
    """(fact_id, _tags): active insights whose ``source_facts:`` list names a loser, with survivors in its place, each once."""
    pattern = r"source_facts:([0-9]+(?:,[0-9]+)*)"
    rows = facts.where(active() & (F.col("category") == "insight") & F.col("tags").rlike(pattern)).select("fact_id", "tags", F.regexp_extract("tags", pattern, 1).alias("said"))
    cited = rows.select("fact_id", F.posexplode(F.split("said", ",")).alias("i", "x")).withColumn("x", F.col("x").cast("long"))
    to = losers.select(F.col("fact_id").alias("x"), F.col("survivor").alias("to"))
    new = cited.join(to, "x", "left").select("fact_id", "i", F.coalesce("to", "x").alias("x")).groupBy("fact_id", "x").agg(F.min("i").alias("i"))
    new = new.groupBy("fact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x.cast("string")), ",").alias("new"))
    out = rows.join(new, "fact_id").where("new != said")
    return out.select("fact_id", F.replace("tags", F.concat(F.lit("source_facts:"), "said"), F.concat(F.lit("source_facts:"), "new")).alias("_tags"))


def merged_rows(df: DataFrame, losers: DataFrame, action: str, column: str = "fact_id") -> DataFrame:
    """A table that refers to facts after a merge: ``update`` leads to survivors, ``deduplicate`` also collapses equal rows, ``delete`` drops."""
    if action == "delete":
        return df.join(losers.select(F.col("fact_id").alias(column)), column, "left_anti").select(*df.columns)
    to = losers.select(F.col("fact_id").alias(column), F.col("survivor").alias("_to"))
    out = df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).select(*df.columns)
    return out.distinct() if action == "deduplicate" else out


# Tables and columns that refer to facts, and what a merge does with them.
REFERENCES = (
    ("fact_entities", "fact_id", "deduplicate"), ("fact_provenance", "fact_id", "deduplicate"), ("memory_write_log", "fact_id", "update"), ("memory_write_log", "existing_fact_id", "update"),
    ("privacy_erasure_log", "fact_id", "update"), ("embedding_jobs", "fact_id", "delete"), ("fact_embeddings", "fact_id", "delete"), ("fact_conflicts", "resolution_fact_id", "update"),
    ("fact_conflict_members", "fact_id", "deduplicate"), ("fact_conflict_resolutions", "resolution_fact_id", "update"),
)


def merged_references(tables: dict[str, DataFrame], losers: DataFrame) -> dict[str, DataFrame]:
    """Every table of a store that refers to facts, rewritten; tables a store lacks are left out."""
    out = dict(tables)
    for name, column, action in REFERENCES:
        if name in out and column in out[name].columns:
            out[name] = merged_rows(out[name], losers, action, column)
    return out


def orphans(facts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, fact_id): references to facts that are not there, over every referring column."""
    ids = facts.select("fact_id")
    parts = [facts.select(F.lit("facts").alias("table"), F.lit("superseded_by").alias("column"), F.col("superseded_by").alias("fact_id"))]
    parts += [tables[n].select(F.lit(n).alias("table"), F.lit(c).alias("column"), F.col(c).alias("fact_id")) for n, c, _ in REFERENCES if n in tables and c in tables[n].columns]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("fact_id is not null").distinct().join(ids, "fact_id", "left_anti").select("table", "column", "fact_id")
