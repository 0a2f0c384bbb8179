"""Evidence edges, attribution, coverage by vectors, and integrity of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .eligibility import active

EDGE = ["fact_id", "observation_id", "relation"]


def edges(provenance: DataFrame) -> DataFrame:
    """Distinct evidence edges; of repeated ones the first written stays."""
    return provenance.groupBy(*EDGE).agg(F.min(F.struct("created_at", "evidence_excerpt")).alias("x")).select(*EDGE, F.col("x.created_at").alias("created_at"), F.col("x.evidence_excerpt").alias("evidence_excerpt"))


def evidence(provenance: DataFrame, observations: DataFrame) -> DataFrame:
    """Edges with their observation, redacted text withheld."""
    o = observations.select("observation_id", "client_id", "source_type", "asserted_by", "recorded_at", "redacted_at")
    return edges(provenance).join(o, "observation_id").withColumn("redacted", F.col("redacted_at").isNotNull()).drop("redacted_at", "created_at")


def attribution(provenance: DataFrame, observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each fact's latest supporting observation with its session, and its number of edges."""
    o = observations.select("observation_id", "client_id", "session_id", "source_type", "recorded_at")
    s = sessions.select("client_id", "session_id", "agent_id", "repository")
    rows = edges(provenance).join(o, "observation_id").join(s, ["client_id", "session_id"])
    best = F.max_by(F.struct("observation_id", "client_id", "session_id", "source_type", "agent_id", "repository", "relation"), F.struct("recorded_at", "observation_id", "relation"))
    return rows.groupBy("fact_id").agg(F.count(F.lit(1)).alias("evidence_count"), best.alias("x")).select("fact_id", "evidence_count", "x.*")


def sources_of(facts: DataFrame, provenance: DataFrame, observations: DataFrame) -> DataFrame:
    """Every active fact with the number of its sources by relation; facts without any stay."""
    e = edges(provenance).join(observations.select("observation_id"), "observation_id", "left_semi")
    n = e.groupBy("fact_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("relation") == "supports").alias("supports"), F.count_if(F.col("relation") == "contradicts").alias("contradicts")
    )
    return facts.where(active()).select("fact_id").join(n, "fact_id", "left").select("fact_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "supports", "contradicts")])


def deduplicated_observations(observations: DataFrame) -> DataFrame:
    """First observation of each (client, content hash, session, source type)."""
    key = ["client_id", "content_sha256", "session_id", "source_type"]
    return observations.groupBy(*key).agg(F.min("observation_id").alias("observation_id"), F.count(F.lit(1)).alias("times"))


def identity_counts(vectors: DataFrame) -> DataFrame:
    """Vectors and facts of every embedding identity."""
    return vectors.groupBy("embedding_identity").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("fact_id").alias("facts"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"))


def uncovered(facts: DataFrame, vectors: DataFrame, jobs: DataFrame, identity: str) -> DataFrame:
    """Active facts without a vector of the identity and without a live job for one."""
    live = jobs.where((F.col("document_identity") == identity) & F.col("status").isin("pending", "processing")).select("fact_id")
    return coverage_gap(facts, vectors, identity).join(live, "fact_id", "left_anti")


def registered_sessions(contexts: DataFrame) -> DataFrame:
    """(client_id, session_id, ..., clash): sessions of connection contexts in order of ``n``: the first context stays, branch and commit are the latest; clash where any other field changed."""
    fixed = ["agent_id", "parent_agent_id", "project_root", "repository", "capabilities_json", "access_scopes_json"]
    first = [F.min_by(F.struct(c), "n")[c].alias(c) for c in (*fixed, "started_at")]
    same = F.count(F.lit(1)) > F.lit(0)
    for c in fixed:
        same &= F.countDistinct(F.coalesce(c, F.lit("\u0000"))) == 1
    return contexts.groupBy("client_id", "session_id").agg(*first, F.max_by(F.struct("branch"), "n")["branch"].alias("branch"), F.max_by(F.struct("commit_sha"), "n")["commit_sha"].alias("commit_sha"), (~same).alias("clash"))


def coverage_gap(facts: DataFrame, vectors: DataFrame, identity: str) -> DataFrame:
    """Active facts without a present vector of the identity."""
    have = vectors.where((F.col("embedding_identity") == identity) & F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("fact_id")
    return facts.where(active()).select("fact_id").join(have, "fact_id", "left_anti")


def backfill_plan(facts: DataFrame, vectors: DataFrame, identities: list[str]) -> DataFrame:
    """(fact_id, embedding_identity) jobs for every active fact and identity without a row."""
    want = facts.where(active() & F.col("content").isNotNull()).select("fact_id", F.explode(F.array(*[F.lit(i) for i in identities])).alias("embedding_identity"))
    return want.join(vectors.select("fact_id", "embedding_identity"), ["fact_id", "embedding_identity"], "left_anti")


def vector_health(vectors: DataFrame) -> DataFrame:
    """Per identity: null, zero, ill-sized and usable vectors."""
    v = F.col("embedding")
    null = v.isNull()
    bad = ~null & (F.size(v) != F.col("dim"))
    nan = ~null & F.exists(v, lambda x: x.isNull() | F.isnan(x))
    zero = ~null & ~F.exists(v, lambda x: x.isNull() | (x != 0))
    return vectors.groupBy("embedding_identity").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(null).alias("missing"), F.count_if(bad).alias("ill_sized"), F.count_if(nan).alias("broken"), F.count_if(zero).alias("zero"),
    )


def orphans(facts: DataFrame, observations: DataFrame, provenance: DataFrame, vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """(reference, missing_id, n): references to rows that are not there."""
    f = facts.select(F.col("fact_id").alias("id"))
    parts = [
        ("facts.superseded_by", facts.select(F.col("superseded_by").alias("id")), f),
        ("facts.object_entity_id", facts.select(F.col("object_entity_id").alias("id")), entities.select(F.col("entity_id").alias("id"))),
        ("fact_provenance.fact_id", provenance.select(F.col("fact_id").alias("id")), f),
        ("fact_provenance.observation_id", provenance.select(F.col("observation_id").alias("id")), observations.select(F.col("observation_id").alias("id"))),
        ("fact_embeddings.fact_id", vectors.select(F.col("fact_id").alias("id")), f),
    ]
    out = None
    for name, child, parent in parts:
        lost = child.where("id is not null").join(parent, "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("reference"), F.col("id").alias("missing_id"), "n")
        out = lost if out is None else out.unionByName(lost)
    return out


def row_counts(**tables: DataFrame) -> DataFrame:
    """(name, rows): the row count of each table."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def latest_session_context(sessions: DataFrame) -> DataFrame:
    """Sessions per client: how many, how many open, first start and the repositories met."""
    return sessions.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("ended_at").isNull()).alias("open"), F.countDistinct("repository").alias("repositories"), F.min("started_at").alias("first_started"),
    )


def resolved_subjects(facts: DataFrame, provenance: DataFrame, observations: DataFrame, entities: DataFrame) -> DataFrame:
    """(repository, entity_id, subject_key): the one subject key that an entity's facts use in a repository, null where several do."""
    rows = (
        facts.where("object_entity_id is not null").select("fact_id", F.col("object_entity_id").alias("entity_id"), "subject_key")
        .join(entities.select("entity_id"), "entity_id", "left_semi")
        .join(edges(provenance).select("fact_id", "observation_id"), "fact_id")
        .join(observations.select("observation_id", "repository"), "observation_id")
        .where("repository is not null and subject_key is not null")
    )
    g = rows.groupBy("repository", "entity_id").agg(F.min("subject_key").alias("lo"), F.max("subject_key").alias("hi"))
    return g.select("repository", "entity_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("subject_key"))
