"""The tables' schemas, and a check that fails closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

DDL = {
    "facts": (
        "fact_id long, content string, category string, tags string, trust_score double, retrieval_count long, helpful_count long, created_at string, updated_at string, "
        "hrr_vector binary, valid_from string, valid_to string, invalid_at string, expired_at string, superseded_by long, memory_kind string, subject_key string, "
        "predicate_key string, object_value string, object_entity_id long, confidence double, source_authority double, scope string, sensitivity string, "
        "correction_status string, schema_version int, conflict_group string"
    ),
    "observations": (
        "observation_id long, client_id string, session_id string, source_type string, source_uri string, project_root string, repository string, branch string, commit_sha string, "
        "observation_content string, content_sha256 string, asserted_by string, performed_by string, observed_at string, recorded_at string, scope string, sensitivity string, "
        "redacted_at string, metadata_json string"
    ),
    "fact_provenance": "fact_id long, observation_id long, relation string, evidence_excerpt string, created_at string",
    "fact_embeddings": "fact_id long, embedding array<float>, dim int, embedding_identity string, created_at string",
    "memory_sessions": (
        "session_id string, client_id string, agent_id string, parent_agent_id string, project_root string, repository string, branch string, commit_sha string, "
        "capabilities_json string, access_scopes_json string, started_at string, ended_at string"
    ),
    "entities": "entity_id long, name string, entity_type string, aliases string, created_at string",
}


def check_schema(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame if it has the table's columns with their types; raises with the differences otherwise."""
    want = {f.name: f.dataType.simpleString() for f in _parse_datatype_string(DDL[name])}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = sorted(f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in want.items() if have.get(c) != t)
    if wrong:
        raise ValueError(f"{name}: " + "; ".join(wrong))
    return df


def with_missing_columns(df: DataFrame, name: str) -> DataFrame:
    """Legacy tables: columns they lack are added as nulls."""
    empty = df.sparkSession.createDataFrame([], _parse_datatype_string(DDL[name]))
    return empty.unionByName(df, allowMissingColumns=True)
