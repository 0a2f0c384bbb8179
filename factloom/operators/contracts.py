"""What passes between a transcript, a model and the store: proposal documents, snapshots, write requests, verdicts."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extraction import MIN_CONFIDENCE, canonical_sha256, typed_fields
from .screens import credential_shaped, ephemeral_reason

# Fields of a proposal, typed fields, and the greatest lengths.
BASE = ("content", "category", "tags", "sensitivity", "evidence_span_id")
TYPED = ("kind", "subject", "predicate", "object", "value", "negation", "occurred_at", "valid_from", "confidence")
MAX_PROPOSALS, MAX_CONTENT, MAX_CATEGORY, MAX_TAGS, MAX_EVIDENCE = 16, 400, 64, 256, 2000


def proposal_schema(span_ids: list[str]) -> str:
    """The JSON schema that a model's answer must follow, with the transcript's spans as the only evidence it may name."""
    text = {"type": "string"}
    fields = {f: text for f in BASE} | {"evidence_span_id": {"type": "string", "enum": list(span_ids)}, "sensitivity": {"type": "string", "enum": ["normal", "sensitive"]}}
    fields |= {f: {"type": ["string", "null"]} for f in TYPED} | {"negation": {"type": ["boolean", "null"]}, "confidence": {"type": ["number", "null"], "minimum": 0, "maximum": 1}}
    item = {"type": "object", "additionalProperties": False, "required": list(BASE), "properties": fields}
    return json.dumps({"type": "object", "additionalProperties": False, "required": ["proposals"], "properties": {"proposals": {"type": "array", "maxItems": MAX_PROPOSALS, "items": item}}}, sort_keys=True)


def normalised(answer: str | None, spans: dict[str, str]) -> tuple[list[dict], str | None]:
    """(proposals, error): a model's document with its spans resolved to their exact text; the first fault rejects it whole."""
    try:
        said = json.loads(answer or "")
    except ValueError:
        return [], "invalid_document"
    if not isinstance(said, dict) or set(said) != {"proposals"} or not isinstance(said["proposals"], list):
        return [], "invalid_document"
    if len(said["proposals"]) > MAX_PROPOSALS:
        return [], "proposal_limit"
    out = []
    for p in said["proposals"]:
        if not isinstance(p, dict) or not set(BASE) <= set(p) or set(p) - set(BASE) - set(TYPED) or not all(isinstance(p[f], str) for f in BASE):
            return [], "invalid_fields"
        item = {f: p[f].strip() for f in BASE}
        excerpt = spans.get(item["evidence_span_id"])
        sized = 0 < len(item["content"]) <= MAX_CONTENT and 0 < len(item["category"]) <= MAX_CATEGORY and len(item["tags"]) <= MAX_TAGS
        if not sized or not excerpt or len(excerpt) > MAX_EVIDENCE or item["sensitivity"] not in ("normal", "sensitive"):
            return [], "invalid_values"
        typed = {f: p[f] for f in TYPED if p.get(f) is not None}
        number = typed.get("confidence")
        plain = all(isinstance(v, str) for f, v in typed.items() if f not in ("negation", "confidence"))
        if not plain or not isinstance(typed.get("negation", False), bool) or (number is not None and (isinstance(number, bool) or not isinstance(number, int | float) or not math.isfinite(number) or not 0 <= number <= 1)):
            return [], "invalid_typed_field"
        if any(f in typed and typed[f].strip() not in excerpt for f in ("occurred_at", "valid_from")):
            return [], "ungrounded_date"
        if typed:
            values = {"object", "value"} & set(typed)
            if not {"kind", "subject", "predicate", "confidence"} <= set(typed) or len(values) != (0 if typed.get("negation") else 1):
                return [], "incomplete_typed_fields"
        out.append({**item, "evidence_excerpt": excerpt, **{f: typed.get(f) for f in TYPED}})
    return out, None


_FIELDS = ["content", "category", "tags", "sensitivity", "evidence_span_id", "evidence_excerpt", "kind", "subject", "predicate", "object", "value", "negation", "occurred_at", "valid_from", "confidence"]


def documents(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """(case_id, item_no, error, fields...): answers (case_id, answer) with the spans (case_id, span_id, span) of their transcript; a faulty one is one row with its error."""
    known = spans.groupBy("case_id").agg(F.map_from_entries(F.collect_set(F.struct("span_id", "span"))).alias("spans"))
    rows = answers.join(known, "case_id", "left").select(F.col("case_id").cast("string"), "answer", "spans")

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.bool_() if f == "negation" else pa.float64() if f == "confidence" else pa.string() for f in _FIELDS]]
        for b in batches:
            out = []
            for case, answer, said in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                items, error = normalised(answer, dict(said or []))
                out += [(case, 0, error, *[None] * len(_FIELDS))] if error else [(case, i, None, *[x[f] for f in _FIELDS]) for i, x in enumerate(items)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["case_id", "item_no", "error", *_FIELDS])

    schema = "case_id string, item_no int, error string, " + ", ".join(f"`{f}` {'boolean' if f == 'negation' else 'double' if f == 'confidence' else 'string'}" for f in _FIELDS)
    return rows.mapInArrow(run, schema)


def snapshot(proposals: DataFrame, spans: DataFrame) -> DataFrame:
    """``proposals`` with dropped (why one is left out, or null), typed (canonical fields, or null) and demoted (typed fields that did not hold up).

    In order: the excerpt must be a span of the transcript, spoken by the user;
    no credentials; durable.
    """
    s = spans.select("case_id", F.col("span_id").alias("evidence_span_id"), F.col("span").alias("_said"), F.col("role").alias("_role"))
    r = proposals.join(s, ["case_id", "evidence_span_id"], "left")
    typed = typed_fields(F.col("kind"), F.col("subject"), F.col("predicate"), F.coalesce("value", "object"), F.lit(None).cast("long"), F.col("confidence"))
    dropped = (
        F.when(F.col("_said").isNull() | ~F.col("_said").eqNullSafe(F.col("evidence_excerpt")), "ungrounded").when(~F.col("_role").eqNullSafe("user"), "not_said_by_user")
        .when(credential_shaped(F.concat_ws("\n", "content", "evidence_excerpt", "category", "tags")), "credential_shaped").otherwise(ephemeral_reason(F.col("content")))
    )
    return r.withColumns({"dropped": dropped, "typed": typed, "demoted": F.col("kind").isNotNull() & typed.isNull()}).drop("_said", "_role")


def snapshot_digest(kept: DataFrame) -> DataFrame:
    """(case_id, proposals, sha256): the kept proposals of each case in canonical form, and their digest."""
    line = F.concat_ws("", canonical_sha256("content", "category", "tags", "sensitivity", "evidence_span_id"))
    g = kept.where("dropped is null").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("item_no", line.alias("h")))).alias("x"))
    return g.select("case_id", F.size("x").alias("proposals"), F.sha2(F.array_join(F.transform("x", lambda y: y.h), ""), 256).alias("sha256"))


def write_requests(kept: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Write requests of a snapshot: an idempotency key by payload and place, authority by the speaker, review where the evidence is weak.

    ``envelopes``: case_id, client_id, session_id, scope, payload_sha256.
    """
    r = kept.where("dropped is null").join(envelopes, "case_id")
    sure = F.coalesce(F.col("confidence"), F.lit(0.0)) >= MIN_CONFIDENCE
    return r.select(
        F.concat_ws(":", F.lit("extract"), "payload_sha256", F.col("item_no").cast("string")).alias("idempotency_key"), "client_id", "session_id", "scope", "content", "category", "tags", "sensitivity", F.lit("extraction").alias("source_type"),
        F.lit("derived_from").alias("relation"), F.when(F.col("typed").isNotNull() & sure, F.lit(0.6)).otherwise(F.lit(0.4)).alias("source_authority"), F.when(F.col("typed").isNull(), F.lit("unreviewed")).alias("correction_status"), "typed", "evidence_excerpt",
    )


def verdict(answer: Column) -> Column:
    """supported or unsupported, if that is all the answer says; null otherwise."""
    said = F.from_json(answer, "map<string, string>")
    v = F.element_at(said, F.lit("verdict"))
    return F.when(F.try_parse_json(answer).isNotNull() & (F.size(said) == 1) & v.isin("supported", "unsupported"), v)


#: Names that a request may not carry: who is asking is known from the connection.
IDENTITY = ("client_id", "session_id", "agent_id", "parent_agent_id", "access_scopes", "capabilities")


def refuse_identity(params, path: str = "") -> None:
    """Raises where a nested request names who is asking."""
    if isinstance(params, dict):
        for k, v in params.items():
            if k in IDENTITY:
                raise ValueError(f"identity field not allowed: {path}{k}")
            refuse_identity(v, f"{path}{k}.")
    elif isinstance(params, list | tuple):
        for i, v in enumerate(params):
            refuse_identity(v, f"{path}{i}.")
