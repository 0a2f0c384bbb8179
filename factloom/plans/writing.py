"""Queries over the write path, slot keys, names in queries, answers, jobs, identities and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors, context, contracts, dedup, embedding, erasure, jobs, keys, lexical, projections, prompts, provenance, ranking, reflection, screens, service, writes
from ..operators.best import best
from ..operators.dense import present
from ..runtime import Cut
from ..sources.tables import table
from .retrieval import _BM25, _C, _G, _NORMAL, _TOP, _bm25_top, _keep, _lit, _reason, _sql_match, _words_sql
from .store import _JOBS, _PRESENT, ACTIVE, IDENTITY, NOW, SCOPES, _jobs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SENSITIVE_CLIENTS = ("client-olsanodell-0",)
CORRECTORS = ("client-olsanodell-0", "client-quabanolin-3")
CLOCK = "2026-01-01T00:00:00Z"
NEAR = 0.3  # the test vectors of facts that the merge guard lets meet are far apart


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- policy -------------------------------------------------------------------------------------

def requests(spark, sf):
    """Every distinct evidence edge as the request that wrote it: its fact, its observation's client and source."""
    e = provenance.edges(table(spark, sf, "fact_provenance")).select("fact_id", "observation_id", "relation")
    o = table(spark, sf, "observations").select("observation_id", "client_id", "source_type")
    f = table(spark, sf, "facts").select("fact_id", "scope", "sensitivity", "content", "source_authority", "trust_score", "correction_status", "subject_key", "predicate_key", F.col("superseded_by").alias("supersede_fact_id"))
    r = e.join(o, "observation_id").join(f, "fact_id")
    return r.withColumn("request_id", F.concat_ws(":", "fact_id", "observation_id", "relation"))


_R = """r AS (SELECT concat(p.fact_id, ':', p.observation_id, ':', p.relation) AS request_id, o.client_id, o.source_type, p.relation, f.scope, f.sensitivity, f.content, f.source_authority, f.trust_score,
  f.correction_status, f.subject_key, f.predicate_key, f.superseded_by AS supersede_fact_id
  FROM (SELECT DISTINCT fact_id, observation_id, relation FROM fact_provenance) p JOIN observations o USING (observation_id) JOIN facts f USING (fact_id)),
h AS (SELECT *, coalesce(source_type = 'human_correction' OR relation = 'corrects' OR correction_status IN ('human_corrected', 'human_confirmed'), FALSE) AS human FROM r)"""
_POLICY = f"""{_R},
d AS (SELECT *, CASE WHEN scope = 'secret' OR sensitivity = 'secret' THEN 'rejected|secret durable writes are disabled'
  WHEN sensitivity = 'sensitive' AND NOT coalesce(client_id IN {_words_sql(SENSITIVE_CLIENTS)}, FALSE) THEN 'rejected|sensitive durable write is not authorized'
  WHEN human AND NOT coalesce(client_id IN {_words_sql(CORRECTORS)}, FALSE) THEN 'needs_review|client is not authorized to assert human correction'
  WHEN {_sql_match("coalesce(content, '')", screens.CREDENTIALS)} THEN 'rejected|credential-shaped content' END AS x FROM h),
e AS (SELECT *, split_part(x, '|', 1) AS outcome, split_part(x, '|', 2) AS reason FROM d)"""


def _evaluated(spark, sf):
    return writes.evaluated(requests(spark, sf), SENSITIVE_CLIENTS, CORRECTORS)


@query(f"WITH {_POLICY} SELECT request_id, nullif(outcome, '') AS outcome, nullif(reason, '') AS reason FROM e")
def write_policy(spark, sf):
    return _evaluated(spark, sf).select("request_id", "outcome", "reason")


@query(f"""
WITH {_R} SELECT request_id, CASE WHEN t.fact_id IS NULL OR t.scope IS DISTINCT FROM h.scope THEN 'supersession target is unavailable' WHEN t.memory_kind = 'state' THEN 'typed state requires state-slot supersession'
  WHEN t.conflict_group IS NOT NULL THEN 'open-conflict members cannot be explicitly superseded' WHEN t.correction_status IN ('human_corrected', 'human_confirmed') AND NOT human THEN 'target is protected by human correction'
  WHEN coalesce(t.source_authority, 0.5) > coalesce(h.source_authority, 0.5) THEN 'target has higher source authority' END AS reason
FROM h LEFT JOIN facts t ON t.fact_id = h.supersede_fact_id WHERE h.supersede_fact_id IS NOT NULL""")
def supersession_policy(spark, sf):
    return writes.superseding(requests(spark, sf), table(spark, sf, "facts")).select("request_id", "reason")


@query(f"WITH {_POLICY} SELECT request_id, coalesce(max(CASE WHEN outcome = 'rejected' THEN 1 ELSE 0 END) OVER (PARTITION BY client_id), 0) = 0 AS committed FROM e")
def batch_commit(spark, sf):
    """Each client's requests as one batch, written whole or not at all."""
    return writes.batches(_evaluated(spark, sf), "client_id").select("request_id", "committed")


_REVIEWS = f"""{_POLICY}, v AS (SELECT 'review:' || substr(sha256(concat_ws(chr(1), request_id, content, reason)), 1, 24) AS review_id, reason, scope, content, subject_key, predicate_key FROM e WHERE outcome = 'needs_review')"""


@query(f"WITH {_REVIEWS} SELECT review_id, reason, scope FROM v")
def review_queue(spark, sf):
    return writes.review_rows(_evaluated(spark, sf), CLOCK, "request_id").select("review_id", "reason", "scope")


@query(f"WITH {_REVIEWS} SELECT review_id, reason FROM v WHERE scope = 'private' ORDER BY review_id OFFSET 10 LIMIT 50")
def review_page(spark, sf):
    return writes.review_page(writes.review_rows(_evaluated(spark, sf), CLOCK, "request_id"), "private", 50, 10).select("review_id", "reason")


@query("""
SELECT fact_id AS promoted_from_fact_id, scope AS promoted_from_scope, 'private' AS scope, coalesce(category, 'general') AS category, coalesce(sensitivity, 'normal') AS sensitivity, concat('fact:', fact_id) AS source_uri
FROM facts WHERE regexp_matches(scope, '^run:[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AND invalid_at IS NULL AND superseded_by IS NULL""")
def promotion_requests(spark, sf):
    return writes.promoted(table(spark, sf, "facts"), "private", ["private"]).select("promoted_from_fact_id", "promoted_from_scope", "scope", "category", "sensitivity", "source_uri")


def _restated(spark, sf):
    from ..operators.contradictions import restatements

    return restatements(table(spark, sf, "facts"))


def _restatement_cte() -> str:
    from .retrieval import _restatement_sql

    return f"p AS (SELECT * FROM ({_restatement_sql()}))"


_MERGED = f"""{_restatement_cte()}, m AS (SELECT newer, older, NOT (coalesce(o.memory_kind = 'state', FALSE) OR coalesce(o.correction_status IN ('human_corrected', 'human_confirmed'), FALSE)
  OR coalesce(o.source_authority, 0) > coalesce(n.source_authority, 0.5)) AND (coalesce(n.trust_score, 0) > coalesce(o.trust_score, 0) OR (coalesce(n.trust_score, 0) = coalesce(o.trust_score, 0) AND coalesce(n.created_at, '') > coalesce(o.created_at, ''))) AS wins
  FROM p JOIN facts n ON n.fact_id = newer JOIN facts o ON o.fact_id = older)"""


@query(f"WITH {_MERGED} SELECT newer, older, CASE WHEN wins THEN newer ELSE older END AS winner, CASE WHEN wins THEN older ELSE newer END AS loser FROM m")
def near_merge_winner(spark, sf):
    """Restated facts as near-duplicates: who stays."""
    return writes.near_merged(_restated(spark, sf), table(spark, sf, "facts"))


@query(f"""
WITH {_MERGED}, l AS (SELECT CASE WHEN wins THEN older ELSE newer END AS fact_id, min(CASE WHEN wins THEN newer ELSE older END) AS w FROM m GROUP BY 1)
SELECT fact_id, CASE WHEN w IS NOT NULL AND invalid_at IS NULL AND superseded_by IS NULL THEN '{CLOCK}' ELSE invalid_at END AS invalid_at,
  CASE WHEN w IS NOT NULL AND invalid_at IS NULL AND superseded_by IS NULL THEN w ELSE superseded_by END AS superseded_by FROM facts LEFT JOIN l USING (fact_id)""")
def near_superseded(spark, sf):
    f = table(spark, sf, "facts")
    return writes.superseded(f, writes.near_merged(_restated(spark, sf), f).select("loser", "winner"), CLOCK).select("fact_id", "invalid_at", "superseded_by")


@query()
def untyped_conflicts(spark, sf):
    """Contradicting untyped claims as labelled open conflicts."""
    from ..operators.contradictions import contradiction_pairs

    f = table(spark, sf, "facts")
    return writes.untyped_conflicts(contradiction_pairs(f), f)


@query("""
WITH c AS (SELECT conflict_group, min(scope) AS scope FROM facts WHERE conflict_group IS NOT NULL GROUP BY 1)
SELECT f.conflict_group AS conflict_id, fact_id, CASE WHEN f.scope IS DISTINCT FROM c.scope THEN 'member is not in the same scope and group' WHEN memory_kind = 'state' THEN 'typed state must use the state conflict path'
  WHEN invalid_at IS NOT NULL OR superseded_by IS NOT NULL THEN 'member is not current' END AS problem FROM facts f JOIN c USING (conflict_group)""")
def conflict_member_check(spark, sf):
    f = table(spark, sf, "facts").where("conflict_group is not null")
    conflicts = f.groupBy(F.col("conflict_group").alias("conflict_id")).agg(F.min("scope").alias("scope"))
    return writes.member_problem(f.select(F.col("conflict_group").alias("conflict_id"), "fact_id"), table(spark, sf, "facts"), conflicts)


@query(f"""
WITH c AS (SELECT conflict_group, max(fact_id) AS w FROM facts WHERE conflict_group IS NOT NULL GROUP BY 1), s AS (SELECT c.*, valid_from AS vf FROM c JOIN facts ON fact_id = w)
SELECT fact_id, CASE WHEN fact_id = w THEN NULL ELSE f.conflict_group END AS conflict_group, CASE WHEN fact_id <> w AND invalid_at IS NULL THEN w ELSE superseded_by END AS superseded_by,
  CASE WHEN fact_id <> w AND invalid_at IS NULL THEN vf ELSE valid_to END AS valid_to FROM facts f LEFT JOIN s ON s.conflict_group = f.conflict_group""")
def resolved_conflicts(spark, sf):
    """Every open conflict resolved to its newest member by an authorized client."""
    f = table(spark, sf, "facts")
    choice = f.where("conflict_group is not null").groupBy("conflict_group").agg(F.max("fact_id").alias("winner")).withColumn("client_id", F.lit("resolver"))
    return writes.resolved(f, choice, ["resolver"], CLOCK).select("fact_id", "conflict_group", "superseded_by", "valid_to")


@query(f"""
SELECT fact_id AS seq, CASE WHEN valid_to IS NOT NULL THEN '{CLOCK}' END AS invalid_at, 'state' AS memory_kind FROM facts WHERE memory_kind = 'state' AND object_value IS NOT NULL""")
def persisted_states(spark, sf):
    c = table(spark, sf, "facts").where("memory_kind = 'state' and object_value is not null").select(F.col("fact_id").alias("seq"), "object_value", "valid_to")
    return writes.persisted(c, CLOCK).select("seq", "invalid_at", "memory_kind")


@query("""
WITH t AS (SELECT max(fact_id) AS top FROM facts), n AS (SELECT observation_id, observation_content, row_number() OVER (ORDER BY observation_id) AS i FROM observations WHERE trim(coalesce(observation_content, '')) <> '')
SELECT fact_id, content FROM facts UNION ALL SELECT top + i, observation_content FROM n, t""")
def inserted_facts(spark, sf):
    """Observations written as facts: numbered on from the last one."""
    o = table(spark, sf, "observations").where("trim(coalesce(observation_content, '')) != ''")
    rows = o.select("observation_id", F.col("observation_content").alias("content"), F.lit("private").alias("scope"), F.lit(0.5).alias("trust_score"))
    return writes.inserted(table(spark, sf, "facts"), rows, "observation_id", CLOCK).select("fact_id", "content")


@query("SELECT fact_id, object_entity_id AS entity_id FROM facts WHERE object_entity_id IS NOT NULL UNION SELECT f.fact_id, entity_id FROM facts f JOIN entities e ON lower(e.name) = lower(f.object_value)")
def entity_links(spark, sf):
    f = table(spark, sf, "facts")
    old = f.where("object_entity_id is not null").select("fact_id", F.col("object_entity_id").alias("entity_id"))
    e = table(spark, sf, "entities").select("entity_id", F.lower("name").alias("n"))
    return writes.linked(old, f.select("fact_id", F.lower("object_value").alias("n")).join(e, "n"))


@query("""
WITH l AS (SELECT fact_id, object_entity_id AS entity_id FROM facts WHERE object_entity_id IS NOT NULL)
SELECT fact_id, array_to_string(list_sort(list_distinct(list(lower(name)))), ',') AS names FROM l JOIN entities USING (entity_id) WHERE name IS NOT NULL GROUP BY 1""")
def fact_entity_names(spark, sf):
    """The lower-case names of each fact's entities."""
    l = table(spark, sf, "facts").where("object_entity_id is not null").select("fact_id", F.col("object_entity_id").alias("entity_id"))  # noqa: E741
    e = table(spark, sf, "entities").where("name is not null").select("entity_id", F.lower("name").alias("n"))
    return l.join(e, "entity_id").groupBy("fact_id").agg(F.array_join(F.sort_array(F.collect_set("n")), ",").alias("names"))


@query("""
SELECT client_id || ':' || session_id || ':' || sha256('{"observation":' || observation_id || '}') AS key, observation_id FROM observations WHERE client_id IS NOT NULL AND session_id IS NOT NULL""")
def idempotency_keys(spark, sf):
    o = table(spark, sf, "observations").where("client_id is not null and session_id is not null")
    canonical = F.concat(F.lit('{"observation":'), F.col("observation_id").cast("string"), F.lit("}"))
    return o.select(writes.idempotency_key(F.col("client_id"), F.col("session_id"), canonical).alias("key"), "observation_id")


@query(f"""
WITH o AS (SELECT observation_id AS proposal_id, {_NORMAL.format("coalesce(observation_content, '')")} AS n FROM observations),
r AS (SELECT proposal_id, trim(n, ' ') AS t, regexp_replace(n, '\\p{{Cf}}', '', 'g') AS x, n || chr(10) || 'general' || chr(10) AS y FROM o),
z AS (SELECT proposal_id, t, CASE WHEN t = '' THEN 'empty' ELSE {_reason('x', 'y')} END AS reason FROM r), k AS (SELECT DISTINCT trim(content, ' ') AS t FROM facts WHERE invalid_at IS NULL AND superseded_by IS NULL AND trim(content, ' ') <> ''),
m AS (SELECT *, row_number() OVER (PARTITION BY t, reason IS NULL ORDER BY proposal_id) AS n FROM z)
SELECT proposal_id, coalesce(reason, CASE WHEN t IN (SELECT t FROM k) OR n > 1 THEN 'duplicate' END) AS skipped FROM m""")
def insert_report(spark, sf):
    """Observations as extracted proposals: which would not be inserted, and why."""
    o = table(spark, sf, "observations").select(F.col("observation_id").alias("proposal_id"), F.col("observation_content").alias("content"), F.lit("general").alias("category"), F.lit("").alias("tags"))
    return writes.insert_report(screens.normal(o, "content"), table(spark, sf, "facts"))


# ---- keys and scopes ----------------------------------------------------------------------------

@query("""
SELECT scope, scope IN ('private', 'work', 'public', 'sensitive', 'secret') OR regexp_matches(scope, '^project:[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') OR regexp_matches(scope, '^run:[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AS known, CAST(count(*) AS BIGINT) AS n FROM facts WHERE scope IS NOT NULL GROUP BY 1""")
def scope_check(spark, sf):
    return table(spark, sf, "facts").where("scope is not null").groupBy("scope", keys.scope_known(F.col("scope")).alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT client_id, session_id, CASE WHEN regexp_matches('run:' || trim(x), '^run:[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') THEN 'run:' || trim(x) ELSE 'run:' || substr(sha256(trim(x)), 1, 24) END AS scope
FROM (SELECT *, session_id || repeat(' ü', CAST(length(client_id) % 2 AS INTEGER)) AS x FROM memory_sessions)""")
def run_scopes(spark, sf):
    """Run scopes of sessions, half of them under a token that does not fit."""
    s = table(spark, sf, "memory_sessions")
    token = F.concat("session_id", F.repeat(F.lit(" ü"), F.length("client_id") % 2))
    return s.select("client_id", "session_id", keys.run_scope(token).alias("scope"))


@query("""
SELECT client_id, session_id, array_to_string(list_filter(from_json(access_scopes_json, '["VARCHAR"]'), lambda x: x IN ('private', 'work', 'public')), ',') AS scopes FROM memory_sessions WHERE access_scopes_json IS NOT NULL""")
def granted_scopes(spark, sf):
    s = table(spark, sf, "memory_sessions").where("access_scopes_json is not null")
    asked = F.from_json("access_scopes_json", "array<string>")
    return s.select("client_id", "session_id", F.array_join(keys.granted_scopes(asked, F.array(*[F.lit(x) for x in ("private", "work", "public")])), ",").alias("scopes"))


_PREDICATE = r"CASE WHEN regexp_matches({k}, '^[a-z0-9][a-z0-9._-]{{0,63}}$') THEN {k} END"
_KEY = r"regexp_replace(lower(trim({c})), '[\s-]+', '_', 'g')"
_KNOWN_SQL = f"""known AS (SELECT DISTINCT predicate FROM (SELECT {_PREDICATE.format(k=_KEY.format(c='predicate_key'))} AS predicate FROM facts WHERE {ACTIVE} AND scope = 'private' AND predicate_key IS NOT NULL
  UNION ALL SELECT unnest({list(keys.PREDICATES)})) WHERE predicate IS NOT NULL)"""
_PLURAL = "CASE WHEN regexp_matches({c}, '(s|x|z|ch|sh)$') THEN {c} || 'es' WHEN regexp_matches({c}, '[^aeiou_]y$') THEN substr({c}, 1, length({c}) - 1) || 'ies' ELSE {c} || 's' END"


@query(f"WITH {_KNOWN_SQL} SELECT predicate FROM known")
def predicate_registry(spark, sf):
    return keys.registry(table(spark, sf, "facts"), "private")


@query(f"""
WITH {_KNOWN_SQL}, s AS (SELECT fact_id, {_KEY.format(c='x')} AS k FROM (SELECT fact_id, CASE WHEN fact_id % 2 = 0 THEN predicate_key ELSE {_PLURAL.format(c='predicate_key')} END AS x FROM facts WHERE predicate_key IS NOT NULL)),
p AS (SELECT {_PLURAL.format(c='predicate')} AS k, min(predicate) AS one, count(*) AS n FROM known GROUP BY 1)
SELECT fact_id, CASE WHEN known.predicate IS NOT NULL THEN s.k WHEN n = 1 THEN one ELSE s.k END AS resolved FROM s LEFT JOIN p ON p.k = s.k LEFT JOIN known ON known.predicate = s.k""")
def extracted_predicates(spark, sf):
    """Predicates as an extractor might write them, every other one in the plural."""
    f = table(spark, sf, "facts")
    said = f.where("predicate_key is not null").select("fact_id", F.when(F.col("fact_id") % 2 == 0, F.col("predicate_key")).otherwise(keys.plural(F.col("predicate_key"))).alias("said"))
    return keys.extracted_predicate_keys(said, "said", keys.registry(f, "private")).select("fact_id", "resolved")


@query(r"""
WITH s AS (SELECT fact_id, regexp_replace(subject_key, '^(project|service|person):', '\1s : ') AS said FROM facts WHERE subject_key IS NOT NULL),
k AS (SELECT fact_id, regexp_replace(lower(trim(regexp_replace(said, '\s*:\s*', ':', 'g'))), '\s+', '_', 'g') AS k FROM s),
v AS (SELECT fact_id, CASE WHEN regexp_matches(k, '^[a-z0-9][a-z0-9._:/-]{0,127}$') THEN k END AS k FROM k),
p AS (SELECT fact_id, k, split_part(k, ':', 1) AS kind, regexp_replace(substr(k, instr(k, ':') + 1), '^[_-]+|[_-]+$', '', 'g') AS payload FROM v)
SELECT fact_id, CASE WHEN instr(k, ':') = 0 THEN k WHEN kind IN ('agents','bots','courses','course_sections','crons','environments','persons','projects','services','trips') THEN substr(kind, 1, length(kind) - 1) || ':' || payload ELSE kind || ':' || payload END AS subject FROM p""")
def extracted_subjects(spark, sf):
    """Subjects as an extractor might write them: plural kinds, blanks around the colon."""
    said = F.regexp_replace("subject_key", "^(project|service|person):", "$1s : ")
    return table(spark, sf, "facts").where("subject_key is not null").select("fact_id", keys.extracted_subject_key(said).alias("subject"))


@query(f"""
SELECT fact_id, CASE WHEN subject_key IS NOT NULL AND predicate_key IS NOT NULL THEN regexp_replace(lower(trim(subject_key)), '\\s+', '_', 'g') ELSE subject_key END AS subject_key,
  CASE WHEN subject_key IS NOT NULL AND predicate_key IS NOT NULL THEN {_KEY.format(c='predicate_key')} ELSE predicate_key END AS predicate_key FROM facts""")
def canonical_slots(spark, sf):
    return keys.canonical_slots(table(spark, sf, "facts")).select("fact_id", "subject_key", "predicate_key")


# ---- names in queries ---------------------------------------------------------------------------

_SKIP = _words_sql([*anchors.MONTHS, *anchors.MONTH_ALIASES])
_VERBS, _OPEN = _words_sql(anchors.REQUEST_VERBS), _words_sql(anchors.OPENERS)
_ANCHOR_SQL = f"""w AS (SELECT fact_id, regexp_extract_all(content, '[A-Za-z][A-Za-z0-9_-]*|[0-9]+') AS w FROM facts WHERE content IS NOT NULL),
u AS (SELECT fact_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
n AS (SELECT *, regexp_matches(x, '^[A-Z]') AND x <> 'I' AND lower(x) NOT IN {_SKIP} AND NOT (i = 1 AND x IN {_OPEN}) AS named FROM u),
f AS (SELECT fact_id, min(i) AS first FROM n WHERE named AND x NOT IN {_VERBS} GROUP BY 1),
k AS (SELECT n.fact_id, x FROM n LEFT JOIN f USING (fact_id) WHERE named AND (x NOT IN {_VERBS} OR coalesce(i > first, FALSE))),
s AS (SELECT fact_id, unnest(string_split_regex(x, '[-_]')) AS p, unnest(range(1, len(string_split_regex(x, '[-_]')) + 1)) AS j FROM k),
a AS (SELECT DISTINCT fact_id, lower(p) AS anchor FROM s WHERE p <> '' AND (j = 1 OR regexp_matches(p, '^[A-Z]|^[0-9]+$')))"""


@query(f"WITH {_ANCHOR_SQL} SELECT fact_id, anchor FROM a")
def anchor_tokens(spark, sf):
    """The names in every fact's text, read as if it were a query."""
    f = table(spark, sf, "facts").where("content is not null")
    return f.select("fact_id", F.explode(anchors.anchor_tokens(F.col("content"))).alias("anchor"))


def named_queries(spark, sf):
    """A stated query set with names: the opening words of the facts whose identifier is divisible by 20."""
    f = table(spark, sf, "facts").where("fact_id % 20 = 0 and content is not null")
    return f.select(F.col("fact_id").alias("query_id"), F.concat(F.lit("What of "), F.array_join(F.slice(F.split(F.trim("content"), r"\s+"), 1, 4), " ")).alias("query"))


def _match_sql() -> str:
    short, full = list(anchors.MONTH_ALIASES), list(anchors.MONTH_ALIASES.values())
    months = ", ".join(f"CASE WHEN list_contains(t, '{a}') THEN '{b}' END, CASE WHEN list_contains(t, '{b}') THEN '{a}' END" for a, b in zip(short, full, strict=True))
    grams = "list_transform(range(1, greatest(len(t) - {n} + 2, 1)), lambda i: array_to_string(list_slice(t, i, i + {n} - 1), ''))"
    return f"""mt AS (SELECT fact_id, list_distinct(list_concat(t, list_filter([{months}], lambda x: x IS NOT NULL), {grams.format(n=2)}, {grams.format(n=3)})) AS m
  FROM (SELECT fact_id, regexp_extract_all(lower(coalesce(content, '') || ' ' || coalesce(tags, '')), '[a-z0-9]+') AS t FROM facts))"""


_NAMED = f"""q AS (SELECT fact_id AS query_id, 'What of ' || array_to_string(list_slice(string_split_regex(trim(content, ' '), '\\s+'), 1, 4), ' ') AS query FROM facts WHERE fact_id % 20 = 0 AND content IS NOT NULL),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS token FROM q)"""
_NAMED_BM25 = _NAMED + _BM25[_BM25.index(",\nd AS ("):]
_QUERY_ANCHORS = _ANCHOR_SQL.replace("SELECT fact_id, regexp_extract_all(content, '[A-Za-z][A-Za-z0-9_-]*|[0-9]+') AS w FROM facts WHERE content IS NOT NULL", "SELECT query_id AS fact_id, regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_-]*|[0-9]+') AS w FROM q").replace("f AS (SELECT fact_id, min(i)", "fi AS (SELECT fact_id, min(i)").replace("FROM n LEFT JOIN f USING", "FROM n LEFT JOIN fi USING")
_HITS = f"""{_NAMED_BM25}, {_TOP}, {_QUERY_ANCHORS}, {_match_sql()}, qa AS (SELECT fact_id AS query_id, list(anchor) AS a, list(anchor) FILTER (WHERE anchor <> 'project') AS ra FROM a GROUP BY 1),
hh AS (SELECT t.query_id, t.fact_id, t.rank, t.bm25, coalesce(len(qa.a), 0) AS n, coalesce(len(ra), 0) AS rn, len(list_intersect(coalesce(qa.a, []), m)) AS hit, len(list_intersect(coalesce(ra, []), m)) AS rhit FROM t JOIN mt USING (fact_id) LEFT JOIN qa ON qa.query_id = t.query_id)"""


@query(f"""
WITH {_HITS}, hb AS (SELECT *, max(hit) OVER (PARTITION BY query_id) AS best, max(rhit) OVER (PARTITION BY query_id) AS rbest FROM hh WHERE rank <= 30)
SELECT query_id, fact_id, CAST(rank AS INTEGER) AS rank FROM hb WHERE n = 0 OR CASE WHEN best = n THEN hit = n WHEN rn > 0 AND rn < n THEN rbest > 0 AND rhit = rbest ELSE best > 0 AND hit = best END""")
def anchor_gate(spark, sf):
    """The best thirty facts by BM25 of queries with names, and the gate's choice among them."""
    f, q = table(spark, sf, "facts"), named_queries(spark, sf)
    t = Cut(spark, "named")(lexical.bm25_top(f, q, _keep(), 30).select("query_id", "fact_id", "rank"), "ranked")
    return anchors.gate(t, f, q)


@query(f"WITH {_HITS} SELECT query_id, fact_id, round(bm25, 6) AS score FROM hh WHERE rank <= 10 AND hit = n")
def strict_anchor_search(spark, sf):
    """Current facts by BM25 that hold every name of their query."""
    f, q = table(spark, sf, "facts"), named_queries(spark, sf)
    t = lexical.bm25_top(f, q, _keep(), 10)
    return anchors.strict(t, f, q).select("query_id", "fact_id", F.round("bm25", 6).alias("score"))


# ---- answers ------------------------------------------------------------------------------------

_STATUS = "CASE correction_status WHEN 'human_confirmed' THEN 'confirmed' WHEN 'human_corrected' THEN 'corrected' ELSE 'unreviewed' END"


@query(f"""
WITH p AS (SELECT fact_id, count(*) AS n FROM (SELECT DISTINCT fact_id, observation_id, relation FROM fact_provenance) GROUP BY 1)
SELECT fact_id AS id, content AS text, {_STATUS} AS review, 'unknown' AS source, CAST(coalesce(n, 0) AS INTEGER) AS evidence FROM facts LEFT JOIN p USING (fact_id) WHERE conflict_group IS NULL AND coalesce(content, '') <> ''""")
def recall_rows(spark, sf):
    n = provenance.edges(table(spark, sf, "fact_provenance")).groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"))
    return prompts.recall_rows(table(spark, sf, "facts").join(n, "fact_id", "left"), F.lit(""), F.col("n"))


@query(f"SELECT fact_id AS id, coalesce(content, '') AS text, valid_from, invalid_at, superseded_by AS replaced_by, {_STATUS} AS review, valid_to, expired_at FROM facts")
def history_rows(spark, sf):
    return prompts.history_rows(table(spark, sf, "facts"))


@query("""
WITH e AS (SELECT fact_id, observation_id, relation, min({'a': created_at, 'b': evidence_excerpt}) AS x FROM fact_provenance GROUP BY 1, 2, 3)
SELECT fact_id, coalesce(nullif(source_type, ''), 'unknown') AS source, coalesce(nullif(asserted_by, ''), nullif(performed_by, '')) AS by, observed_at, coalesce(nullif(x.b, ''), nullif(observation_content, ''), '') AS excerpt, coalesce(nullif(relation, ''), 'supports') AS relation
FROM e JOIN observations USING (observation_id)""")
def evidence_view(spark, sf):
    e = provenance.edges(table(spark, sf, "fact_provenance"))
    o = table(spark, sf, "observations").select("observation_id", "source_type", "asserted_by", "performed_by", "observed_at", "observation_content")
    return prompts.evidence_view(e.join(o, "observation_id"))


@query("""
SELECT fact_id, CASE WHEN CAST(floor((length(content) + 3) / 4.0) AS BIGINT) <= 12 THEN content ELSE rtrim(substr(content, 1, 47)) || '…' END AS fitted, CASE WHEN length(content) <= 60 THEN content ELSE rtrim(substr(content, 1, 47)) || '… [truncated]' END AS cut FROM facts WHERE content IS NOT NULL""")
def fitted_texts(spark, sf):
    """Texts cut to twelve estimated tokens, and to sixty characters with a marker."""
    from ..functions.text import truncated

    f = table(spark, sf, "facts").where("content is not null")
    return f.select("fact_id", prompts.fitted(F.col("content"), F.lit(12)).alias("fitted"), truncated(F.col("content"), 60, prompts.MARKER).alias("cut"))


@query(f"""
SELECT fact_id, CASE WHEN correction_status = 'unreviewed' THEN 'unreviewed_content' WHEN NOT regexp_matches(t, {_lit(screens.VISIBLE)}) OR {_sql_match('t', (screens.STRUCTURE, screens.CONTROL, screens.DISCLOSURE))} THEN 'instruction_shaped_content' END AS reason
FROM (SELECT fact_id, correction_status, {_C} AS t FROM facts)""")
def prompt_rejections(spark, sf):
    f = screens.normal(table(spark, sf, "facts"), "content")
    return f.select("fact_id", prompts.rejection(F.col("content"), F.col("correction_status")).alias("reason"))


@query(f"WITH {_BM25}, {_TOP} SELECT query_id, fact_id FROM t WHERE rank <= 10 AND fact_id NOT IN (SELECT fact_id FROM facts WHERE invalid_at IS NOT NULL)")
def temporally_valid(spark, sf):
    return prompts.without_invalid(_bm25_top(spark, sf), table(spark, sf, "facts"))[0].select("query_id", "fact_id")


@query()
def context_pack(spark, sf):
    """The prompt of every query: reviewed first, receipts of conflicts, one line a slot, unsafe texts left out."""
    from ..operators import expansion
    from .retrieval import search_queries

    f = table(spark, sf, "facts")
    # queries of one text have one prompt, which is packed once
    asked = search_queries(spark, sf)
    reps = Cut(spark, "pack")(asked.join(asked.groupBy("query").agg(F.min("query_id").alias("rep")), "query"), "queries")
    q = reps.where("query_id = rep").select("query_id", "query")
    slots = f.where("conflict_group is not null").groupBy("conflict_group").agg(F.min("subject_key").alias("s"), F.min("predicate_key").alias("p"), F.count(F.lit(1)).alias("n"))
    said = expansion.relevant_receipts(f, q).join(slots, "conflict_group").select("query_id", "conflict_group", prompts.receipt(F.col("conflict_group"), F.col("s"), F.col("p"), F.col("n")).alias("line"))
    ranked = ranking.lexical_first(f, q, SCOPES, NOW, limit=48).select("query_id", "rank", "fact_id", "score").join(f.select("fact_id", "content", "scope", "memory_kind", "subject_key", "predicate_key", "correction_status", "invalid_at", "superseded_by", "conflict_group"), "fact_id")
    done = prompts.packed(ranked, 400, said, 400)
    return done.withColumnRenamed("query_id", "rep").join(reps.select("rep", "query_id"), "rep").select(*done.columns)


@query()
def history_pages(spark, sf):
    """Each chain of replacement in pages of two hundred estimated tokens."""
    from ..operators.bitemporal import chain_history

    f = table(spark, sf, "facts")
    return prompts.pages(chain_history(f).join(f.select("fact_id", "content"), "fact_id"), "chain_id", "position", "content", 200).select("chain_id", "position", "fact_id", "page")


@query("""
SELECT request_id, CASE WHEN outcome IN ('inserted', 'add', 'supersede', 'superseded') THEN 'stored' WHEN outcome IN ('existing', 'dedup', 'deduped', 'deduplicated') THEN 'deduped' WHEN outcome = 'conflict' THEN 'conflicted' ELSE outcome END AS status
FROM (SELECT observation_id AS request_id, CASE observation_id % 6 WHEN 0 THEN 'inserted' WHEN 1 THEN 'dedup' WHEN 2 THEN 'conflict' WHEN 3 THEN 'needs_review' WHEN 4 THEN 'rejected' ELSE 'supersede' END AS outcome FROM observations)""")
def remembered(spark, sf):
    """What answers call the outcomes of writes."""
    i = F.col("observation_id") % 6
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("inserted", "dedup", "conflict", "needs_review", "rejected", "supersede")]), (i + 1).cast("int"))
    return table(spark, sf, "observations").select(F.col("observation_id").alias("request_id"), prompts.remembered(outcome).alias("status"))


# ---- jobs ---------------------------------------------------------------------------------------

def _queue(spark, sf):
    """The queue of ``queues.jobs`` with owners, leases and errors."""
    i = F.col("id")
    error = F.when(i % 3 == 0, F.concat(F.lit("usage_limit_reached resets_in_seconds: "), (i % 900).cast("string"))).when(i % 3 == 1, F.concat(F.lit("HTTP 429, resets_at="), (F.lit(NOW) + i % 700).cast("string"))).otherwise(F.lit("boom"))
    return _jobs(spark, sf).withColumns({"lease_owner": F.when(F.col("status") == "processing", F.concat(F.lit("w"), (i % 2).cast("string"))), "last_error": error, "proposal_json": F.lit(None).cast("string")})


_QUEUE = f"""{_JOBS}, q AS (SELECT *, CASE WHEN status = 'processing' THEN 'w' || (id % 2) END AS lease_owner,
  CASE WHEN id % 3 = 0 THEN 'usage_limit_reached resets_in_seconds: ' || (id % 900) WHEN id % 3 = 1 THEN 'HTTP 429, resets_at=' || ({NOW} + id % 700) ELSE 'boom' END AS last_error FROM jobs)"""
_DELAY = "CASE WHEN id % 3 = 0 THEN id % 900 + 60 WHEN id % 3 = 1 THEN id % 700 + 60 ELSE 1800 END"


@query(f"WITH {_QUEUE} SELECT id, id % 3 <> 2 AS quota, CAST({_DELAY} AS BIGINT) AS delay FROM q")
def quota_delays(spark, sf):
    q = _queue(spark, sf)
    return q.select("id", jobs.quota_error(F.col("last_error")).alias("quota"), jobs.quota_delay(F.col("last_error"), NOW).alias("delay"))


@query(f"""
WITH {_QUEUE}, h AS (SELECT *, status = 'processing' AND lease_owner = 'w0' AS hit, {NOW} - created > 172800 AS old, id % 3 <> 2 AS quota FROM q)
SELECT id, CASE WHEN hit AND (old OR (NOT quota AND attempts + 1 >= 5)) THEN 'dead' WHEN hit THEN 'pending' ELSE status END AS status, CAST(CASE WHEN hit AND NOT quota THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts,
  CAST(CASE WHEN hit AND quota AND NOT old THEN {NOW} + {_DELAY} WHEN hit AND quota THEN NULL ELSE not_before END AS BIGINT) AS not_before FROM h""")
def queue_failures(spark, sf):
    """The queue after every job of one worker failed."""
    q = _queue(spark, sf)
    return jobs.failed(q, q.select("id", F.col("last_error").alias("error")), "w0", NOW).select("id", "status", "attempts", "not_before")


@query(f"""
WITH {_QUEUE}, d AS (SELECT *, (status = 'pending' AND coalesce(not_before, 0) <= {NOW}) OR (status = 'processing' AND coalesce(lease_until, 0) <= {NOW}) AS due FROM q),
f AS (SELECT id FROM d WHERE due AND attempts < 5 ORDER BY created, id LIMIT 40)
SELECT id, CASE WHEN id IN (SELECT id FROM f) THEN 'processing' WHEN due AND attempts >= 5 THEN 'dead' ELSE status END AS status, CAST(CASE WHEN id IN (SELECT id FROM f) THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts,
  CASE WHEN id IN (SELECT id FROM f) THEN 'me' WHEN due AND attempts >= 5 THEN NULL ELSE lease_owner END AS lease_owner FROM d""")
def queue_claimed(spark, sf):
    return jobs.claimed(_queue(spark, sf), "me", NOW, 40).select("id", "status", "attempts", "lease_owner")


@query(f"WITH {_QUEUE} SELECT id, CASE WHEN lease_owner = 'w1' AND id % 3 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN lease_owner = 'w1' AND id % 3 = 0 THEN NULL ELSE lease_owner END AS lease_owner FROM q")
def queue_released(spark, sf):
    q = _queue(spark, sf)
    return jobs.released(q, q.where("id % 3 = 0").select("id"), "w1").select("id", "status", "lease_owner")


@query(f"WITH {_QUEUE} SELECT id FROM q WHERE NOT (coalesce(lease_owner, '') = 'w1' AND id % 4 = 0)")
def queue_done(spark, sf):
    q = _queue(spark, sf)
    return jobs.done(q, q.where("id % 4 = 0").select("id"), "w1").select("id")


@query(f"WITH {_QUEUE} SELECT id, CASE WHEN status IN ('pending', 'processing') AND row_number() OVER (PARTITION BY payload_hash, status IN ('pending', 'processing') ORDER BY id) = 1 THEN payload_hash END AS payload_hash FROM q")
def queue_hashes(spark, sf):
    return jobs.kept_hashes(_queue(spark, sf)).select("id", "payload_hash")


@query(f"WITH {_QUEUE} SELECT id FROM q WHERE (status = 'pending' AND coalesce(not_before, 0) <= {NOW}) OR (status = 'processing' AND coalesce(lease_until, 0) <= {NOW}) ORDER BY created, id LIMIT 25")
def queue_drain(spark, sf):
    return jobs.drained(_queue(spark, sf), NOW, 25).select("id")


@query()
def queue_proposals(spark, sf):
    """Proposals of one worker's jobs, screened and kept once."""
    q = _queue(spark, sf)
    o = table(spark, sf, "observations").select(F.col("observation_id").alias("id"), F.lit(0).alias("n"), F.col("observation_content").alias("content"))
    return jobs.saved(q, o, "w0").select("id", "proposal_json")


@query("""
SELECT doc_id AS id, CASE WHEN octet_length(encode(text)) > 12288 THEN 'oversized' WHEN NOT json_valid(text) OR NOT starts_with(ltrim(text), '{') THEN 'legacy_payload' ELSE 'unsupported_version' END AS reason FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0""")
def queue_envelopes(spark, sf):
    """Documents taken as payloads: what stands against each."""
    d = table(spark, sf, "documents").where("text is not null and doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"))
    return jobs.envelopes(d).select("id", "reason")


_LACK = f"SELECT fact_id, content FROM facts WHERE {ACTIVE} AND fact_id NOT IN (SELECT fact_id FROM fact_embeddings WHERE embedding_identity = '{IDENTITY}' AND dim = 64)"


@query(f"""
WITH l AS ({_LACK}), j AS (SELECT fact_id, CASE fact_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'dead_letter' ELSE 'pending' END AS status FROM facts WHERE fact_id % 3 = 0)
SELECT fact_id, CASE WHEN l.fact_id IS NOT NULL AND coalesce(status, 'completed') = 'completed' THEN 'pending' ELSE status END AS status, CASE WHEN l.fact_id IS NOT NULL AND coalesce(status, 'completed') = 'completed' THEN sha256(coalesce(content, '')) ELSE 'old' END AS sha
FROM j FULL JOIN l USING (fact_id)""")
def embedding_jobs(spark, sf):
    """The job table with what is missing queued: every third fact had a job before."""
    f = table(spark, sf, "facts")
    i = F.col("fact_id") % 4
    old = f.where("fact_id % 3 = 0").select("fact_id", F.lit(IDENTITY).alias("document_identity"), F.lit("old").alias("content_sha256"), F.when(i == 0, "completed").when(i == 1, "dead_letter").otherwise("pending").alias("status"), F.lit(2).alias("attempts"), F.lit(0).cast("long").alias("available_at"), F.lit(None).cast("string").alias("lease_token"))
    return jobs.backfill(f, table(spark, sf, "fact_embeddings"), old, IDENTITY, 64, NOW).select("fact_id", "status", F.col("content_sha256").alias("sha"))


@query(f"""
WITH c AS (SELECT fact_id, CAST(fact_id % 7 AS INTEGER) AS attempts, CASE WHEN fact_id % 5 = 0 THEN NULL WHEN fact_id % 5 = 1 THEN 'changed' WHEN fact_id % 5 = 2 THEN NULL ELSE sha256(coalesce(content, '')) END AS sha, CASE WHEN fact_id % 5 = 2 THEN 'timeout' END AS error, NOT ({ACTIVE}) AS off_, sha256(coalesce(content, '')) AS now_ FROM facts),
o AS (SELECT *, CASE WHEN off_ THEN CASE WHEN sha IS NULL AND error IS NULL THEN 'skipped_inactive' ELSE 'skipped_stale' END WHEN error IS NOT NULL THEN CASE WHEN attempts >= 5 THEN 'dead_letter' ELSE 'pending' END
  WHEN sha IS NULL THEN 'requeued_active' WHEN sha <> now_ THEN 'requeued_changed' ELSE 'embedded' END AS outcome FROM c)
SELECT fact_id, outcome, CASE WHEN outcome IN ('pending', 'requeued_active', 'requeued_changed') THEN 'pending' WHEN outcome = 'dead_letter' THEN 'dead_letter' ELSE 'completed' END AS status,
  CASE WHEN outcome = 'pending' THEN CAST({NOW} + least(300, CAST(pow(2, attempts) AS INTEGER)) AS BIGINT) WHEN outcome IN ('requeued_active', 'requeued_changed') THEN CAST({NOW} AS BIGINT) END AS available_at FROM o""")
def embedding_settled(spark, sf):
    """A round of model calls with gaps, changed texts and failures, settled."""
    f, i = table(spark, sf, "facts"), F.col("fact_id") % 5
    claimed = f.select("fact_id", (F.col("fact_id") % 7).cast("int").alias("attempts"), F.lit("old").alias("content_sha256"))
    results = f.select("fact_id", F.when(i == 1, "changed").when(i >= 3, jobs.digest(F.col("content"))).alias("sha"), F.when(i == 2, "timeout").alias("error"))
    return jobs.settled(claimed, f, results, NOW).select("fact_id", "outcome", "status", "available_at")


# ---- identities ---------------------------------------------------------------------------------

@query(f"SELECT embedding_identity, CAST(count(*) AS BIGINT) AS n FROM fact_embeddings WHERE embedding_identity IN ('{IDENTITY}') GROUP BY 1")
def pruned_identities(spark, sf):
    return embedding.kept(table(spark, sf, "fact_embeddings"), [IDENTITY]).groupBy("embedding_identity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT embedding_identity, replace(replace(embedding_identity, ':document:', ':query:'), ':query:', ':document:') AS stored, CASE WHEN lower(embedding_identity) LIKE '%e5%' THEN 'query: ' ELSE '' END AS prefix FROM fact_embeddings")
def identity_roles(spark, sf):
    e = table(spark, sf, "fact_embeddings").select("embedding_identity").distinct()
    return e.select("embedding_identity", embedding.stored_identity(F.replace("embedding_identity", F.lit(":document:"), F.lit(":query:"))).alias("stored"), embedding.role_prefix(F.col("embedding_identity"), "query").alias("prefix"))


@query("SELECT fact_id, 'local:legacy:document:none:v0' AS embedding_identity, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT fact_id FROM fact_embeddings) GROUP BY 1")
def legacy_identities(spark, sf):
    """Vectors of a table without identities under a default one."""
    v = embedding.keyed_by_identity(table(spark, sf, "fact_embeddings").drop("embedding_identity"), "local:legacy:document:none:v0")
    return v.groupBy("fact_id", "embedding_identity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_PRESENT} SELECT fact_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS square, round(e[1], 5) AS first FROM (
  SELECT fact_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / n) AS e FROM (SELECT fact_id, embedding, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM v))""")
def unit_vectors(spark, sf):
    u = embedding.normalised(present(table(spark, sf, "fact_embeddings"), IDENTITY), 64)
    return u.select("fact_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"), F.round(F.col("embedding")[0], 5).alias("first"))


_COVER = f"""v AS (SELECT fact_id, count(*) AS n, min(embedding) AS embedding, max(dim) AS d FROM fact_embeddings WHERE embedding_identity = '{IDENTITY}' GROUP BY 1),
c AS (SELECT query_id, t.fact_id, n, d, len(v.embedding) AS l, v.embedding IS NULL AS gone, t.fact_id % 2 = 0 AS queued FROM t LEFT JOIN v ON v.fact_id = t.fact_id WHERE rank <= 10),
s AS (SELECT *, CASE WHEN n > 1 THEN 'duplicate' WHEN n IS NOT NULL AND (d <> 64 OR l <> 64) THEN 'dimension' WHEN n IS NULL AND NOT queued THEN 'missing' END AS problem FROM c)"""


@query(f"WITH {_BM25}, {_TOP}, {_COVER} SELECT coalesce(problem, CASE WHEN gone THEN 'lexical_only' ELSE 'dense' END) AS state, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1")
def vector_coverage(spark, sf):
    """How the vectors of ranked candidates were found, where every second gap has a live job."""
    live = table(spark, sf, "facts").where("fact_id % 2 = 0").select("fact_id", F.lit(IDENTITY).alias("document_identity"), F.lit("pending").alias("status"))
    return embedding.fallbacks(embedding.covered(_bm25_top(spark, sf), table(spark, sf, "fact_embeddings"), live, IDENTITY, 64, strict=False))


@query()
def write_near_duplicates(spark, sf):
    """Facts divisible by 20 as incoming texts: which facts they nearly repeat."""
    f, v = table(spark, sf, "facts"), table(spark, sf, "fact_embeddings")
    new = f.where("fact_id % 20 = 0 and content is not null").select(F.col("fact_id").alias("request_id"), "content", "scope")
    nv = present(v, IDENTITY).where("fact_id % 20 = 0").select(F.col("fact_id").alias("request_id"), "embedding")
    return embedding.write_near_duplicates(new, nv, f, v, IDENTITY, NEAR)


@query()
def semantic_duplicates(spark, sf):
    """Near vectors whose texts say the same."""
    f = table(spark, sf, "facts")
    t = f.select("fact_id", F.col("content").alias("t"))
    pairs = dedup.near_pairs(f, present(table(spark, sf, "fact_embeddings")), NEAR)
    r = pairs.join(t.withColumnsRenamed({"fact_id": "a", "t": "a_text"}), "a").join(t.withColumnsRenamed({"fact_id": "b", "t": "b_text"}), "b")
    return embedding.semantic_duplicates(r, NEAR).select("a", "b", "cosine")


# ---- insights -----------------------------------------------------------------------------------

@query(f"""
WITH e AS (SELECT object_entity_id AS k, count(*) AS n, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY fact_id) AS ids FROM facts
  WHERE {ACTIVE} AND object_entity_id IS NOT NULL AND memory_kind IS DISTINCT FROM 'insight' AND category IS DISTINCT FROM 'insight'
    AND NOT coalesce(starts_with(lower(ltrim(content)), 'superseded') OR starts_with(lower(ltrim(content)), 'stale/disabled') OR starts_with(lower(ltrim(content)), 'historical/superseded'), FALSE)
  GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25)
SELECT 'entity:' || k AS cluster, ids AS fact_ids FROM e ORDER BY n DESC, 'entity:' || k LIMIT 20""")
def reflection_selection(spark, sf):
    return reflection.selected(table(spark, sf, "facts"), None, 20)


@query()
def reflection_bands(spark, sf):
    """Clusters of entities and of near vectors, up to two hundred."""
    return reflection.selected(table(spark, sf, "facts"), present(table(spark, sf, "fact_embeddings"), IDENTITY), 200, 0.9, 0.99)


# ---- merges -------------------------------------------------------------------------------------

def _orphan_tables(spark, sf):
    """A store's tables with links as they would be after facts divisible by 50 had been deleted carelessly."""
    f = table(spark, sf, "facts")
    return f.where("fact_id % 50 != 0"), {"fact_provenance": table(spark, sf, "fact_provenance"), "fact_embeddings": table(spark, sf, "fact_embeddings")}


@query("""
WITH f AS (SELECT * FROM facts WHERE fact_id % 50 <> 0), r AS (SELECT 'facts' AS "table", 'superseded_by' AS "column", superseded_by AS fact_id FROM f UNION SELECT 'fact_provenance', 'fact_id', fact_id FROM fact_provenance UNION SELECT 'fact_embeddings', 'fact_id', fact_id FROM fact_embeddings)
SELECT DISTINCT "table", "column", fact_id FROM r WHERE fact_id IS NOT NULL AND fact_id NOT IN (SELECT fact_id FROM f)""")
def orphan_report(spark, sf):
    return dedup.orphans(*_orphan_tables(spark, sf))


# ---- erasure ------------------------------------------------------------------------------------

_ERASED = "(SELECT fact_id FROM facts WHERE sensitivity = 'sensitive')"
_CLONES = f"""sh AS (SELECT observation_id FROM fact_provenance WHERE observation_id IN (SELECT observation_id FROM observations) GROUP BY 1 HAVING bool_or(fact_id IN {_ERASED}) AND bool_or(fact_id NOT IN {_ERASED})),
cl AS (SELECT observation_id, (SELECT max(observation_id) FROM observations) + row_number() OVER (ORDER BY observation_id) AS clone_id FROM sh)"""


def _after_erasure(spark, sf):
    t = {n: table(spark, sf, n) for n in ("facts", "fact_provenance", "observations", "fact_embeddings")}
    return erasure.after_erasure(t["facts"], t["fact_provenance"], t["observations"], t["fact_embeddings"], t["facts"].where("sensitivity = 'sensitive'").select("fact_id"), "e1", CLOCK)


@query(f"""
WITH {_CLONES}, x AS (SELECT DISTINCT observation_id FROM fact_provenance WHERE fact_id IN {_ERASED})
SELECT o.observation_id, CASE WHEN x.observation_id IS NOT NULL THEN '[erased]' ELSE observation_content END AS observation_content, CASE WHEN x.observation_id IS NOT NULL THEN concat('erased:e1:', o.observation_id) ELSE content_sha256 END AS content_sha256 FROM observations o LEFT JOIN x USING (observation_id)
UNION ALL SELECT clone_id, observation_content, concat('clone:e1:', observation_id) FROM observations JOIN cl USING (observation_id)""")
def erased_evidence(spark, sf):
    """The observations after an erasure, with clones of those that other facts rest on."""
    return _after_erasure(spark, sf)["observations"].select("observation_id", "observation_content", "content_sha256")


@query(f"""
WITH {_CLONES} SELECT fact_id, CASE WHEN fact_id IN {_ERASED} THEN p.observation_id ELSE coalesce(clone_id, p.observation_id) END AS observation_id, relation, CASE WHEN fact_id IN {_ERASED} THEN NULL ELSE evidence_excerpt END AS evidence_excerpt
FROM fact_provenance p LEFT JOIN cl USING (observation_id)""")
def erased_edges(spark, sf):
    return _after_erasure(spark, sf)["fact_provenance"].select("fact_id", "observation_id", "relation", "evidence_excerpt")


@query(f"""
WITH g AS (SELECT conflict_group, count(*) AS n FROM facts WHERE conflict_group IS NOT NULL AND fact_id NOT IN {_ERASED} GROUP BY 1)
SELECT fact_id, CASE WHEN fact_id IN {_ERASED} THEN NULL WHEN n > 1 THEN f.conflict_group END AS conflict_group, CASE WHEN fact_id IN {_ERASED} THEN coalesce(invalid_at, '{CLOCK}') ELSE invalid_at END AS invalid_at FROM facts f LEFT JOIN g USING (conflict_group)""")
def erased_conflicts(spark, sf):
    return _after_erasure(spark, sf)["facts"].select("fact_id", "conflict_group", "invalid_at")


# ---- evidence, sessions, dossiers ---------------------------------------------------------------

@query(f"""
WITH v AS (SELECT DISTINCT fact_id FROM fact_embeddings WHERE embedding_identity = '{IDENTITY}' AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT fact_id FROM facts WHERE {ACTIVE} AND fact_id NOT IN (SELECT fact_id FROM v) AND fact_id % 2 <> 0""")
def uncovered_facts(spark, sf):
    """Active facts without a vector and without a live job, where every even one has a job."""
    f = table(spark, sf, "facts")
    live = f.where("fact_id % 2 = 0").select("fact_id", F.lit(IDENTITY).alias("document_identity"), F.lit("pending").alias("status"))
    return provenance.uncovered(f, table(spark, sf, "fact_embeddings"), live, IDENTITY)


@query("""
WITH c AS (SELECT observation_id AS n, client_id, session_id, client_id AS agent_id, project_root, repository, branch, commit_sha FROM observations WHERE client_id IS NOT NULL AND session_id IS NOT NULL)
SELECT client_id, session_id, arg_min({'x': repository}, n).x AS repository, arg_max({'x': branch}, n).x AS branch, count(DISTINCT coalesce(repository, chr(0))) > 1 OR count(DISTINCT coalesce(project_root, chr(0))) > 1 AS clash FROM c GROUP BY 1, 2""")
def registered_sessions(spark, sf):
    """Observations as connection contexts: what is registered of each session."""
    o = table(spark, sf, "observations").where("client_id is not null and session_id is not null")
    c = o.select(F.col("observation_id").alias("n"), "client_id", "session_id", F.col("client_id").alias("agent_id"), F.lit(None).cast("string").alias("parent_agent_id"), "project_root", "repository", "branch", "commit_sha", F.lit("[]").alias("capabilities_json"), F.lit("[]").alias("access_scopes_json"), F.col("recorded_at").alias("started_at"))
    return provenance.registered_sessions(c).select("client_id", "session_id", "repository", "branch", "clash")


@query("""
WITH e AS (SELECT fact_id, observation_id, relation, min({'a': created_at, 'b': evidence_excerpt}) AS x FROM fact_provenance GROUP BY 1, 2, 3),
r AS (SELECT fact_id, observation_id, relation, coalesce(x.b, '') AS t FROM e JOIN observations USING (observation_id)),
u AS (SELECT *, sum(CAST(floor((length(t) + 3) / 4.0) AS BIGINT)) OVER (PARTITION BY fact_id ORDER BY observation_id, relation) AS used FROM r) SELECT fact_id, observation_id, relation, CAST(used AS BIGINT) AS used FROM u WHERE used <= 40""")
def evidence_budget(spark, sf):
    """Each fact's evidence while forty estimated tokens last."""
    e = provenance.edges(table(spark, sf, "fact_provenance")).join(table(spark, sf, "observations").select("observation_id"), "observation_id")
    r = e.withColumn("rank", F.struct("observation_id", "relation")).withColumn("t", F.coalesce("evidence_excerpt", F.lit("")))
    return context.budget_prefix(r, 40, "t", "fact_id").select("fact_id", "observation_id", "relation", "used")


@query("""
WITH r AS (SELECT scope, subject_key, predicate_key, fact_id, coalesce(content, '') AS t, coalesce(valid_from, created_at) AS o FROM facts WHERE subject_key IS NOT NULL AND predicate_key IS NOT NULL),
u AS (SELECT *, sum(CAST(floor((length(t) + 3) / 4.0) AS BIGINT)) OVER (PARTITION BY scope, subject_key, predicate_key ORDER BY o NULLS FIRST, fact_id) AS used FROM r) SELECT fact_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 120""")
def history_budget(spark, sf):
    """Each slot's history while a hundred and twenty estimated tokens last."""
    f = table(spark, sf, "facts").where("subject_key is not null and predicate_key is not null")
    r = f.select(F.struct("scope", "subject_key", "predicate_key").alias("slot"), "fact_id", F.coalesce("content", F.lit("")).alias("t"), F.struct(F.coalesce("valid_from", "created_at").alias("o"), "fact_id").alias("rank"))
    return context.budget_prefix(r, 120, "t", "slot").select("fact_id", "used")


_NAME = "project:lanternfall"
_ABOUT = f"coalesce(lower(subject_key) = '{_NAME}' OR list_contains(list_transform(list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: lower(x)), '{_NAME}'), FALSE)"
_CLASH = f"""ec AS (SELECT conflict_group, count(*) OVER (PARTITION BY conflict_group) AS members, fact_id, row_number() OVER (PARTITION BY conflict_group ORDER BY fact_id) AS place FROM facts WHERE conflict_group IN (SELECT conflict_group FROM facts WHERE conflict_group IS NOT NULL AND {_ABOUT}))"""


@query(f"WITH {_CLASH} SELECT conflict_group, CAST(members AS BIGINT) AS members, fact_id, CAST(place AS INTEGER) AS place FROM ec WHERE place <= 10")
def entity_conflicts(spark, sf):
    return projections.entity_conflicts(table(spark, sf, "facts"), _NAME)


@query(f"""
WITH {_CLASH}, ev AS (SELECT fact_id, 'created' AS event, created_at AS at_ FROM facts WHERE created_at IS NOT NULL UNION ALL SELECT fact_id, 'retired', invalid_at FROM facts WHERE invalid_at IS NOT NULL),
m AS (SELECT fact_id, coalesce(content, '') AS item, {ACTIVE} AS live FROM facts WHERE {_ABOUT}),
r AS (SELECT 'current' AS section, row_number() OVER (ORDER BY fact_id) AS place, item FROM m WHERE live UNION ALL SELECT 'event', row_number() OVER (ORDER BY at_, fact_id, event), concat_ws(' ', at_, event, fact_id) FROM ev WHERE fact_id IN (SELECT fact_id FROM m)
  UNION ALL SELECT 'conflict', row_number() OVER (ORDER BY conflict_group, place), concat_ws(' ', conflict_group, fact_id) FROM ec WHERE place <= 10),
z AS (SELECT *, greatest(1, CAST(floor((length(item) + 3) / 4.0) AS BIGINT)) AS size FROM r), u AS (SELECT *, sum(size) OVER (ORDER BY place, section) AS used FROM z)
SELECT section, CAST(place AS INTEGER) AS place, item, size FROM u WHERE used <= 2000""")
def full_dossier(spark, sf):
    """Current facts, events and conflicts about one name, in turn, within two thousand estimated tokens."""
    f = table(spark, sf, "facts")
    events = f.where("created_at is not null").select("fact_id", F.lit("created").alias("event"), F.col("created_at").alias("at")).unionByName(f.where("invalid_at is not null").select("fact_id", F.lit("retired").alias("event"), F.col("invalid_at").alias("at")))
    return projections.full_dossier(f, events, _NAME, 2000)


# ---- contracts ----------------------------------------------------------------------------------

@query("""
SELECT case_id, CASE case_no % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'unsupported' END AS verdict FROM (SELECT case_id, CAST(right(case_id, 8) AS BIGINT) AS case_no FROM transcript_gate_gold)""")
def verdicts_parsed(spark, sf):
    """Answers of a verifier, half of them not as agreed."""
    g = table(spark, sf, "transcript_gate_gold").select("case_id", (F.substring("case_id", -8, 8).cast("long") % 4).alias("k"))
    said = F.element_at(F.array(*[F.lit(x) for x in ('{"verdict": "supported"}', '{"verdict":"unsupported"}', '{"verdict": "supported", "why": "x"}', "supported")]), (F.col("k") + 1).cast("int"))
    return g.select("case_id", contracts.verdict(said).alias("verdict"))


def _snapshot(spark, sf):
    """Gold facts as a model's proposals over spans that are their excerpts."""
    g = table(spark, sf, "transcript_gate_gold").select("case_id", F.posexplode("facts").alias("item_no", "f"))
    span = F.concat(F.lit("s"), F.col("item_no").cast("string"))
    spans = g.where("f.evidence_excerpt is not null").select("case_id", span.alias("span_id"), F.col("f.evidence_excerpt").alias("span"), F.col("f.evidence_role").alias("role"))
    p = g.select(
        "case_id", "item_no", F.col("f.content").alias("content"), F.lit("general").alias("category"), F.lit("").alias("tags"), F.lit("normal").alias("sensitivity"), span.alias("evidence_span_id"), F.col("f.evidence_excerpt").alias("evidence_excerpt"),
        F.col("f.state.kind").alias("kind"), F.col("f.state.subject").alias("subject"), F.col("f.state.predicate").alias("predicate"), F.col("f.state.value").alias("value"), F.lit(None).cast("string").alias("object"), F.when(F.col("item_no") % 2 == 0, 0.9).otherwise(0.5).alias("confidence"),
    )
    return contracts.snapshot(screens.normal(p, "content"), spans)


_SNAPSHOT = f"""
WITH g AS ({_G}), n AS (SELECT case_id, item_no, f, f.state AS st, {_C.replace("coalesce(content, '')", "coalesce(f.content, '')")} AS x, {_NORMAL.format("coalesce(f.content, '')")} || chr(10) || coalesce(f.evidence_excerpt, '') || chr(10) || 'general' || chr(10) AS y FROM g),
k AS (SELECT *, coalesce(st.kind IN ('state', 'preference', 'commitment', 'event') AND regexp_matches(regexp_replace(lower(trim(st.subject)), '\\s+', '_', 'g'), '^[a-z0-9][a-z0-9._:/-]{{0,127}}$') AND regexp_matches(regexp_replace(lower(trim(st.predicate)), '[\\s-]+', '_', 'g'), '^[a-z0-9][a-z0-9._-]{{0,63}}$') AND st.value IS NOT NULL AND item_no % 2 = 0, FALSE) AS typed FROM n)"""


@query(_SNAPSHOT + f"""
SELECT case_id, item_no, CASE WHEN f.evidence_excerpt IS NULL THEN 'ungrounded' WHEN f.evidence_role IS DISTINCT FROM 'user' THEN 'not_said_by_user' ELSE {_reason('x', 'y')} END AS dropped, typed, st.kind IS NOT NULL AND NOT typed AS demoted FROM k""")
def proposal_snapshot(spark, sf):
    """What a snapshot keeps of every proposal, and which typed fields hold up."""
    return _snapshot(spark, sf).select("case_id", "item_no", "dropped", F.col("typed").isNotNull().alias("typed"), "demoted")


@query()
def snapshot_digests(spark, sf):
    return contracts.snapshot_digest(_snapshot(spark, sf))


@query(_SNAPSHOT + f""", z AS (SELECT *, CASE WHEN f.evidence_excerpt IS NULL THEN 'ungrounded' WHEN f.evidence_role IS DISTINCT FROM 'user' THEN 'not_said_by_user' ELSE {_reason('x', 'y')} END AS dropped FROM k)
SELECT 'extract:' || sha256(case_id) || ':' || item_no AS idempotency_key, f.content AS content, CASE WHEN typed THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS source_authority, CASE WHEN NOT typed THEN 'unreviewed' END AS correction_status FROM z WHERE dropped IS NULL""")
def extraction_requests(spark, sf):
    """The write requests of every snapshot."""
    e = table(spark, sf, "transcript_gate_gold").select("case_id", F.lit("c").alias("client_id"), F.lit("s").alias("session_id"), F.lit("private").alias("scope"), F.sha2("case_id", 256).alias("payload_sha256"))
    return contracts.write_requests(_snapshot(spark, sf), e).select("idempotency_key", "content", "source_authority", "correction_status")


# ---- whole answers ------------------------------------------------------------------------------

@query("SELECT fact_id, content, scope, superseded_by FROM facts WHERE fact_id = 60")
def fact_lookup(spark, sf):
    """One fact by its identifier, retired or not."""
    return prompts.one_fact(table(spark, sf, "facts"), 60, current=False).select("fact_id", "content", "scope", "superseded_by")


_RECEIPTS = """u AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS x FROM q),
cg AS (SELECT DISTINCT conflict_group, unnest(regexp_extract_all(lower(concat_ws(' ', subject_key, predicate_key, object_value)), '[\\p{L}\\p{N}]+')) AS x FROM facts WHERE conflict_group IS NOT NULL),
rr AS (SELECT query_id, conflict_group FROM u JOIN cg USING (x) GROUP BY 1, 2 HAVING count(*) >= 2 OR max(length(x)) >= 6)"""


@query(f"""
WITH {_BM25}, {_TOP}, {_RECEIPTS}, sv AS (SELECT query_id, t.fact_id, rank, content FROM t JOIN facts USING (fact_id) WHERE rank <= 6),
sp AS (SELECT query_id, max(rank) > 5 OR coalesce(max(CASE WHEN rank <= 5 THEN length(coalesce(content, '')) > 120 END), FALSE) AS output_truncated FROM sv GROUP BY 1), sc AS (SELECT query_id, count(*) AS n FROM rr GROUP BY 1)
SELECT query_id, fact_id, CAST(rank AS INTEGER) AS rank, CASE WHEN length(content) > 120 THEN rtrim(substr(content, 1, 107)) || '… [truncated]' ELSE content END AS content, output_truncated, CAST(coalesce(n, 0) AS BIGINT) AS open_conflicts
FROM sv JOIN sp USING (query_id) LEFT JOIN sc USING (query_id) WHERE rank <= 5""")
def service_search(spark, sf):
    """The five best facts of every query as a service answers, with how many disputes bear on it."""
    from ..operators.expansion import relevant_receipts
    from .retrieval import search_queries

    f = table(spark, sf, "facts")
    top = lexical.top(lexical.bm25(f, search_queries(spark, sf), _keep()), "bm25", 6).withColumn("score", F.col("bm25"))
    who = provenance.attribution(table(spark, sf, "fact_provenance"), table(spark, sf, "observations"), table(spark, sf, "memory_sessions"))
    r = service.search(top, f, who, relevant_receipts(f, search_queries(spark, sf)), 5, 5, 120)
    return r.select("query_id", "fact_id", "rank", "content", "output_truncated", "open_conflicts")


@query(f"""
WITH {_BM25}, {_TOP}, {_RECEIPTS}, ra AS (SELECT query_id, 0 AS kind, lpad(CAST(rank AS VARCHAR), 12, '0') AS o, coalesce(content, '') AS item FROM t JOIN facts USING (fact_id) WHERE rank <= 10 UNION ALL SELECT query_id, 1, conflict_group, 'open conflict ' || conflict_group FROM rr),
z AS (SELECT *, row_number() OVER w AS place, sum(CAST(floor((length(item) + 3) / 4.0) AS BIGINT)) OVER w AS run FROM ra WINDOW w AS (PARTITION BY query_id, kind ORDER BY o)),
y AS (SELECT *, coalesce(max(CASE WHEN kind = 0 AND run <= 150 THEN run END) OVER (PARTITION BY query_id), 0) AS used FROM z)
SELECT query_id, CAST(kind AS INTEGER) AS kind, CAST(place AS INTEGER) AS place, item FROM y WHERE CASE WHEN kind = 0 THEN run <= 150 ELSE run + used <= 150 OR place = 1 END""")
def recall_answer(spark, sf):
    """Every query's answer within a hundred and fifty estimated tokens."""
    from ..operators.expansion import relevant_receipts
    from .retrieval import search_queries

    f = table(spark, sf, "facts")
    rows = _bm25_top(spark, sf).join(f.select("fact_id", F.coalesce("content", F.lit("")).alias("text")), "fact_id")
    told = relevant_receipts(f, search_queries(spark, sf)).withColumn("line", F.concat(F.lit("open conflict "), "conflict_group"))
    return service.recall(rows.select("query_id", "rank", "text"), told, 150)


def _first_matches(spark, sf):
    """Facts divisible by 20 as new texts, each with its three best matches but itself."""
    f = table(spark, sf, "facts")
    q = f.where("fact_id % 20 = 0 and content is not null").select(F.col("fact_id").alias("query_id"), F.col("content").alias("query"))
    t = lexical.top(best(f, q, 4, _keep()).where("query_id != fact_id"), "bm25", 3).select(F.col("query_id").alias("request_id"), "fact_id", "rank")
    t = Cut(spark, "first")(t, "matches")
    new = q.select(F.col("query_id").alias("request_id"), F.col("query").alias("a_text"))
    return t.join(new, "request_id").join(f.select("fact_id", F.col("content").alias("b_text")), "fact_id").withColumn("cosine", F.lit(None).cast("double"))


@query()
def first_restated(spark, sf):
    """New texts that restate one of their first matches."""
    return service.restated_first(_first_matches(spark, sf))


@query()
def first_updated(spark, sf):
    """New texts that change the value of one of their first matches."""
    return service.updated_first(_first_matches(spark, sf))
