"""Queries over the fact store: eligibility, time, slots, conflicts, evidence, events, entities, upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitemporal, dedup, eligibility, erasure, projections, provenance, queues, slots
from ..sources import sinks
from ..sources.tables import table

SCOPES = ["private", "work", "public"]
NOW = 1_767_225_600  # 2026-01-01T00:00:00Z: every clock is explicit
AT_VALID = 1_748_736_000  # 2025-06-01T00:00:00Z
AT_KNOWN = 1_759_276_800  # 2025-10-01T00:00:00Z
IDENTITY = "local:fernmodel-s:document:none:v2"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def at(column: str) -> str:
    """SQL: whole seconds since 1970 of a time text, its offset taken off."""
    sign = f"CASE WHEN substr({column}, -6, 1) = '-' THEN -1 ELSE 1 END"
    offset = f"CASE WHEN regexp_matches({column}, '[+-][0-9][0-9]:[0-9][0-9]$') THEN {sign} * (CAST(substr({column}, -5, 2) AS INTEGER) * 3600 + CAST(substr({column}, -2, 2) AS INTEGER) * 60) ELSE 0 END"
    return f"(CAST(epoch(TRY_CAST({column} AS TIMESTAMP)) AS BIGINT) - {offset})"


ACTIVE = "invalid_at IS NULL AND superseded_by IS NULL AND conflict_group IS NULL"
_SCOPE_LIST = "('private', 'work', 'public')"


@query(f"""
SELECT fact_id, scope, sensitivity, trust_score FROM facts
WHERE {ACTIVE} AND scope IN {_SCOPE_LIST} AND coalesce(sensitivity, 'normal') IN ('normal', 'sensitive')
  AND trust_score >= 0.3 AND correction_status IS DISTINCT FROM 'unreviewed'""")
def eligible_facts(spark, sf):
    f = table(spark, sf, "facts")
    return eligibility.eligible(f, SCOPES, ["sensitive"], min_trust=0.3).select("fact_id", "scope", "sensitivity", "trust_score")


@query(f"""
SELECT coalesce(split_part(scope, ':', 1), 'none') AS scope_kind, coalesce(sensitivity, 'normal') AS sensitivity,
       CAST(count(*) AS BIGINT) AS facts, CAST(count(*) FILTER (WHERE {ACTIVE}) AS BIGINT) AS active
FROM facts GROUP BY 1, 2""")
def facts_by_scope_sensitivity(spark, sf):
    f = table(spark, sf, "facts")
    return f.groupBy(F.coalesce(F.substring_index("scope", ":", 1), F.lit("none")).alias("scope_kind"), F.coalesce("sensitivity", F.lit("normal")).alias("sensitivity")).agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(eligibility.active()).alias("active")
    )


@query(f"""
SELECT fact_id, scope FROM facts
WHERE {ACTIVE} AND (scope IN {_SCOPE_LIST} OR scope LIKE 'run:%') AND coalesce(sensitivity, 'normal') = 'normal'""")
def scope_authorized(spark, sf):
    f = table(spark, sf, "facts")
    return f.where(eligibility.active() & eligibility.scope_authorized(SCOPES) & eligibility.visible(None)).select("fact_id", "scope")


@query(f"""
SELECT fact_id, scope, invalid_at FROM facts
WHERE scope IN {_SCOPE_LIST} AND fact_id IN (SELECT fact_id FROM fact_provenance WHERE relation = 'corrects')""")
def historical_by_ids(spark, sf):
    ids = table(spark, sf, "fact_provenance").where("relation = 'corrects'").select("fact_id")
    return eligibility.by_ids(table(spark, sf, "facts"), ids, SCOPES).select("fact_id", "scope", "invalid_at")


@query(f"""
SELECT fact_id, category FROM facts WHERE {ACTIVE} AND scope IN {_SCOPE_LIST} AND coalesce(sensitivity, 'normal') = 'normal'
ORDER BY fact_id DESC LIMIT 50""")
def newest_facts(spark, sf):
    return eligibility.newest(table(spark, sf, "facts"), SCOPES, 50).select("fact_id", "category")


@query("""
WITH m AS (SELECT fact_id, invalid_at, CASE fact_id % 10 WHEN 0 THEN '  Superseded: ' || content WHEN 1 THEN 'historical/SUPERSEDED ' || content ELSE content END AS content FROM facts)
SELECT fact_id, coalesce(invalid_at, '2026-01-01T00:00:00Z') AS invalid_at FROM m WHERE starts_with(lower(ltrim(content)), 'superseded') OR starts_with(lower(ltrim(content)), 'stale/disabled')
   OR starts_with(lower(ltrim(content)), 'historical/superseded')""")
def retired_by_prefix(spark, sf):
    """Facts that their content marks as retired get an end; every fifth fact is marked here."""
    i = F.col("fact_id") % 10
    text = F.when(i == 0, F.concat(F.lit("  Superseded: "), "content")).when(i == 1, F.concat(F.lit("historical/SUPERSEDED "), "content")).otherwise(F.col("content"))
    return eligibility.retirement_plan(table(spark, sf, "facts").withColumn("content", text), "2026-01-01T00:00:00Z")


_VALID = f"""({at('valid_from')} IS NULL OR {at('valid_from')} <= {AT_VALID}) AND ({at('valid_to')} IS NULL OR {at('valid_to')} > {AT_VALID})"""
_KNOWN = f"""({at('created_at')} IS NULL OR {at('created_at')} <= {AT_KNOWN})
  AND coalesce(coalesce({at('expired_at')}, CASE WHEN superseded_by IS NOT NULL AND valid_to IS NULL THEN {at('invalid_at')} END) > {AT_KNOWN}, TRUE)"""


@query(f"""
SELECT fact_id FROM facts WHERE {_VALID} AND expired_at IS NULL
  AND NOT ({at('valid_to')} IS NULL AND (invalid_at IS NOT NULL OR superseded_by IS NOT NULL) AND NOT coalesce({at('invalid_at')} > {AT_VALID}, FALSE))""")
def asof_valid(spark, sf):
    return table(spark, sf, "facts").where(eligibility.as_of(valid_at=AT_VALID)).select("fact_id")


@query(f"SELECT fact_id FROM facts WHERE {_KNOWN}")
def asof_tx(spark, sf):
    return table(spark, sf, "facts").where(eligibility.as_of(known_at=AT_KNOWN)).select("fact_id")


@query(f"SELECT fact_id FROM facts WHERE {_VALID} AND {_KNOWN}")
def asof_both(spark, sf):
    return table(spark, sf, "facts").where(eligibility.as_of(AT_VALID, AT_KNOWN)).select("fact_id")


@query("""
SELECT a.fact_id, coalesce(a.valid_to, CASE WHEN a.invalid_at IS NOT NULL AND a.superseded_by IS NOT NULL THEN b.valid_from END) AS valid_to,
       coalesce(a.expired_at, CASE WHEN a.invalid_at IS NOT NULL AND a.superseded_by IS NOT NULL THEN a.invalid_at END) AS expired_at
FROM facts a LEFT JOIN facts b ON a.superseded_by = b.fact_id""")
def bitemporal_backfill(spark, sf):
    return bitemporal.backfilled(table(spark, sf, "facts"))


@query(f"""
WITH r AS (SELECT scope, subject_key, predicate_key, fact_id, {at('coalesce(valid_from, created_at)')} AS "at" FROM facts
           WHERE memory_kind = 'state' AND subject_key IS NOT NULL AND predicate_key IS NOT NULL AND object_value IS NOT NULL)
SELECT *, lead("at") OVER (PARTITION BY scope, subject_key, predicate_key ORDER BY "at", fact_id) AS until FROM r WHERE "at" IS NOT NULL""")
def slot_current_lww(spark, sf):
    return bitemporal.lww_intervals(table(spark, sf, "facts"))


_CURRENT = f"facts WHERE memory_kind = 'state' AND subject_key IS NOT NULL AND predicate_key IS NOT NULL AND {ACTIVE} AND valid_to IS NULL"


@query(f"""
SELECT scope, subject_key, predicate_key, CAST(count(*) AS BIGINT) AS n, CASE WHEN min(object_value) = max(object_value) THEN min(object_value) END AS value
FROM {_CURRENT} GROUP BY 1, 2, 3""")
def slot_read_current(spark, sf):
    return slots.read_current(table(spark, sf, "facts"))


@query(f"""
SELECT scope, subject_key, predicate_key, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY fact_id) AS fact_ids
FROM {_CURRENT} GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def slot_duplicate_current(spark, sf):
    return slots.duplicate_current(table(spark, sf, "facts"))


@query(f"""
SELECT scope, subject_key, predicate_key, CAST(count(DISTINCT lower(trim(object_value))) AS BIGINT) AS values, min(fact_id) AS first_fact_id
FROM {_CURRENT} GROUP BY 1, 2, 3 HAVING count(DISTINCT lower(trim(object_value))) > 1""")
def slot_conflict_groups(spark, sf):
    return slots.conflicting_slots(table(spark, sf, "facts"))


@query("""
SELECT fact_id, scope, subject_key, predicate_key FROM facts WHERE memory_kind = 'state' AND subject_key IS NOT NULL AND predicate_key IS NOT NULL
  AND expired_at IS NULL AND (invalid_at IS NULL OR valid_to IS NOT NULL)""")
def slot_believed(spark, sf):
    return slots.believed_state(table(spark, sf, "facts")).select("fact_id", "scope", "subject_key", "predicate_key")


def _fold_sql() -> str:
    """The write fold as a recursion over each slot's writes, with the slot's rows as a list of structs."""
    live = "r.status IN ('current', 'closed')"
    over = "(stop IS NULL OR r.start IS NULL OR r.start < stop) AND (r.stop IS NULL OR start IS NULL OR start < r.stop)"
    beats = "((authority > r.authority AND (r.start IS NULL OR start >= r.start)) OR (authority = r.authority AND (r.start IS NULL OR start > r.start)))"
    field = "seq := r.seq, value := r.value, content := r.content, authority := r.authority, start := r.start"
    return f"""
WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY scope, subject_key, predicate_key ORDER BY seq) AS i FROM (
  SELECT fact_id AS seq, coalesce(scope, 'private') AS scope, subject_key, predicate_key, object_value AS value, coalesce(content, '') AS content, coalesce(source_authority, 0.5) AS authority, {at('valid_from')} AS start, {at('valid_to')} AS stop
  FROM facts WHERE memory_kind = 'state' AND subject_key IS NOT NULL AND predicate_key IS NOT NULL AND object_value IS NOT NULL)),
f(scope, subject_key, predicate_key, i, rows, seq, action, target, stop) AS (
  SELECT DISTINCT scope, subject_key, predicate_key, CAST(0 AS BIGINT), CAST([] AS STRUCT(seq BIGINT, value VARCHAR, content VARCHAR, authority DOUBLE, start BIGINT, stop BIGINT, status VARCHAR, conflict BOOLEAN)[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM w
  UNION ALL
  SELECT scope, subject_key, predicate_key, i, CASE WHEN action = 'dedup' THEN rows ELSE list_append(list_transform(rows, lambda r: CASE
      WHEN (action = 'supersede' AND r.seq = target) OR (action = 'supersede_all' AND r.status = 'current') THEN struct_pack({field}, stop := coalesce(r.stop, start), status := 'superseded', conflict := FALSE)
      WHEN action = 'conflict' AND r.status = 'current' AND (len(cur) > 1 OR coalesce(r.seq = target, FALSE)) THEN struct_pack({field}, stop := r.stop, status := r.status, conflict := TRUE) ELSE r END),
    struct_pack(seq := seq, value := value, content := content, authority := authority, start := start, stop := stop, status := CASE WHEN stop IS NULL THEN 'current' ELSE 'closed' END, conflict := action = 'conflict')) END, seq, action, target, stop
  FROM (SELECT *, CASE WHEN action = 'dedup' OR (action = 'conflict' AND open_) THEN exact.seq WHEN action IN ('supersede', 'conflict') THEN near[1].seq END AS target
    FROM (SELECT *, CASE WHEN len(cur) = 0 AND len(near) = 0 THEN 'add' WHEN open_ THEN CASE WHEN (start IS NOT NULL AND len(list_filter(cur, lambda r: NOT {beats})) = 0) OR authority > list_max(list_transform(cur, lambda r: r.authority)) THEN 'supersede_all' ELSE 'conflict' END
        WHEN exact IS NOT NULL THEN 'dedup' WHEN len(near) = 0 THEN 'add'
        WHEN (authority > near[1].authority AND NOT (near[1].start IS NOT NULL AND (start IS NULL OR start < near[1].start))) OR (authority = near[1].authority AND start IS NOT NULL AND (near[1].start IS NULL OR start > near[1].start)) THEN 'supersede' ELSE 'conflict' END AS action
      FROM (SELECT *, len(cur) > 1 OR len(list_filter(cur, lambda r: r.conflict)) > 0 AS open_, list_filter(CASE WHEN len(cur) > 0 THEN cur ELSE near END, lambda r: r.content = content OR r.value = value)[1] AS exact
        FROM (SELECT w.scope, w.subject_key, w.predicate_key, w.i, f.rows, w.seq, w.value, w.content, w.authority, w.start, w.stop, list_filter(f.rows, lambda r: r.status = 'current') AS cur, list_filter(f.rows, lambda r: {live} AND {over.replace('stop IS NULL OR r', 'w.stop IS NULL OR r').replace('< stop)', '< w.stop)').replace('OR start IS', 'OR w.start IS').replace('OR start <', 'OR w.start <')}) AS near
          FROM f JOIN w ON w.scope = f.scope AND w.subject_key = f.subject_key AND w.predicate_key = f.predicate_key AND w.i = f.i + 1))))),
z AS (SELECT scope, subject_key, predicate_key, unnest(arg_max(rows, i)) AS r FROM f GROUP BY 1, 2, 3)
SELECT f.scope, f.subject_key, f.predicate_key, f.seq, f.action, f.target, w.value, w.start, CASE WHEN f.action = 'dedup' THEN w.stop ELSE r.stop END AS stop, CASE WHEN f.action = 'dedup' THEN 'dropped' ELSE r.status END AS status, f.action <> 'dedup' AND r.conflict AS conflict
FROM f JOIN w ON w.seq = f.seq LEFT JOIN z ON z.r.seq = f.seq WHERE f.i > 0"""


@query(_fold_sql())
def slot_fold_full(spark, sf):
    return slots.fold(slots.write_log(table(spark, sf, "facts")))


@query(f"SELECT action, CAST(count(*) AS BIGINT) AS n FROM ({_fold_sql()}) GROUP BY 1")
def slot_fold_summary(spark, sf):
    return slots.fold_summary(slots.write_log(table(spark, sf, "facts")))


@query("""
SELECT scope, subject_key, predicate_key,
       CAST(row_number() OVER (PARTITION BY scope, subject_key, predicate_key ORDER BY coalesce(valid_from, created_at) ASC NULLS FIRST, fact_id) AS INTEGER) AS position,
       fact_id, object_value FROM facts WHERE subject_key IS NOT NULL AND predicate_key IS NOT NULL""")
def slot_history(spark, sf):
    return bitemporal.slot_history(table(spark, sf, "facts"))


_CHAINS = """
WITH RECURSIVE e AS (SELECT a.fact_id AS a, b.fact_id AS b FROM facts a JOIN facts b ON a.superseded_by = b.fact_id WHERE a.fact_id != b.fact_id),
und AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
reach AS (SELECT x AS n, x AS m FROM und UNION SELECT r.n, u.y FROM reach r JOIN und u ON r.m = u.x),
comp AS (SELECT n AS fact_id, min(m) AS chain_id FROM reach GROUP BY n)"""


@query(_CHAINS + """
SELECT chain_id, CAST(row_number() OVER (PARTITION BY chain_id ORDER BY created_at ASC NULLS FIRST, fact_id) AS INTEGER) AS position, fact_id, superseded_by
FROM comp JOIN facts USING (fact_id)""")
def fact_history_chain(spark, sf):
    return bitemporal.chain_history(table(spark, sf, "facts"))


_SETTLED = f"""
SELECT 'created' AS kind, {at('created_at')} AS "at", created_at AS at_text, fact_id, 0 AS k FROM facts
UNION ALL SELECT 'superseded', {at('coalesce(invalid_at, expired_at)')}, coalesce(invalid_at, expired_at), fact_id, 1 FROM facts WHERE superseded_by IS NOT NULL
UNION ALL SELECT 'resolved', {at('invalid_at')}, invalid_at, fact_id, 3 FROM facts WHERE conflict_group IS NOT NULL AND invalid_at IS NOT NULL"""
_EVENTS = f"""{_SETTLED}
UNION ALL SELECT 'conflicted', {at('max(created_at)')}, max(created_at), min(fact_id), 2 FROM facts WHERE conflict_group IS NOT NULL GROUP BY conflict_group"""


@query(f'SELECT kind, "at", fact_id FROM ({_SETTLED}) WHERE "at" IS NOT NULL')
def settled_events(spark, sf):
    return projections.settled_events(table(spark, sf, "facts")).select("kind", "at", "fact_id")


@query(f"""
SELECT strftime(make_timestamp("at" * 1000000), '%Y-%m') AS month,
       CAST(row_number() OVER (PARTITION BY strftime(make_timestamp("at" * 1000000), '%Y-%m') ORDER BY "at", at_text, k, fact_id) AS INTEGER) AS position, kind, "at", fact_id
FROM ({_EVENTS}) WHERE "at" >= {AT_VALID} AND "at" < {AT_KNOWN}""")
def changes_window(spark, sf):
    return projections.changes(table(spark, sf, "facts"), AT_VALID, AT_KNOWN)


_HITS = "lower(concat_ws(' ', content, tags, subject_key, predicate_key, object_value)) LIKE '%lanternfall%'"


@query(f"""SELECT kind, "at", fact_id FROM ({_EVENTS.replace('FROM facts', f'FROM (SELECT * FROM facts WHERE {_HITS})')}) WHERE "at" IS NOT NULL ORDER BY "at" DESC, k DESC, fact_id DESC LIMIT 200""")
def timeline_match(spark, sf):
    return projections.timeline(table(spark, sf, "facts"), "Lanternfall", 200)


_NAMES = f"""
SELECT fact_id, 0 AS place, subject_key AS display, 'subject' AS source FROM facts WHERE {ACTIVE} AND subject_key IS NOT NULL
UNION ALL SELECT fact_id, i, t, 'tag' FROM (
  SELECT fact_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT fact_id, list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM facts WHERE {ACTIVE}))"""


@query(f"""
SELECT lower(display) AS name, CAST(count(DISTINCT fact_id) AS BIGINT) AS facts, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources,
       arg_min(display, fact_id * 1000 + place) AS display FROM ({_NAMES}) GROUP BY 1 HAVING count(DISTINCT fact_id) >= 2""")
def entities_ranked(spark, sf):
    return projections.entities_ranked(table(spark, sf, "facts"))


@query(f"""
SELECT entity_id, entity_type, CAST(coalesce(linked, 0) AS BIGINT) AS linked, CAST(coalesce(active, 0) AS BIGINT) AS active
FROM entities LEFT JOIN (SELECT object_entity_id AS entity_id, count(*) AS linked, count(*) FILTER (WHERE {ACTIVE}) AS active FROM facts WHERE object_entity_id IS NOT NULL GROUP BY 1) USING (entity_id)""")
def entity_degrees(spark, sf):
    return projections.entity_degrees(table(spark, sf, "facts"), table(spark, sf, "entities"))


@query(f"""
SELECT fact_id, subject_key, predicate_key, object_value FROM facts
WHERE {ACTIVE} AND coalesce(lower(subject_key) = 'project:lanternfall' OR list_contains(list_transform(string_split(coalesce(tags, ''), ','), lambda x: lower(trim(x))), 'project:lanternfall'), FALSE)""")
def entity_dossier(spark, sf):
    return projections.dossier(table(spark, sf, "facts"), "project:lanternfall")


@query("SELECT lower(trim(name)) AS name_key, min(entity_id) AS entity_id, CAST(count(*) AS BIGINT) AS n FROM entities WHERE name IS NOT NULL GROUP BY 1")
def entity_resolution(spark, sf):
    return projections.entity_resolution(table(spark, sf, "entities"))


HUB = 60
_LINKS = f"""
l AS (SELECT fact_id, object_entity_id AS e FROM facts WHERE object_entity_id IS NOT NULL AND {ACTIVE}),
s AS (SELECT * FROM l WHERE e IN (SELECT e FROM l GROUP BY e HAVING count(*) <= {HUB})),
one AS (SELECT DISTINCT a.fact_id AS seed_id, b.fact_id FROM s a JOIN s b ON a.e = b.e AND a.fact_id != b.fact_id
        WHERE a.fact_id % 2 = 0)"""


def _seeds(spark, sf):
    return table(spark, sf, "facts").where("fact_id % 2 = 0").select("fact_id")


@query(f"WITH {_LINKS} SELECT * FROM one")
def entity_hop1(spark, sf):
    return projections.hop(table(spark, sf, "facts"), _seeds(spark, sf), HUB)


@query(f"""
WITH {_LINKS},
k AS (SELECT fact_id, subject_key FROM facts WHERE {ACTIVE} AND subject_key IS NOT NULL
      AND subject_key IN (SELECT subject_key FROM facts WHERE {ACTIVE} AND subject_key IS NOT NULL GROUP BY 1 HAVING count(*) <= {HUB})),
two AS (SELECT DISTINCT o.seed_id, b.fact_id FROM one o JOIN k a ON a.fact_id = o.fact_id JOIN k b USING (subject_key) WHERE b.fact_id != o.seed_id)
SELECT seed_id, fact_id, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT *, 1 AS hops FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY 1, 2""")
def entity_hop2(spark, sf):
    return projections.two_hops(table(spark, sf, "facts"), _seeds(spark, sf), HUB)


@query("""
SELECT conflict_group, fact_id, object_value, CAST(row_number() OVER (PARTITION BY conflict_group ORDER BY fact_id) AS INTEGER) AS ordinal,
       CAST(count(*) OVER (PARTITION BY conflict_group) AS BIGINT) AS members FROM facts WHERE conflict_group IS NOT NULL""")
def conflict_members_ranked(spark, sf):
    return slots.conflict_members(table(spark, sf, "facts"))


@query("""
SELECT conflict_group, format('{} {}: {} facts disagree, first {}', coalesce(min(subject_key), 'untyped'), coalesce(min(predicate_key), 'claim'), count(*), min(fact_id)) AS receipt
FROM facts WHERE conflict_group IS NOT NULL GROUP BY 1""")
def conflict_receipts(spark, sf):
    return slots.conflict_receipts(table(spark, sf, "facts"))


@query(f"""
WITH g AS (SELECT conflict_group, min(scope) AS scope, min(subject_key) AS subject_key, CAST(count(*) AS BIGINT) AS members,
           bool_or(coalesce(sensitivity, 'normal') = 'normal') AS shown FROM facts WHERE conflict_group IS NOT NULL GROUP BY 1)
SELECT conflict_group, scope, subject_key, members FROM g WHERE shown AND scope IN {_SCOPE_LIST}
ORDER BY list_position(['private', 'work', 'public'], scope), conflict_group LIMIT 50""")
def conflict_page(spark, sf):
    return slots.conflict_page(table(spark, sf, "facts"), SCOPES, 50)


@query(f"""
WITH r AS (SELECT conflict_group, fact_id, valid_from, first_value(fact_id) OVER w AS winner, first_value(valid_from) OVER w AS start FROM facts WHERE conflict_group IS NOT NULL
  WINDOW w AS (PARTITION BY conflict_group ORDER BY coalesce(source_authority, 0) DESC, coalesce({at('created_at')}, 0) DESC, fact_id))
SELECT conflict_group, fact_id, winner, fact_id = winner AS wins, CASE WHEN fact_id != winner THEN start END AS new_valid_to FROM r""")
def conflict_resolution(spark, sf):
    return slots.resolve(table(spark, sf, "facts"))


_EDGES = """e AS (SELECT fact_id, observation_id, relation, min(created_at) AS created_at FROM fact_provenance GROUP BY 1, 2, 3)"""


@query(f"""
WITH {_EDGES}, j AS (SELECT e.fact_id, o.observation_id, o.client_id, o.session_id, o.source_type, s.agent_id, s.repository, e.relation,
  row_number() OVER (PARTITION BY e.fact_id ORDER BY o.recorded_at DESC NULLS LAST, o.observation_id DESC, e.relation DESC) AS rn,
  CAST(count(*) OVER (PARTITION BY e.fact_id) AS BIGINT) AS evidence_count
  FROM e JOIN observations o USING (observation_id) JOIN memory_sessions s ON s.client_id = o.client_id AND s.session_id = o.session_id)
SELECT fact_id, evidence_count, observation_id, client_id, session_id, source_type, agent_id, repository, relation FROM j WHERE rn = 1""")
def attribution_latest(spark, sf):
    return provenance.attribution(table(spark, sf, "fact_provenance"), table(spark, sf, "observations"), table(spark, sf, "memory_sessions"))


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY fact_id, observation_id, relation ORDER BY created_at ASC NULLS FIRST, evidence_excerpt ASC NULLS FIRST) AS rn FROM fact_provenance)
SELECT x.fact_id, x.observation_id, x.relation, x.evidence_excerpt, o.client_id, o.source_type, o.asserted_by, o.recorded_at, o.redacted_at IS NOT NULL AS redacted
FROM x JOIN observations o USING (observation_id) WHERE rn = 1""")
def evidence_rows(spark, sf):
    return provenance.evidence(table(spark, sf, "fact_provenance"), table(spark, sf, "observations"))


@query(f"""
WITH {_EDGES}, n AS (SELECT fact_id, count(*) AS n, count(*) FILTER (WHERE relation = 'supports') AS supports, count(*) FILTER (WHERE relation = 'contradicts') AS contradicts
  FROM e WHERE observation_id IN (SELECT observation_id FROM observations) GROUP BY 1)
SELECT f.fact_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(supports, 0) AS BIGINT) AS supports, CAST(coalesce(contradicts, 0) AS BIGINT) AS contradicts
FROM (SELECT fact_id FROM facts WHERE {ACTIVE}) f LEFT JOIN n USING (fact_id)""")
def fact_sources(spark, sf):
    return provenance.sources_of(table(spark, sf, "facts"), table(spark, sf, "fact_provenance"), table(spark, sf, "observations"))


@query("SELECT client_id, content_sha256, session_id, source_type, min(observation_id) AS observation_id, CAST(count(*) AS BIGINT) AS times FROM observations GROUP BY 1, 2, 3, 4")
def observation_dedup(spark, sf):
    return provenance.deduplicated_observations(table(spark, sf, "observations"))


@query("SELECT embedding_identity, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT fact_id) AS BIGINT) AS facts, min(dim) AS min_dim, max(dim) AS max_dim FROM fact_embeddings GROUP BY 1")
def identity_counts(spark, sf):
    return provenance.identity_counts(table(spark, sf, "fact_embeddings"))


@query(f"""
SELECT fact_id FROM facts WHERE {ACTIVE} AND fact_id NOT IN (
  SELECT fact_id FROM fact_embeddings WHERE embedding_identity = '{IDENTITY}' AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0)""")
def embedding_coverage_gap(spark, sf):
    return provenance.coverage_gap(table(spark, sf, "facts"), table(spark, sf, "fact_embeddings"), IDENTITY)


@query(f"""
SELECT fact_id, i AS embedding_identity FROM facts, (VALUES ('{IDENTITY}'), ('local:fernmodel-s:document:none:v1')) v(i)
WHERE {ACTIVE} AND content IS NOT NULL AND (fact_id, i) NOT IN (SELECT (fact_id, embedding_identity) FROM fact_embeddings)""")
def embedding_backfill_plan(spark, sf):
    return provenance.backfill_plan(table(spark, sf, "facts"), table(spark, sf, "fact_embeddings"), [IDENTITY, "local:fernmodel-s:document:none:v1"])


@query("""
SELECT embedding_identity, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE embedding IS NULL) AS BIGINT) AS missing,
  CAST(count(*) FILTER (WHERE len(embedding) <> dim) AS BIGINT) AS ill_sized,
  CAST(count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) AS BIGINT) AS broken,
  CAST(count(*) FILTER (WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR x <> 0)) = 0) AS BIGINT) AS zero
FROM fact_embeddings GROUP BY 1""")
def vector_health(spark, sf):
    return provenance.vector_health(table(spark, sf, "fact_embeddings"))


def _orphan(name: str, child: str, column: str, parent: str, key: str) -> str:
    return f"SELECT '{name}' AS reference, {column} AS missing_id, CAST(count(*) AS BIGINT) AS n FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent}) GROUP BY 2"


_LEFT = "(SELECT * FROM facts WHERE fact_id % 50 <> 0)"


@query(" UNION ALL ".join([
    _orphan("facts.superseded_by", _LEFT, "superseded_by", _LEFT, "fact_id"), _orphan("facts.object_entity_id", _LEFT, "object_entity_id", "(SELECT * FROM entities WHERE entity_id % 7 <> 0)", "entity_id"),
    _orphan("fact_provenance.fact_id", "fact_provenance", "fact_id", _LEFT, "fact_id"), _orphan("fact_provenance.observation_id", "fact_provenance", "observation_id", "observations", "observation_id"),
    _orphan("fact_embeddings.fact_id", "fact_embeddings", "fact_id", _LEFT, "fact_id")]))
def orphan_refs(spark, sf):
    """References left behind if facts divisible by 50 and entities divisible by 7 were deleted carelessly."""
    t = [table(spark, sf, n) for n in ("facts", "observations", "fact_provenance", "fact_embeddings", "entities")]
    return provenance.orphans(t[0].where("fact_id % 50 != 0"), *t[1:4], t[4].where("entity_id % 7 != 0"))


_TABLES = ("entities", "fact_embeddings", "fact_provenance", "facts", "memory_sessions", "observations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, CAST(count(*) AS BIGINT) AS rows FROM {t}" for t in _TABLES))
def row_counts(spark, sf):
    return provenance.row_counts(**{t: table(spark, sf, t) for t in _TABLES})


@query("""
SELECT client_id, CAST(count(*) AS BIGINT) AS sessions, CAST(count(*) FILTER (WHERE ended_at IS NULL) AS BIGINT) AS open, CAST(count(DISTINCT repository) AS BIGINT) AS repositories, min(started_at) AS first_started
FROM memory_sessions GROUP BY 1""")
def client_sessions(spark, sf):
    return provenance.latest_session_context(table(spark, sf, "memory_sessions"))


@query("""
SELECT repository, entity_id, CASE WHEN min(subject_key) = max(subject_key) THEN min(subject_key) END AS subject_key
FROM (SELECT DISTINCT f.fact_id, object_entity_id AS entity_id, subject_key, repository FROM facts f JOIN entities n ON n.entity_id = f.object_entity_id
      JOIN fact_provenance p ON p.fact_id = f.fact_id JOIN observations o ON o.observation_id = p.observation_id WHERE repository IS NOT NULL AND subject_key IS NOT NULL) GROUP BY 1, 2""")
def resolved_subjects(spark, sf):
    return provenance.resolved_subjects(table(spark, sf, "facts"), table(spark, sf, "fact_provenance"), table(spark, sf, "observations"), table(spark, sf, "entities"))


# ---- upkeep ------------------------------------------------------------------------------------


@query(f"SELECT scope, min(fact_id) AS first, CAST(count(*) AS BIGINT) AS n FROM facts WHERE {ACTIVE} AND content IS NOT NULL GROUP BY scope, content HAVING count(*) > 1")
def near_dup_exact(spark, sf):
    return dedup.exact_duplicates(table(spark, sf, "facts"))


def _vectors(spark, sf):
    from ..operators.dense import present

    return present(table(spark, sf, "fact_embeddings"), IDENTITY)


_PRESENT = f"""v AS (SELECT fact_id, min(embedding) AS embedding FROM fact_embeddings WHERE embedding_identity = '{IDENTITY}' AND embedding IS NOT NULL AND len(embedding) = dim
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"""


@query(f"""
WITH {_PRESENT}, n AS (SELECT fact_id, CAST(embedding AS DOUBLE[]) AS e FROM facts JOIN v USING (fact_id) WHERE {ACTIVE} ORDER BY fact_id DESC LIMIT 2000),
c AS (SELECT a.fact_id AS a, b.fact_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM n a JOIN n b ON a.fact_id < b.fact_id)
SELECT a, b, cosine FROM c WHERE cosine >= 0.5 AND cosine < 0.9""")
def cosine_band_pairs(spark, sf):
    """Pairs of the newest two thousand active facts in a band of cosines."""
    return dedup.band_pairs(table(spark, sf, "facts"), _vectors(spark, sf), 0.5, 0.9)


#: The test vectors of facts that the merge guard lets meet are far apart.
NEAR = 0.3


def _listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _guard_sql() -> str:
    from ..functions.text import DATE_WORDS, MERGE_STATE_GROUPS, NEGATIONS, ON_OFF_AFTER

    states = [w for g in MERGE_STATE_GROUPS for w in g]
    return f"""
g AS (SELECT fact_id, scope, list_filter(t, lambda x: regexp_matches(x, '[0-9]') OR x IN {_listed(DATE_WORDS)}) AS vals, len(list_filter(t, lambda x: x IN {_listed(NEGATIONS)})) > 0 AS neg,
  list_sort(list_distinct(list_filter(t, lambda x: x IN {_listed(states)} AND NOT list_contains(bad, x)))) AS states
  FROM (SELECT *, list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] IN ('on', 'off') AND (i = 1 OR t[i - 1] NOT IN {_listed(ON_OFF_AFTER)})), lambda i: t[i]) AS bad
        FROM (SELECT fact_id, scope, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM facts WHERE {ACTIVE} AND content IS NOT NULL))),
p AS (SELECT embedding_identity, fact_id, min(embedding) AS embedding FROM fact_embeddings WHERE embedding IS NOT NULL AND len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1, 2),
near AS (SELECT a, b, min(cosine) AS low, max(cosine) AS cosine FROM (SELECT x.fact_id AS a, y.fact_id AS b, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])), 6) AS cosine
  FROM g x JOIN g y ON x.scope = y.scope AND x.vals = y.vals AND x.neg = y.neg AND x.states = y.states AND x.fact_id < y.fact_id JOIN p v ON v.fact_id = x.fact_id JOIN p w ON w.fact_id = y.fact_id AND w.embedding_identity = v.embedding_identity)
  WHERE cosine >= {NEAR} GROUP BY 1, 2)"""


@query(f"WITH {_guard_sql()} SELECT scope, min(fact_id) AS first, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY scope, vals, neg, states HAVING count(*) > 1")
def near_dup_guard(spark, sf):
    """Blocks of active facts that the merge guard lets meet."""
    return dedup.guarded_blocks(table(spark, sf, "facts")).select("scope", "first", "n")


def _near(spark, sf, forest=False):
    from ..operators.dense import present

    return dedup.near_pairs(table(spark, sf, "facts"), present(table(spark, sf, "fact_embeddings")), NEAR, forest)


@query(f"WITH {_guard_sql()} SELECT a, b, cosine FROM near")
def near_dup_pairs(spark, sf):
    """Pairs of active facts of one scope, guard and vector space whose vectors are near."""
    return _near(spark, sf).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


_CLUSTERS = f"""WITH RECURSIVE {_guard_sql()},
edges AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS fact_id, min(b) AS chain_id FROM reach GROUP BY 1)"""


def _members(spark, sf):
    """Clusters of near-duplicates."""
    return dedup.clusters(_near(spark, sf, forest=True))


@query(_CLUSTERS + "SELECT fact_id, chain_id AS cluster FROM comp")
def dup_clusters(spark, sf):
    return _members(spark, sf)


_PLAN = f"""{_CLUSTERS}, r AS (SELECT comp.chain_id AS cluster, f.*, ({ACTIVE}) AS live FROM comp JOIN facts f USING (fact_id)),
w AS (SELECT cluster, fact_id, row_number() OVER (PARTITION BY cluster ORDER BY live DESC, coalesce(trust_score, 0) * coalesce(retrieval_count, 0) DESC, coalesce(created_at, '~'), fact_id) AS rn FROM r),
t AS (SELECT cluster, fact_id, unnest(l) AS tag, unnest(range(0, len(l))) AS i FROM (SELECT cluster, fact_id, list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM r)),
u AS (SELECT cluster, string_agg(tag, ',' ORDER BY o) AS tags FROM (SELECT cluster, tag, min(fact_id * 1000 + i) AS o FROM t GROUP BY 1, 2) GROUP BY 1),
lose AS (SELECT r.fact_id, w.fact_id AS survivor FROM r JOIN w ON w.cluster = r.cluster AND rn = 1 WHERE r.fact_id <> w.fact_id)"""


@query(_PLAN + """
SELECT r.cluster, max(w.fact_id) FILTER (WHERE rn = 1) AS survivor, CAST(count(*) - 1 AS BIGINT) AS dropped, CAST(sum(coalesce(retrieval_count, 0)) AS BIGINT) AS retrieval_count,
       CAST(sum(coalesce(helpful_count, 0)) AS BIGINT) AS helpful_count, coalesce(any_value(u.tags), '') AS tags, count(*) > 25 AS suspicious
FROM r JOIN w ON w.cluster = r.cluster AND w.fact_id = r.fact_id LEFT JOIN u ON u.cluster = r.cluster GROUP BY 1""")
def merge_plan(spark, sf):
    """What merging the clusters would write."""
    return dedup.merge_plan(table(spark, sf, "facts"), _members(spark, sf))


def _losers(spark, sf):
    return dedup.merged_ids(table(spark, sf, "facts"), _members(spark, sf))


@query(_PLAN + """
SELECT DISTINCT coalesce(survivor, p.fact_id) AS fact_id, observation_id, relation FROM fact_provenance p LEFT JOIN lose USING (fact_id)""")
def merge_references(spark, sf):
    """The evidence edges with merged facts replaced by their survivor."""
    return dedup.merged_rows(table(spark, sf, "fact_provenance").select("fact_id", "observation_id", "relation"), _losers(spark, sf), "deduplicate")


@query(_PLAN + """
, m AS (SELECT f.fact_id, coalesce(s.survivor, f.superseded_by) AS link FROM facts f LEFT JOIN lose s ON s.fact_id = f.superseded_by WHERE f.fact_id NOT IN (SELECT fact_id FROM lose))
SELECT fact_id, CASE WHEN link <> fact_id THEN link END AS superseded_by FROM m""")
def merged_links(spark, sf):
    """The facts that stay after a merge, with their links led to survivors."""
    f = table(spark, sf, "facts")
    m = _members(spark, sf)
    return dedup.merged_facts(f, dedup.merge_plan(f, m), dedup.merged_ids(f, m)).select("fact_id", "superseded_by")


@query(_PLAN + "SELECT fact_id, embedding_identity FROM fact_embeddings WHERE fact_id NOT IN (SELECT fact_id FROM lose)")
def merged_vectors(spark, sf):
    return dedup.merged_rows(table(spark, sf, "fact_embeddings").select("fact_id", "embedding_identity"), _losers(spark, sf), "delete")


@query(_PLAN + f"""
, b AS (SELECT (SELECT count(*) FROM lose) AS dropped, (SELECT count(*) FROM facts WHERE {ACTIVE} AND content IS NOT NULL) AS active)
SELECT CAST(dropped AS BIGINT) AS dropped, CAST(active - dropped AS BIGINT) AS stay FROM b""")
def merge_guard(spark, sf):
    """How many facts the merge drops and keeps; outside of its band it raises."""
    f = table(spark, sf, "facts")
    plan = dedup.merge_plan(f, _members(spark, sf))
    dedup.check_merge(f, plan, 0, 10**12)
    n = plan.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))
    return n.join(dedup.mergeable(f).agg(F.count(F.lit(1)).alias("_a"))).select("dropped", (F.col("_a") - F.col("dropped")).alias("stay"))


def _erased(spark, sf):
    return table(spark, sf, "facts").where("sensitivity = 'sensitive'").select("fact_id")


_ERASED = "(SELECT fact_id FROM facts WHERE sensitivity = 'sensitive')"


@query(f"""
SELECT 'facts' AS what, CAST(count(*) AS BIGINT) AS n FROM facts WHERE fact_id IN {_ERASED}
UNION ALL SELECT 'provenance', count(*) FROM fact_provenance WHERE fact_id IN {_ERASED}
UNION ALL SELECT 'vectors', count(*) FROM fact_embeddings WHERE fact_id IN {_ERASED}
UNION ALL SELECT 'links', count(*) FROM facts WHERE superseded_by IN {_ERASED}
UNION ALL SELECT 'conflicts closed', count(*) FROM (SELECT conflict_group FROM facts WHERE conflict_group IS NOT NULL GROUP BY 1
  HAVING count(*) FILTER (WHERE fact_id IN {_ERASED}) > 0 AND count(*) FILTER (WHERE fact_id NOT IN {_ERASED}) <= 1)""")
def erase_cascade(spark, sf):
    return erasure.cascade(table(spark, sf, "facts"), table(spark, sf, "fact_provenance"), table(spark, sf, "fact_embeddings"), _erased(spark, sf))


@query(f"""
SELECT observation_id, bool_or(fact_id NOT IN {_ERASED}) AS shared FROM fact_provenance WHERE observation_id IN (SELECT observation_id FROM observations)
GROUP BY 1 HAVING bool_or(fact_id IN {_ERASED})""")
def erased_observations(spark, sf):
    return erasure.erased_observations(table(spark, sf, "fact_provenance"), table(spark, sf, "observations"), _erased(spark, sf))


@query(f"""
SELECT fact_id, CASE WHEN sensitivity = 'sensitive' THEN '[erased]' ELSE content END AS content, CASE WHEN sensitivity = 'sensitive' THEN 'fact' ELSE memory_kind END AS memory_kind,
       CASE WHEN sensitivity = 'sensitive' THEN NULL ELSE object_value END AS object_value FROM facts""")
def erased_facts(spark, sf):
    return erasure.erased_facts(table(spark, sf, "facts"), _erased(spark, sf)).select("fact_id", "content", "memory_kind", "object_value")


@query(f"""
SELECT fact_id FROM facts WHERE memory_kind = 'insight' AND invalid_at IS NULL AND fact_id NOT IN {_ERASED} AND fact_id IN (
  SELECT fact_id FROM fact_provenance WHERE relation = 'derived_from' AND observation_id IN (SELECT observation_id FROM fact_provenance WHERE fact_id IN {_ERASED})
  UNION SELECT fact_id FROM (SELECT fact_id, unnest(string_split(regexp_extract(tags, 'source_facts:([0-9]+(?:,[0-9]+)*)', 1), ',')) AS x FROM facts WHERE tags LIKE '%source_facts:%')
        WHERE TRY_CAST(x AS BIGINT) IN {_ERASED})""")
def insight_invalidation(spark, sf):
    return erasure.invalidated_insights(table(spark, sf, "facts"), table(spark, sf, "fact_provenance"), _erased(spark, sf))


_JOBS = f"""jobs AS (SELECT observation_id AS id, content_sha256 AS payload_hash, {at('recorded_at')} AS created, CAST(observation_id % 7 AS INTEGER) AS attempts,
  CASE WHEN observation_id % 11 = 0 THEN 'dead' WHEN observation_id % 5 = 0 THEN 'processing' ELSE 'pending' END AS status,
  CASE WHEN observation_id % 5 = 0 THEN {at('recorded_at')} + (observation_id % 13) * 100 END AS lease_until, {at('recorded_at')} + (observation_id % 3) * 60 AS not_before
  FROM observations WHERE observation_content IS NOT NULL AND recorded_at IS NOT NULL)"""


def _jobs(spark, sf):
    return queues.jobs(table(spark, sf, "observations"))


@query(f"""
WITH {_JOBS} SELECT id, payload_hash, row_number() OVER w = 1 AS accepted, first_value(id) OVER w AS existing_id FROM jobs WHERE status IN ('pending', 'processing') WINDOW w AS (PARTITION BY payload_hash ORDER BY id)""")
def queue_enqueue(spark, sf):
    return queues.enqueue(_jobs(spark, sf))


@query(f"""
WITH {_JOBS} SELECT id, CAST(attempts + 1 AS INTEGER) AS attempts, CAST({NOW + 300} AS BIGINT) AS lease_until FROM jobs
WHERE attempts < 5 AND ((status = 'pending' AND coalesce(not_before, 0) <= {NOW}) OR (status = 'processing' AND lease_until <= {NOW})) ORDER BY created, id LIMIT 100""")
def queue_claim_plan(spark, sf):
    return queues.claim_plan(_jobs(spark, sf), NOW, 100)


@query(f"""
WITH {_JOBS} SELECT id, CAST(attempts + 1 AS INTEGER) AS attempts, CASE WHEN attempts + 1 >= 5 THEN 'dead' ELSE 'pending' END AS status,
  CASE WHEN attempts + 1 < 5 THEN CAST({NOW} + least(300, CAST(pow(2, attempts + 1) AS INTEGER)) AS BIGINT) END AS not_before FROM jobs WHERE status = 'processing'""")
def queue_transition(spark, sf):
    return queues.after_failure(_jobs(spark, sf), NOW)


@query(f"""
WITH {_JOBS} SELECT payload_hash, min(id) AS id, CAST(count(*) AS BIGINT) AS dead FROM jobs WHERE status = 'dead' AND payload_hash NOT IN (SELECT payload_hash FROM jobs WHERE status <> 'dead') GROUP BY 1""")
def queue_revive(spark, sf):
    return queues.revivable(_jobs(spark, sf))


@query(f"WITH {_JOBS} SELECT status, CAST(count(*) AS BIGINT) AS jobs, CAST(max({NOW} - created) AS BIGINT) AS oldest_age, CAST(count(*) FILTER (WHERE attempts >= 5) AS BIGINT) AS exhausted FROM jobs GROUP BY 1")
def job_health(spark, sf):
    return queues.health(_jobs(spark, sf), NOW)


@query("""
SELECT fact_id, CASE WHEN content IS NULL OR content = '' OR invalid_at IS NOT NULL OR superseded_by IS NOT NULL THEN 'omitted' WHEN conflict_group IS NOT NULL THEN 'conflict'
  WHEN correction_status = 'unreviewed' THEN 'unreviewed' ELSE 'current' END AS section FROM facts""")
def export_partition(spark, sf):
    return sinks.export_partition(table(spark, sf, "facts"))


@query(f"SELECT fact_id, content, scope FROM facts WHERE {ACTIVE} AND scope IN {_SCOPE_LIST} AND coalesce(sensitivity, 'normal') = 'normal'")
def browse_snapshot(spark, sf):
    return sinks.browse_snapshot(table(spark, sf, "facts"), SCOPES).select("fact_id", "content", "scope")


@query("""
SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def events_hourly(spark, sf):
    """Engine extra: tumbling windows over the events."""
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
