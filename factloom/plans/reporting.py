"""Queries of the evaluation reports: gates by threshold and rule, leaks, capture, personal cases, conflicts, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..operators.eligibility import retired_by_prefix
from ..sources.tables import table
from .retrieval import _Q, _RESULTS, _bm25_top, _lit, results, search_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def report_results(spark, sf):
    """The ranked lists of ``results`` with scores between 0 and 1, trust, and what a rule looks at."""
    f = table(spark, sf, "facts").select("fact_id", F.col("trust_score").alias("trust"), retired_by_prefix().alias("retired"))
    s = F.round("bm25", 6)
    t = _bm25_top(spark, sf).join(f, "fact_id").select(F.col("query_id").alias("case_id"), F.struct("rank", "fact_id", F.round(s / (s + 10), 6).alias("score"), "trust", F.lit(True).alias("category_ok"), "retired").alias("x"))
    rows = t.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x.fact_id.alias("fact_id"), x.score.alias("score"), x.trust.alias("trust"), x.category_ok.alias("category_ok"), x.retired.alias("retired"))).alias("rows"))
    r = results(spark, sf).select("case_id", "case_type", "gold", F.array("gold").alias("expected"), "stale", "abstain").join(rows, "case_id", "left")
    none = F.array().cast("array<struct<fact_id: bigint, score: double, trust: double, category_ok: boolean, retired: boolean>>")
    return r.withColumn("rows", F.coalesce("rows", none))


_RETIRED = "coalesce(starts_with(lower(ltrim(content)), 'superseded') OR starts_with(lower(ltrim(content)), 'stale/disabled') OR starts_with(lower(ltrim(content)), 'historical/superseded'), FALSE)"


def _gates(thresholds, named) -> str:
    rows = [("none", {})] + [(f"score>={t:g}", {"min_score": t}) for t in thresholds] + [(r["name"], r) for r in named]
    num = lambda r, k: f"CAST({r[k]} AS DOUBLE)" if k in r else "CAST(NULL AS DOUBLE)"
    return "gates AS (SELECT * FROM (VALUES " + ", ".join(f"({_lit(n)}, {num(r, 'min_score')}, {num(r, 'min_margin')}, {num(r, 'min_trust')}, {bool(r.get('reject_stale_prefix'))})" for n, r in rows) + ") v(rule, min_score, min_margin, min_trust, fresh))"


_GATED = f"""{_RESULTS},
top AS (SELECT query_id AS case_id, fact_id, rank, round(round(bm25, 6) / (round(bm25, 6) + 10), 6) AS score, trust_score AS trust, {_RETIRED} AS retired FROM t JOIN facts USING (fact_id) WHERE rank <= 10),
mg AS (SELECT case_id, max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2) AS margin FROM top GROUP BY 1),
{_gates(reports.THRESHOLDS, reports.RULES)},
w AS (SELECT e.case_id, case_type, gold, stale, abstain, rule, list(top.fact_id ORDER BY rank) FILTER (WHERE top.fact_id IS NOT NULL AND (min_score IS NULL OR coalesce(score >= min_score, FALSE)) AND (min_trust IS NULL OR coalesce(trust >= min_trust, FALSE))
    AND (NOT fresh OR NOT retired) AND (min_margin IS NULL OR margin IS NULL OR margin >= min_margin)) AS l
  FROM e CROSS JOIN gates LEFT JOIN top ON top.case_id = e.case_id LEFT JOIN mg ON mg.case_id = e.case_id GROUP BY ALL),
x AS (SELECT *, coalesce(l, []) AS ranked2 FROM w),
y AS (SELECT *, nullif(coalesce(list_position(ranked2, gold), 0), 0) AS gr2, list_filter(ranked2, lambda z: NOT list_contains(stale, z)) AS fresh2 FROM x),
z AS (SELECT *, CASE WHEN list_contains(fresh2, gold) THEN 1.0 / len(fresh2) ELSE 0.0 END AS sp, CASE WHEN list_contains(fresh2, gold) THEN 1.0 ELSE 0.0 END AS sr, NOT list_contains(stale, gold) AND list_contains(ranked2, gold) AS found FROM y)"""


def _block() -> str:
    hit = lambda k: f"CASE WHEN coalesce(gr2 <= {k}, FALSE) THEN 1.0 ELSE 0.0 END"
    rate = lambda n, d: f"round(coalesce(CAST({n} AS DOUBLE) / nullif({d}, 0), 0.0), 6)"
    n = lambda c: f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT)"
    ta, fc, fa = n("abstain AND len(ranked2) = 0"), n("abstain AND len(ranked2) > 0"), n("NOT abstain AND NOT found")
    leak = lambda k: f"list_has_any(list_slice(ranked2, 1, {k}), stale)"
    return ", ".join([
        "CAST(count(*) AS BIGINT) AS cases", f"{n('len(ranked2) > 0')} AS accepted", *[f"round(avg({hit(k)}), 6) AS recall_{k}" for k in (1, 3, 5, 10)], "round(avg(coalesce(1.0 / gr2, 0.0)), 6) AS mrr",
        f"{n('NOT abstain')} AS answerable", *[f"round(coalesce(avg({hit(k)}) FILTER (WHERE NOT abstain), 0.0), 6) AS answerable_recall_{k}" for k in (1, 3, 5, 10)],
        "round(coalesce(avg(coalesce(1.0 / gr2, 0.0)) FILTER (WHERE NOT abstain), 0.0), 6) AS answerable_mrr", f"{ta} AS true_abstain", f"{fc} AS false_confident", f"{fa} AS false_abstain", f"{n('NOT abstain AND found')} AS correct_answer",
        f"{n('len(stale) > 0')} AS exposed", f"{n(leak(1))} AS leaks_1", f"{n(leak(3))} AS leaks_3", "round(avg(sp), 6) AS set_precision", "round(avg(sr), 6) AS set_recall", "round(avg(CASE WHEN sp + sr > 0 THEN 2 * sp * sr / (sp + sr) ELSE 0.0 END), 6) AS set_f1",
        f"{rate(n(leak(3)), 'count(*)')} AS leak_rate_3", f"{rate(n(leak(3)), n('len(stale) > 0'))} AS exposed_leak_rate_3", f"{rate(ta, ta + ' + ' + fa)} AS abstain_precision", f"{rate(ta, ta + ' + ' + fc)} AS abstain_recall",
        f"{rate('2 * ' + ta, '2 * ' + ta + ' + ' + fa + ' + ' + fc)} AS abstain_f1",
    ])


@query(f"WITH {_GATED} SELECT 'rule' AS section, rule AS key, {_block()} FROM z GROUP BY rule UNION ALL SELECT 'case_type', case_type, {_block()} FROM z WHERE rule = 'none' GROUP BY case_type")
def full_report(spark, sf):
    return reports.full_report(report_results(spark, sf))


@query(f"""
WITH {_GATED}, s AS (SELECT 'top_score' AS what, score AS v FROM top WHERE rank = 1 UNION ALL SELECT 'margin', round(margin, 6) FROM mg WHERE margin IS NOT NULL)
SELECT what, CAST(count(*) AS BIGINT) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, min(v) AS least, max(v) AS most FROM s GROUP BY 1""")
def score_spread(spark, sf):
    return reports.score_spread(report_results(spark, sf))


@query(f"""
WITH {_GATED}, n AS (SELECT *, list_has_any(list_slice(ranked2, 1, 3), stale) AS leak FROM z WHERE rule = 'none'),
c AS (SELECT conflict_group, count(DISTINCT fact_id) AS n FROM facts WHERE conflict_group IS NOT NULL GROUP BY 1),
a AS (SELECT 'stale_fact_leak_rate' AS metric, round(avg(CASE WHEN leak THEN 1.0 ELSE 0.0 END), 6) AS value, count(*) AS cases FROM n WHERE len(stale) > 0
  UNION ALL SELECT 'abstention_correctness', round(avg(CASE WHEN len(ranked2) = 0 THEN 1.0 ELSE 0.0 END), 6), count(*) FROM n WHERE abstain
  UNION ALL SELECT 'temporal_asof_correctness', NULL, 0 UNION ALL SELECT 'contradiction_detection_rate', round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6), count(*) FROM c UNION ALL SELECT 'injection_resistance', NULL, 0
  UNION ALL SELECT 'tokens_per_query', round(avg(v), 6), count(*) FROM (SELECT CAST(length(query) AS DOUBLE) AS v FROM q) UNION ALL SELECT 'latency_ms', NULL, 0)
SELECT metric, CASE WHEN cases > 0 THEN 'measured' ELSE 'blocked' END AS status, CASE WHEN cases > 0 THEN CAST(value AS DOUBLE) END AS value, CAST(cases AS BIGINT) AS cases FROM a""")
def truth_metrics(spark, sf):
    """All seven measures; what the tables hold no cases for is blocked."""
    f = table(spark, sf, "facts").where("conflict_group is not null")
    conflicts = f.groupBy("conflict_group").agg((F.countDistinct("fact_id") > 1).alias("detected"))
    tokens = search_queries(spark, sf).select(F.length("query").cast("double").alias("value"))
    return reports.truth_metrics(report_results(spark, sf), conflicts=conflicts, tokens=tokens)


# ---- capture ------------------------------------------------------------------------------------

def _capture(spark, sf):
    """Counts of each gold case read as a prediction: typed facts need a value, the speaker is right where role and assertion agree."""
    g = table(spark, sf, "transcript_gate_gold").select("case_id", F.explode_outer("facts").alias("f"))
    has, typed = F.col("f").isNotNull(), F.col("f.state").isNotNull()
    whole = F.col("f.state.value").isNotNull() & F.col("f.state.subject").isNotNull() & F.col("f.state.predicate").isNotNull()
    same = F.coalesce(F.col("f.asserted_by") == F.col("f.evidence_role"), F.lit(False))
    n = lambda c: F.count_if(has & c)
    return g.groupBy("case_id").agg(
        n(same).alias("speaker_correct"), n(F.lit(True)).alias("speaker_predicted"), n(~same).alias("misattributed"), n(typed).alias("typed_expected"), n(typed & whole).alias("typed_complete"), n(typed).alias("typed_predicted"), n(typed & whole & same).alias("typed_correct"),
        n(typed & ~whole).alias("silent"), n(~typed).alias("incidental_expected"), n(~typed & same).alias("incidental_matched"), n(~typed).alias("incidental_predicted"), n(F.col("f.evidence_role").isin("assistant", "tool")).alias("leaks"),
    )


_CAPTURE = """u AS (SELECT case_id, unnest(CASE WHEN len(facts) > 0 THEN facts ELSE [NULL] END) AS f FROM transcript_gate_gold),
k AS (SELECT case_id, f IS NOT NULL AS has, f.state IS NOT NULL AS typed, f.state.value IS NOT NULL AND f.state.subject IS NOT NULL AND f.state.predicate IS NOT NULL AS whole, coalesce(f.asserted_by = f.evidence_role, FALSE) AS same, f.evidence_role AS role FROM u),
c AS (SELECT case_id, count(*) FILTER (WHERE has AND same) AS sc, count(*) FILTER (WHERE has) AS sp, count(*) FILTER (WHERE has AND NOT same) AS mis, count(*) FILTER (WHERE has AND typed) AS te, count(*) FILTER (WHERE has AND typed AND whole) AS tc,
  count(*) FILTER (WHERE has AND typed AND whole AND same) AS tk, count(*) FILTER (WHERE has AND typed AND NOT whole) AS si, count(*) FILTER (WHERE has AND NOT typed) AS ie, count(*) FILTER (WHERE has AND NOT typed AND same) AS im, count(*) FILTER (WHERE has AND role IN ('assistant', 'tool')) AS lk FROM k GROUP BY 1),
s AS (SELECT CAST(count(*) AS BIGINT) AS cases, CAST(sum(lk) AS BIGINT) AS leaks, round(count(*) FILTER (WHERE lk > 0) / CAST(count(*) AS DOUBLE), 6) AS forbidden_rate, round(sum(mis) / CAST(sum(sp) AS DOUBLE), 6) AS misattribution_rate, round(sum(sc) / CAST(sum(sp) AS DOUBLE), 6) AS speaker_accuracy,
  round(sum(tk) / CAST(sum(te) AS DOUBLE), 6) AS typed_precision, round(sum(tc) / CAST(sum(te) AS DOUBLE), 6) AS typed_recall, round(sum(si) / CAST(sum(te) AS DOUBLE), 6) AS silent_demotion_rate, round(sum(im) / CAST(sum(ie) AS DOUBLE), 6) AS incidental_recall, round(sum(im) / CAST(sum(ie) AS DOUBLE), 6) AS incidental_precision FROM c)"""


@query(f"WITH {_CAPTURE} SELECT * FROM s")
def capture_metrics(spark, sf):
    return reports.capture_metrics(_capture(spark, sf))


@query(f"""
WITH {_CAPTURE}, f AS (SELECT list_filter([CASE WHEN forbidden_rate > 0 OR leaks > 0 THEN 'forbidden_assistant_tool' END, CASE WHEN misattribution_rate > 0 THEN 'speaker_attribution' END, CASE WHEN typed_precision < 1 THEN 'typed_slot_precision' END,
  CASE WHEN silent_demotion_rate > 0 THEN 'silent_demotion' END, CASE WHEN typed_recall < 0.9 THEN 'typed_slot_completeness' END, CASE WHEN incidental_recall < 0.7 THEN 'incidental_durable_recall' END, CASE WHEN incidental_precision < 0.9 THEN 'incidental_durable_precision' END], lambda x: x IS NOT NULL) AS l FROM s)
SELECT len(l) = 0 AS ship, coalesce(array_to_string(l, ','), '') AS failed FROM f""")
def capture_gate(spark, sf):
    return reports.capture_gate(reports.capture_metrics(_capture(spark, sf)))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS runs, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95 FROM (SELECT event_type, CAST(round(value * 1000) AS BIGINT) AS v FROM events WHERE value IS NOT NULL) GROUP BY 1")
def latency_percentiles(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.round(F.col("value") * 1000).cast("long").alias("ns"))
    return reports.latency_percentiles(e, "event_type", "ns")


# ---- personal cases -----------------------------------------------------------------------------

def _personal(spark, sf):
    """A case for every query: its own fact or the first word of its object is expected, the values of facts it replaced are forbidden."""
    q = search_queries(spark, sf).select(F.col("query_id").alias("case_id"))
    f = table(spark, sf, "facts").select(F.col("fact_id").alias("case_id"), F.coalesce("category", F.lit("none")).alias("category"), F.regexp_extract(F.coalesce("object_value", F.lit("")), r"[A-Za-z]{4,}", 0).alias("w"), F.col("superseded_by").isNotNull().alias("old"))
    c = q.join(f, "case_id")
    word = F.when(F.col("w") != "", F.array("w")).otherwise(F.array().cast("array<string>"))
    return c.select("case_id", "category", F.array("case_id").alias("expected_ids"), word.alias("expected_patterns"), F.when(F.col("old"), F.array(F.lit("deploy[a-z]+"))).otherwise(F.array().cast("array<string>")).alias("forbidden_patterns"), F.col("old").alias("should_abstain"))


_PERSONAL = f"""{_RESULTS},
pc AS (SELECT query_id AS case_id, coalesce(category, 'none') AS category, regexp_extract(coalesce(object_value, ''), '[A-Za-z]{{4,}}') AS w, superseded_by IS NOT NULL AS old FROM q JOIN facts ON fact_id = query_id),
pr AS (SELECT case_id, rank, fact_id = case_id OR (w <> '' AND regexp_matches(coalesce(content, ''), '(?i)' || w)) AS good, old AND regexp_matches(coalesce(content, ''), '(?i)deploy[a-z]+') AS bad FROM t JOIN facts USING (fact_id) JOIN pc ON pc.case_id = query_id WHERE rank <= 10),
pk AS (SELECT pc.case_id, category, old, CAST(min(rank) FILTER (WHERE good) AS INTEGER) AS expected_rank, CAST(min(rank) FILTER (WHERE bad) AS INTEGER) AS forbidden_rank, count(rank) = 0 AS abstained FROM pc LEFT JOIN pr USING (case_id) GROUP BY 1, 2, 3)"""


def _case_ranks(spark, sf):
    ranked = _bm25_top(spark, sf).join(table(spark, sf, "facts").select("fact_id", "content"), "fact_id").select(F.col("query_id").alias("case_id"), "rank", "fact_id", "content")
    return ranked, reports.case_ranks(_personal(spark, sf), ranked)


@query(f"WITH {_PERSONAL} SELECT case_id, expected_rank, forbidden_rank FROM pk")
def case_ranks(spark, sf):
    return _case_ranks(spark, sf)[1]


@query(f"""
WITH {_PERSONAL} SELECT coalesce(category, '(all)') AS category, CAST(count(*) AS BIGINT) AS cases, round(coalesce(count(*) FILTER (WHERE NOT old AND NOT abstained AND expected_rank = 1) / nullif(CAST(count(*) FILTER (WHERE NOT old) AS DOUBLE), 0), 0.0), 6) AS recall_1,
  round(coalesce(count(*) FILTER (WHERE NOT old AND NOT abstained AND expected_rank <= 3) / nullif(CAST(count(*) FILTER (WHERE NOT old) AS DOUBLE), 0), 0.0), 6) AS recall_3, round(coalesce(count(*) FILTER (WHERE old AND forbidden_rank <= 3) / nullif(CAST(count(*) FILTER (WHERE old) AS DOUBLE), 0), 0.0), 6) AS stale_leak_rate,
  round(coalesce(count(*) FILTER (WHERE old AND abstained) / nullif(CAST(count(*) FILTER (WHERE old) AS DOUBLE), 0), 0.0), 6) AS abstention_correctness, CAST(count(*) FILTER (WHERE NOT old AND abstained) AS BIGINT) AS false_abstentions FROM pk GROUP BY ROLLUP (category)""")
def personal_summary(spark, sf):
    ranked, r = _case_ranks(spark, sf)
    c = _personal(spark, sf).select("case_id", "category", "should_abstain", F.col("should_abstain").alias("protected"))
    some = ranked.select("case_id").distinct().withColumn("_some", F.lit(True))
    return reports.personal_summary(c.join(r, "case_id").join(some, "case_id", "left").withColumn("abstained", F.col("_some").isNull()))


@query(f"""
WITH {_PERSONAL}, el AS (SELECT category, fact_id, coalesce(content, '') AS content FROM facts WHERE invalid_at IS NULL AND superseded_by IS NULL AND conflict_group IS NULL AND scope = 'private' AND trust_score >= 0.3),
m AS (SELECT case_id, max(CASE WHEN fact_id = case_id OR (w <> '' AND regexp_matches(content, '(?i)' || w)) THEN 1 ELSE 0 END) AS ok FROM pc JOIN el USING (category) WHERE NOT old GROUP BY 1)
SELECT case_id, 'expected is no active private fact of the category' AS problem FROM pc LEFT JOIN m USING (case_id) WHERE NOT old AND coalesce(ok, 0) = 0""")
def case_problems(spark, sf):
    return reports.case_problems(_personal(spark, sf), table(spark, sf, "facts"))


# ---- conflicts, evidence, decisions -------------------------------------------------------------

@query(f"""
WITH {_Q}, qn AS (SELECT query_id, token, count(*) OVER (PARTITION BY query_id) AS n FROM qt),
m AS (SELECT fact_id, conflict_group, unnest(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+'))) AS token FROM facts WHERE conflict_group IS NOT NULL AND invalid_at IS NULL AND superseded_by IS NULL AND trust_score >= 0.3),
g AS (SELECT query_id, conflict_group, fact_id, round(CAST(count(*) AS DOUBLE) / any_value(n), 6) AS score FROM m JOIN qn USING (token) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM g) SELECT query_id, conflict_group, fact_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def conflict_search(spark, sf):
    return reports.conflict_search(table(spark, sf, "facts"), search_queries(spark, sf))


_TURNS = """f AS (SELECT case_id, CAST(unnest(range(0, len(facts))) AS INTEGER) AS item_no, unnest(facts) AS f FROM transcript_gate_gold),
tn AS (SELECT case_id, item_no AS turn, f.evidence_role AS role, f.content || ' ' || coalesce(f.evidence_excerpt, '') AS content FROM f),
j AS (SELECT f.case_id, f.item_no, coalesce(f.f.evidence_excerpt <> '', FALSE) AS said, tn.turn, coalesce(contains(tn.content, f.f.evidence_excerpt), FALSE) AND coalesce(f.f.evidence_excerpt <> '', FALSE) AS hit, coalesce(tn.role = f.f.evidence_role, FALSE) AS same FROM f JOIN tn USING (case_id))"""


@query(f"""
WITH {_TURNS}, g AS (SELECT case_id, item_no, bool_or(said) AS said, count(*) FILTER (WHERE hit) AS n, min(turn) FILTER (WHERE hit) AS one, count(*) FILTER (WHERE hit AND same) AS rn, min(turn) FILTER (WHERE hit AND same) AS rone, count(*) FILTER (WHERE same) AS sn, min(turn) FILTER (WHERE same) AS sone FROM j GROUP BY 1, 2)
SELECT case_id, item_no, CASE WHEN said AND n = 1 THEN one WHEN said AND rn = 1 THEN rone WHEN NOT said AND sn = 1 THEN sone END AS turn FROM g""")
def located_turns(spark, sf):
    """Each gold fact's turn, where a case's turns are its facts with their excerpts."""
    g = table(spark, sf, "transcript_gate_gold").select("case_id", F.posexplode("facts").alias("item_no", "f"))
    facts = g.select("case_id", "item_no", F.col("f.evidence_excerpt").alias("excerpt"), F.col("f.evidence_role").alias("role"))
    turns = g.select("case_id", F.col("item_no").alias("turn"), F.col("f.evidence_role").alias("role"), F.concat_ws(" ", "f.content", F.coalesce("f.evidence_excerpt", F.lit(""))).alias("content"))
    return reports.located_turns(facts, turns)


@query("""
WITH s AS (SELECT doc_id AS case_id, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT case_id, CAST(0 AS INTEGER) AS item_no, n // 4 >= 0 AND n // 4 + 10 <= n // 2 AS compatible FROM s""")
def compatible_evidence(spark, sf):
    """An excerpt at a quarter of each document against the span of its first half."""
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("case_id"), F.length("text").alias("n"))
    p = d.select("case_id", F.lit(0).alias("item_no"), F.expr("n div 4").alias("start"), F.expr("n div 4 + 10").alias("stop"))
    return reports.compatible_evidence(p, d.select("case_id", F.lit(0).alias("lo"), F.expr("n div 2").alias("hi")))


_DECIDED = """o AS (SELECT decision AS expected, case_id, unnest(CASE WHEN len(facts) > 0 THEN list_transform(facts, lambda x: CASE WHEN x.asserted_by = 'user' THEN 'inserted' ELSE 'rejected' END) ELSE [NULL] END) AS x FROM transcript_gate_gold),
d AS (SELECT case_id, any_value(expected) AS expected, list_distinct(list(CASE WHEN x = 'inserted' THEN 'add' ELSE x END) FILTER (WHERE x IS NOT NULL)) AS l FROM o GROUP BY 1), dd AS (SELECT case_id, expected, CASE WHEN coalesce(len(l), 0) = 0 THEN 'none' WHEN len(l) = 1 THEN l[1] ELSE 'mixed' END AS decision FROM d)"""


def _decisions(spark, sf):
    g = table(spark, sf, "transcript_gate_gold").select("case_id", "decision", F.explode_outer("facts").alias("f"))
    return g, reports.write_decisions(g.select("case_id", F.when(F.col("f").isNotNull(), F.when(F.col("f.asserted_by") == "user", "inserted").otherwise("rejected")).alias("outcome")))


@query(f"WITH {_DECIDED} SELECT case_id, decision FROM dd")
def write_decisions(spark, sf):
    return _decisions(spark, sf)[1]


@query(f"WITH {_DECIDED} SELECT coalesce(expected, '(all)') AS decision, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE expected = decision) AS BIGINT) AS correct, round(count(*) FILTER (WHERE expected = decision) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM dd GROUP BY ROLLUP (expected)")
def decision_accuracy(spark, sf):
    g, d = _decisions(spark, sf)
    return reports.decision_accuracy(g.select("case_id", F.col("decision").alias("expected")).distinct().join(d, "case_id"))


@query("""
WITH g AS (SELECT case_id, unnest(facts) AS f FROM transcript_gate_gold), c AS (SELECT coalesce(f.evidence_role, 'none') AS role, f.asserted_by = f.evidence_role AS label FROM g),
r AS (SELECT role, count(*) AS cases, count(*) FILTER (WHERE NOT coalesce(label, FALSE)) AS negatives FROM c GROUP BY ROLLUP (role))
SELECT coalesce(role, '(all)') AS role, CAST(cases AS BIGINT) AS cases, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 0.0::DOUBLE AS false_verify FROM r""")
def prefilter_score(spark, sf):
    """The deterministic screen as a verifier: it may reject, but it never verifies."""
    from ..operators.gates import verdicts

    g = table(spark, sf, "transcript_gate_gold").select("case_id", F.explode("facts").alias("f"))
    c = g.select(F.coalesce("f.evidence_role", F.lit("none")).alias("role"), F.when(F.col("f.asserted_by") == F.col("f.evidence_role"), "supported").otherwise("unsupported").alias("label"), F.lit("needs_review").alias("predicted"))
    return verdicts(c, "role")
