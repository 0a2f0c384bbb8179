"""Queries over ranked retrieval, its evaluation, and the transcript pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..operators import context, dense, eligibility, evaluation, expansion, firsts, legacy, lexical, ranking, screens, spans
from ..operators.eligibility import active, reviewed, visible
from ..sources.tables import table
from .store import ACTIVE, AT_KNOWN, IDENTITY, NOW, SCOPES, _KNOWN, _PRESENT, at

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _words_sql(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def search_queries(spark, sf):
    """A stated query set: the slot names of the typed facts whose identifier is divisible by 20, searched against all facts."""
    f = table(spark, sf, "facts").where("fact_id % 20 = 0 and subject_key is not null and predicate_key is not null")
    return f.select(F.col("fact_id").alias("query_id"), F.concat_ws(" ", "predicate_key", "subject_key").alias("query"))


_TOK = "regexp_extract_all(lower(concat_ws(' ', content, tags)), '[a-z0-9]+')"
_Q = """
q AS (SELECT fact_id AS query_id, concat_ws(' ', predicate_key, subject_key) AS query FROM facts WHERE fact_id % 20 = 0 AND subject_key IS NOT NULL AND predicate_key IS NOT NULL),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS token FROM q)"""
_ELIGIBLE = f"""{ACTIVE} AND scope IN ('private', 'work', 'public') AND coalesce(sensitivity, 'normal') = 'normal' AND trust_score >= 0.3 AND correction_status IS DISTINCT FROM 'unreviewed'"""
_BM25 = f"""{_Q},
d AS (SELECT fact_id, {_TOK} AS t FROM facts),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT fact_id, token, CAST(count(*) AS DOUBLE) AS tf, CAST(any_value(dl) AS DOUBLE) AS dl FROM (SELECT fact_id, len(t) AS dl, unnest(t) AS token FROM d) WHERE token IN (SELECT token FROM qt) GROUP BY 1, 2),
f AS (SELECT token, CAST(count(*) AS DOUBLE) AS df FROM p GROUP BY 1),
b AS (SELECT query_id, fact_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
      FROM qt JOIN p USING (token) JOIN f USING (token), st WHERE fact_id IN (SELECT fact_id FROM facts WHERE {_ELIGIBLE}) GROUP BY 1, 2)"""
_TOP = """t AS (SELECT query_id, fact_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, fact_id DESC) AS rank FROM b)"""


def _keep():
    return F.coalesce(active() & visible(SCOPES) & (F.col("trust_score") >= 0.3) & reviewed(), F.lit(False))


def _bm25_top(spark, sf, k=10):
    return lexical.top(lexical.bm25(table(spark, sf, "facts"), search_queries(spark, sf), _keep()), "bm25", k)


@query(f"""
SELECT fact_id, token, CAST(any_value(dl) AS INTEGER) AS dl, CAST(count(*) AS BIGINT) AS tf
FROM (SELECT fact_id, len(t) AS dl, unnest(t) AS token FROM (SELECT fact_id, {_TOK} AS t FROM facts)) GROUP BY 1, 2""")
def postings(spark, sf):
    return lexical.postings(table(spark, sf, "facts"))


@query(f"SELECT token, CAST(count(*) AS BIGINT) AS df FROM (SELECT unnest(list_distinct({_TOK})) AS token FROM facts) GROUP BY 1")
def doc_freq(spark, sf):
    return lexical.document_frequency(table(spark, sf, "facts"))


@query(f"WITH {_BM25}, {_TOP} SELECT query_id, fact_id, round(bm25, 6) AS bm25, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10")
def bm25_rank(spark, sf):
    return _bm25_top(spark, sf).select("query_id", "fact_id", F.round("bm25", 6).alias("bm25"), "rank")


def opening_queries(spark, sf):
    """A stated query set: the first two tokens of the facts whose identifier is divisible by 20."""
    f = table(spark, sf, "facts").where("fact_id % 20 = 0 and content is not null")
    return f.select(F.col("fact_id").alias("query_id"), F.array_join(F.slice(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0)), 1, 2), " ").alias("query"))


_OPENING = """
q AS (SELECT fact_id AS query_id, array_to_string(list_slice(regexp_extract_all(lower(content), '[a-z0-9]+'), 1, 2), ' ') AS query FROM facts WHERE fact_id % 20 = 0 AND content IS NOT NULL),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS token FROM q)"""


@query(f"""
WITH {_OPENING}, need AS (SELECT query_id, count(*) AS need FROM qt GROUP BY 1),
p AS (SELECT fact_id, unnest(list_distinct({_TOK})) AS token FROM facts WHERE {ACTIVE}),
h AS (SELECT query_id, fact_id FROM qt JOIN p USING (token) JOIN need USING (query_id) GROUP BY query_id, fact_id, need HAVING count(*) = need),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(trust_score, 0) DESC, fact_id) AS rank FROM h JOIN facts USING (fact_id)) SELECT query_id, fact_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def fts_and_search(spark, sf):
    """Current facts that hold every token of the query: ten each, the most trusted first."""
    f = table(spark, sf, "facts")
    return firsts.holding_all(f, opening_queries(spark, sf), active(), 10)


_OVER = """
o AS (SELECT query_id, fact_id, CAST(count(*) AS DOUBLE) AS shared, CAST(any_value(qn) AS DOUBLE) AS qn, CAST(any_value(dn) AS DOUBLE) AS dn
  FROM (SELECT query_id, token, count(*) OVER (PARTITION BY query_id) AS qn FROM qt)
  JOIN (SELECT fact_id, len(l) AS dn, unnest(l) AS token FROM (SELECT fact_id, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) AS l FROM facts WHERE content IS NOT NULL)) USING (token) GROUP BY 1, 2)"""


@query(f"""
WITH {_Q}, {_OVER}, j AS (SELECT query_id, fact_id, shared / (qn + dn - shared) AS x, shared / qn AS y FROM o WHERE shared / (qn + dn - shared) >= 0.05),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, fact_id DESC) AS rank FROM j)
SELECT query_id, fact_id, round(x, 6) AS jaccard, round(y, 6) AS coverage FROM r WHERE rank <= 10""")
def jaccard_search(spark, sf):
    """The ten facts of each query that share the largest part of their tokens."""
    o = lexical.top(lexical.overlap(table(spark, sf, "facts"), search_queries(spark, sf), 0.05), "jaccard", 10)
    return o.select("query_id", "fact_id", F.round("jaccard", 6).alias("jaccard"), F.round("coverage", 6).alias("coverage"))


def _vectors(spark, sf):
    return dense.present(table(spark, sf, "fact_embeddings"), IDENTITY)


def _query_vectors(spark, sf):
    return _vectors(spark, sf).where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "embedding")


@query(f"""
WITH {_PRESENT}, x AS (SELECT fact_id, CAST(embedding AS DOUBLE[]) AS e FROM v),
s AS (SELECT a.fact_id AS query_id, b.fact_id, list_cosine_similarity(a.e, b.e) AS c FROM x a, x b WHERE a.fact_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, fact_id) AS rank FROM s)
SELECT query_id, fact_id, round(c, 5) AS cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def cosine_topk(spark, sf):
    t = dense.top_k(_vectors(spark, sf), _query_vectors(spark, sf), 6)
    return t.select("query_id", "fact_id", F.round("cosine", 5).alias("cosine"), "rank")


_AGE = f"greatest(0.0, ({NOW} - %s) / 86400.0)"
_STEADY = at("valid_from")
_MOVING = f"coalesce({at('updated_at')}, {at('created_at')})"
_RECENCY = f"""CASE WHEN memory_kind IN ('state', 'insight') THEN coalesce(exp(-ln(2.0) * {_AGE % _STEADY} / 365.0), 1.0) ELSE coalesce(exp(-ln(2.0) * {_AGE % _MOVING} / 365.0), 0.0) END"""
_KIND = "CASE memory_kind WHEN 'state' THEN 1.0 WHEN 'insight' THEN 0.75 WHEN 'event' THEN 0.25 ELSE 0.5 END"
_REVIEW = "CASE WHEN correction_status IN ('human_confirmed', 'human_corrected') THEN 1.0 ELSE 0.0 END"
# the query texts are lower-case slot names: no anchors, so the subject prior is 0
_LEXICAL = f"""{_BM25}, {_TOP}, {_OVER},
c AS (SELECT query_id, t.fact_id, 0.25 / t.rank + 0.75 * coalesce(shared / qn, 0.0) AS fts, coalesce(shared / (qn + dn - shared), 0.0) AS jaccard FROM t LEFT JOIN o USING (query_id, fact_id)),
l AS (SELECT *, round(0.5833333333333334 * fts + 0.4166666666666667 * jaccard, 9) AS lexical FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, fact_id) AS lexical_rank FROM l),
z AS (SELECT query_id, fact_id, lexical_rank, trust_score, fts, jaccard, round(1.0 / (60 + lexical_rank) * 61, 6) AS fused,
  round(0.76 * (1.0 / (60 + lexical_rank) * 61) + 0.05 * coalesce(trust_score, 0.0) + 0.02 * {_KIND} + 0.03 * {_RECENCY} + 0.08 * {_REVIEW}, 6) AS score FROM k JOIN facts USING (fact_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, trust_score DESC, fact_id) AS rank FROM z WHERE score >= 0.12)"""


@query(f"WITH {_LEXICAL} SELECT query_id, fact_id, CAST(rank AS INTEGER) AS rank, fused, score FROM y WHERE rank <= 10")
def hybrid_lexical_only(spark, sf):
    f, q = table(spark, sf, "facts"), search_queries(spark, sf)
    r = ranking.fuse(ranking.candidates(f, q, SCOPES), f, q, NOW, ranking.LEXICAL)
    return r.select("query_id", "fact_id", "rank", "fused", "score")


@query(f"WITH {_LEXICAL}, y0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, trust_score DESC, fact_id) AS rank FROM z) SELECT query_id, fact_id, CAST(rank AS INTEGER) AS rank, round(fts, 6) AS fts, round(jaccard, 6) AS jaccard, fused, score, CASE WHEN score < 0.12 THEN 'below_floor' WHEN rank > 10 THEN 'beyond_limit' END AS excluded FROM y0 WHERE rank <= 48")
def explain_rows(spark, sf):
    f, q = table(spark, sf, "facts"), search_queries(spark, sf)
    return ranking.explain(f, q, SCOPES, NOW)


_HYBRID = f"""{_BM25}, {_TOP}, {_OVER}, {_PRESENT}, x AS (SELECT fact_id, CAST(embedding AS DOUBLE[]) AS e FROM v),
dn AS (SELECT a.fact_id AS query_id, b.fact_id, list_cosine_similarity(a.e, b.e) AS c FROM x a, x b WHERE a.fact_id % 20 = 0 AND b.fact_id IN (SELECT fact_id FROM facts WHERE {_ELIGIBLE})),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, fact_id) AS rank FROM dn), dk AS (SELECT query_id, fact_id, greatest(0.0, c) AS dense FROM dr WHERE rank <= 100),
lx AS (SELECT query_id, t.fact_id, 0.25 / t.rank + 0.75 * coalesce(shared / qn, 0.0) AS fts, coalesce(shared / (qn + dn - shared), 0.0) AS jaccard FROM t LEFT JOIN o USING (query_id, fact_id)),
al AS (SELECT query_id, fact_id, dense, round(0.35 * coalesce(fts, 0.0) + 0.25 * coalesce(jaccard, 0.0), 9) AS lexical FROM lx FULL JOIN dk USING (query_id, fact_id)),
rk AS (SELECT *, CASE WHEN lexical > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY lexical > 0 DESC, lexical DESC, fact_id) END AS lexical_rank,
  CASE WHEN dense >= 0.1 THEN row_number() OVER (PARTITION BY query_id ORDER BY coalesce(dense >= 0.1, FALSE) DESC, round(dense, 6) DESC NULLS LAST, fact_id) END AS dense_rank FROM al),
fu AS (SELECT *, (coalesce(0.6 / (60 + lexical_rank), 0.0) + coalesce(0.4 / (60 + dense_rank), 0.0)) * 61 AS fused FROM rk WHERE query_id IN (SELECT query_id FROM q)),
sc AS (SELECT query_id, fact_id, lexical_rank, dense_rank, round(fused, 6) AS fused, trust_score, scope, subject_key, predicate_key, object_value, memory_kind,
  round(0.76 * fused + 0.05 * coalesce(trust_score, 0.0) + 0.02 * {_KIND} + 0.03 * {_RECENCY} + 0.08 * {_REVIEW}, 6) AS score FROM fu JOIN facts USING (fact_id)),
rn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, trust_score DESC, fact_id) AS rank FROM sc WHERE score >= 0.12),
tp AS (SELECT a.query_id, a.score AS best, coalesce(a.scope = b.scope AND a.subject_key = b.subject_key AND a.predicate_key = b.predicate_key AND a.object_value IS DISTINCT FROM b.object_value AND a.memory_kind = 'state' AND b.memory_kind = 'state' AND a.score - b.score < 0.005, FALSE) AS tied
  FROM rn a LEFT JOIN rn b ON b.query_id = a.query_id AND b.rank = 2 WHERE a.rank = 1)"""


@query(f"WITH {_HYBRID} SELECT query_id, fact_id, CAST(rank AS INTEGER) AS rank, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(dense_rank AS INTEGER) AS dense_rank, fused, score, tied AS ambiguous FROM rn JOIN tp USING (query_id) WHERE rank <= 10 AND (NOT tied OR best - score < 0.005)")
def hybrid_rank(spark, sf):
    """Flagship: lexical and dense lists fused for every query, with priors and the ambiguity gate."""
    f = table(spark, sf, "facts")
    r = ranking.hybrid(f, search_queries(spark, sf), table(spark, sf, "fact_embeddings"), _query_vectors(spark, sf), SCOPES, NOW, IDENTITY)
    return r.select("query_id", "fact_id", "rank", "lexical_rank", "dense_rank", "fused", "score", "ambiguous")


def _pruned_sql() -> str:
    """BM25 with the queries' function words left out, unless there is nothing else."""
    stop = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
    qt = f"""qs AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS l, list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), lambda x: x NOT IN {stop}) AS r FROM q),
qt AS (SELECT query_id, unnest(CASE WHEN len(r) > 0 THEN r ELSE l END) AS token FROM qs)"""
    return _BM25.replace("qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS token FROM q)", qt)


_LEGACY = f"""{_pruned_sql()}, {_TOP},
lc AS (SELECT query_id, fact_id, bm25 / max(bm25) OVER (PARTITION BY query_id) AS fts FROM t WHERE rank <= 30),
lq AS (SELECT query_id, l AS q FROM qs), lt AS (SELECT fact_id, list_distinct({_TOK}) AS t, trust_score, updated_at, created_at, content FROM facts),
ls AS (SELECT query_id, fact_id, round((0.4 * fts + 0.3 * CASE WHEN len(t) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q, t)) AS DOUBLE) / len(list_distinct(list_concat(q, t))) END + 0.3 * 0.5) * coalesce(trust_score, 0.0), 6) AS score FROM lc JOIN lt USING (fact_id) JOIN lq USING (query_id)),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id DESC) AS rank FROM ls)"""


@query(f"WITH {_LEGACY} SELECT query_id, fact_id, score, CAST(rank AS INTEGER) AS rank FROM lr WHERE rank <= 10")
def legacy_plus_rank(spark, sf):
    """The older ranking: BM25 relative to the query's best, token overlap, neutral phase score, times trust."""
    return legacy.plus(table(spark, sf, "facts"), search_queries(spark, sf), _keep(), NOW)


@query()
def legacy_boosted_rank(spark, sf):
    """The older ranking with its entity boost and its decay."""
    f = table(spark, sf, "facts")
    e = table(spark, sf, "entities").where("name is not null").select(F.col("entity_id").alias("object_entity_id"), F.lower("name").alias("n"))
    names = f.where("object_entity_id is not null").select("fact_id", "object_entity_id").join(e, "object_entity_id").groupBy("fact_id").agg(F.collect_set("n").alias("names"))
    return legacy.plus(f, search_queries(spark, sf), _keep(), NOW, 10, names, 0.2, 180.0)


@query(f"""
WITH {_LEGACY}, {_PRESENT}, x AS (SELECT fact_id, CAST(embedding AS DOUBLE[]) AS e FROM v),
dn AS (SELECT a.fact_id AS query_id, b.fact_id, list_cosine_similarity(a.e, b.e) AS c FROM x a, x b WHERE a.fact_id % 20 = 0), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, fact_id) AS rank FROM dn), dk AS (SELECT * FROM dr WHERE rank <= 100),
h AS (SELECT query_id, fact_id, score FROM lr WHERE rank <= 10),
ex AS (SELECT dk.*, row_number() OVER (PARTITION BY query_id ORDER BY dk.rank) AS n FROM dk JOIN facts f USING (fact_id) WHERE (query_id, fact_id) NOT IN (SELECT query_id, fact_id FROM h) AND conflict_group IS NULL AND invalid_at IS NULL AND trust_score >= 0.3),
bo AS (SELECT query_id, fact_id, score FROM h UNION ALL SELECT query_id, fact_id, 0.0 FROM ex WHERE n <= 20),
bs AS (SELECT query_id, fact_id, round(0.6 * bo.score + coalesce(0.4 * (c + 1) / 2, 0.0), 6) AS score, replace(coalesce(updated_at, created_at, ''), ' ', 'T') AS at_ FROM bo LEFT JOIN dk USING (query_id, fact_id) JOIN facts USING (fact_id)),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, at_ DESC, fact_id) AS rank FROM bs),
bm AS (SELECT query_id FROM br GROUP BY 1 HAVING max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2) < 0.001)
SELECT query_id, fact_id, score, CAST(rank AS INTEGER) AS rank FROM br WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM bm)""")
def legacy_blend_rank(spark, sf):
    """The older ranking blended with vectors; a query whose best two nearly tie abstains."""
    f, q = table(spark, sf, "facts"), search_queries(spark, sf)
    d = dense.top_k(_vectors(spark, sf), _query_vectors(spark, sf), 100)
    return legacy.blended(legacy.plus(f, q, _keep(), NOW), d, f, 0.4, min_margin=0.001)


# ---- evaluation ---------------------------------------------------------------------------------


def results(spark, sf):
    """Ranked lists of every query with its gold fact; a query whose fact is not eligible should abstain."""
    t = _bm25_top(spark, sf)
    ranked = t.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "fact_id", F.round("bm25", 6).alias("s")))).alias("x"))
    f = table(spark, sf, "facts")
    stale = f.where("superseded_by is not null").select(F.col("superseded_by").alias("query_id"), F.col("fact_id").alias("old")).groupBy("query_id").agg(F.collect_set("old").alias("stale"))
    own = f.select(F.col("fact_id").alias("query_id"), F.coalesce("predicate_key", F.lit("none")).alias("case_type"), (~_keep()).alias("abstain"))
    r = search_queries(spark, sf).select("query_id").join(own, "query_id").join(ranked, "query_id", "left").join(stale, "query_id", "left")
    ids, scores = F.transform("x", lambda x: x.fact_id), F.transform("x", lambda x: x.s)
    none = F.array().cast("array<bigint>")
    return r.select(F.col("query_id").alias("case_id"), "case_type", F.col("query_id").alias("gold"), F.coalesce("stale", none).alias("stale"), F.coalesce(ids, none).alias("ranked"), F.coalesce(scores, F.array().cast("array<double>")).alias("scores"), "abstain")


_RESULTS = f"""{_BM25}, {_TOP},
g AS (SELECT query_id, list(fact_id ORDER BY rank) AS ranked, list(round(bm25, 6) ORDER BY rank) AS scores FROM t WHERE rank <= 10 GROUP BY 1),
stale AS (SELECT superseded_by AS query_id, list(fact_id) AS stale FROM facts WHERE superseded_by IS NOT NULL GROUP BY 1),
e AS (SELECT q.query_id AS case_id, coalesce(predicate_key, 'none') AS case_type, q.query_id AS gold, coalesce(stale, []) AS stale, coalesce(ranked, []) AS ranked, coalesce(scores, []) AS scores, NOT coalesce({_ELIGIBLE}, FALSE) AS abstain,
      nullif(coalesce(list_position(ranked, q.query_id), 0), 0) AS gr FROM q JOIN facts ON fact_id = q.query_id LEFT JOIN g ON g.query_id = q.query_id LEFT JOIN stale ON stale.query_id = q.query_id)"""


def _at_k(k: int) -> str:
    hit = f"coalesce(gr <= {k}, FALSE)"
    return f"round(avg(CASE WHEN {hit} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}, round(avg(CASE WHEN {hit} THEN 1.0 / log2(gr + 1.0) ELSE 0.0 END), 6) AS ndcg_{k}"


_CARD = f"CAST(count(*) AS BIGINT) AS cases, {', '.join(_at_k(k) for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0 / gr, 0.0)), 6) AS mrr, round(avg(CASE WHEN list_has_any(list_slice(ranked, 1, 3), stale) THEN 1.0 ELSE 0.0 END), 6) AS stale_3"


@query(f"WITH {_RESULTS} SELECT {_CARD} FROM e WHERE NOT abstain")
def retrieval_scorecard(spark, sf):
    return evaluation.scorecard(results(spark, sf))


@query(f"WITH {_RESULTS} SELECT case_type, {_CARD} FROM e WHERE NOT abstain GROUP BY 1")
def scorecard_by_type(spark, sf):
    return evaluation.scorecard(results(spark, sf), "case_type")


@query(f"""
WITH {_RESULTS} SELECT coalesce(case_type, '(all)') AS case_type, CAST(count(*) AS BIGINT) AS cases, round(avg(CASE WHEN coalesce(gr <= 1, FALSE) THEN 1.0 ELSE 0.0 END), 6) AS recall_1,
  round(avg(CASE WHEN coalesce(gr <= 3, FALSE) THEN 1.0 ELSE 0.0 END), 6) AS recall_3 FROM e WHERE NOT abstain GROUP BY ROLLUP (case_type)""")
def by_category(spark, sf):
    return evaluation.by_category(results(spark, sf))


@query(f"""
WITH {_RESULTS}, c AS (SELECT CAST(count(*) FILTER (WHERE abstain AND len(ranked) = 0) AS BIGINT) AS right_abstain, CAST(count(*) FILTER (WHERE abstain AND len(ranked) > 0) AS BIGINT) AS missed_abstain,
  CAST(count(*) FILTER (WHERE NOT abstain AND len(ranked) = 0) AS BIGINT) AS false_abstain, CAST(count(*) FILTER (WHERE NOT abstain AND len(ranked) > 0) AS BIGINT) AS answered FROM e)
SELECT *, round(coalesce(right_abstain / nullif(CAST(right_abstain + false_abstain AS DOUBLE), 0), 0.0), 6) AS precision, round(coalesce(right_abstain / nullif(CAST(right_abstain + missed_abstain AS DOUBLE), 0), 0.0), 6) AS recall FROM c""")
def abstention_matrix(spark, sf):
    return evaluation.abstention(results(spark, sf))


@query(f"""
WITH {_RESULTS}, h AS (SELECT x AS threshold, abstain, gold, list_filter(list_zip(ranked, scores), lambda z: z[2] >= x) AS kept FROM e, (VALUES (5.0::DOUBLE), (10.0), (15.0), (20.0)) v(x))
SELECT threshold, round(avg(CASE WHEN len(kept) > 0 AND kept[1][1] = gold THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT abstain), 6) AS recall_1, CAST(count(*) FILTER (WHERE len(kept) = 0) AS BIGINT) AS empty FROM h GROUP BY 1""")
def threshold_sweep(spark, sf):
    return evaluation.threshold_sweep(results(spark, sf), [5.0, 10.0, 15.0, 20.0])


@query("""
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def percentiles(spark, sf):
    return evaluation.nearest_rank(table(spark, sf, "events"), "value", [50, 95], "event_type")


_TAGS = "list_distinct(list_filter(list_transform(string_split(coalesce({0}, ''), ','), lambda x: lower(trim(x))), lambda x: x <> ''))"


@query(f"""
WITH s AS (SELECT a.fact_id, {_TAGS.format('a.tags')} AS p, {_TAGS.format('b.tags')} AS e FROM facts a JOIN facts b ON a.superseded_by = b.fact_id),
m AS (SELECT fact_id, CAST(len(list_intersect(p, e)) AS DOUBLE) AS hit, len(p) AS np, len(e) AS ne FROM s),
r AS (SELECT fact_id, CASE WHEN np = 0 AND ne = 0 THEN 1.0 ELSE coalesce(hit / nullif(np, 0), 0.0) END AS precision, CASE WHEN np = 0 AND ne = 0 THEN 1.0 ELSE coalesce(hit / nullif(ne, 0), 0.0) END AS recall FROM m)
SELECT fact_id, round(CAST(precision AS DOUBLE), 6) AS precision, round(CAST(recall AS DOUBLE), 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1 FROM r""")
def set_prf(spark, sf):
    from ..functions.text import tag_list

    f = table(spark, sf, "facts")
    tags = F.array_distinct(F.transform(tag_list(F.col("tags")), lambda t: F.lower(t)))
    new = f.select(F.col("fact_id").alias("superseded_by"), tags.alias("e"))
    r = evaluation.set_prf(f.where("superseded_by is not null").select("fact_id", "superseded_by", tags.alias("p")).join(new, "superseded_by"), "p", "e")
    return r.select("fact_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_ANSWER = "list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x NOT IN ('a', 'an', 'the', ''))"


@query(f"""
WITH s AS (SELECT a.fact_id, {_ANSWER.format('a.content')} AS x, {_ANSWER.format('b.content')} AS y FROM facts a JOIN facts b ON a.superseded_by = b.fact_id),
u AS (SELECT fact_id, t, count(*) AS c FROM (SELECT fact_id, unnest(x) AS t FROM s) GROUP BY 1, 2), w AS (SELECT fact_id, t, count(*) AS c FROM (SELECT fact_id, unnest(y) AS t FROM s) GROUP BY 1, 2),
h AS (SELECT fact_id, CAST(sum(least(u.c, w.c)) AS DOUBLE) AS hit FROM u JOIN w USING (fact_id, t) GROUP BY 1)
SELECT s.fact_id, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE coalesce(2 * coalesce(hit, 0.0) / nullif(len(x) + len(y), 0), 0.0) END, 6) AS f1 FROM s LEFT JOIN h USING (fact_id)""")
def token_f1(spark, sf):
    f = table(spark, sf, "facts")
    new = f.select(F.col("fact_id").alias("superseded_by"), F.col("content").alias("b"))
    return evaluation.token_f1(f.where("superseded_by is not null").select("fact_id", "superseded_by", F.col("content").alias("a")).join(new, "superseded_by"), "fact_id", "a", "b")


@query("""
WITH f AS (SELECT decision, case_id, unnest(CASE WHEN len(facts) > 0 THEN facts ELSE [NULL] END) AS x FROM transcript_gate_gold)
SELECT decision, CAST(count(DISTINCT case_id) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE x IS NOT NULL) AS BIGINT) AS facts, CAST(count(*) FILTER (WHERE x.state IS NOT NULL) AS BIGINT) AS typed,
  CAST(count(*) FILTER (WHERE x.asserted_by = 'user') AS BIGINT) AS by_user, CAST(count(*) FILTER (WHERE x.evidence_excerpt IS NOT NULL) AS BIGINT) AS with_evidence FROM f GROUP BY 1""")
def gate_metrics(spark, sf):
    return evaluation.gate_metrics(table(spark, sf, "transcript_gate_gold"))


# ---- transcripts, screens, packing --------------------------------------------------------------


@query()
def transcript_spans(spark, sf):
    return spans.transcript_spans(table(spark, sf, "documents"))


@query()
def eligible_spans(spark, sf):
    return spans.eligible_spans(spans.transcript_spans(table(spark, sf, "documents"))).select("doc_id", "span_id", "start", "stop")


@query()
def span_report(spark, sf):
    return spans.span_report(spans.transcript_spans(table(spark, sf, "documents")))


def _sql_match(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_lit(p)})" for p in patterns) + ")"


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _normal_sql() -> str:
    """Compatibility forms of plain characters, by rule from the Unicode data: single ones translated, longer ones replaced."""
    from unicodedata import normalize

    src, dst, out = "", "", "{0}"
    for c in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800))):
        to = normalize("NFKC", c)
        if to != c and to.isascii():
            if len(to) == 1:
                src, dst = src + c, dst + to
            elif to.isalpha():
                out = f"replace({out}, '{c}', '{to}')"
    quoted = dst.replace("'", "''").replace("{", "{{").replace("}", "}}")
    return f"translate({out}, '{src}', '{quoted}')"


_NORMAL = _normal_sql()
_PLAIN = "regexp_replace(" + _NORMAL.replace("{0}", "coalesce({0}, '')") + r", '\p{{Cf}}', '', 'g')"


@query(f"SELECT doc_id, {_sql_match('x', screens.CREDENTIALS)} AS shaped FROM (SELECT doc_id, {_NORMAL.format('text')} AS x FROM documents WHERE text IS NOT NULL)")
def credential_screen(spark, sf):
    d = screens.normal(table(spark, sf, "documents").where("text is not null"), "text")
    return d.select("doc_id", screens.credential_shaped(F.col("text")).alias("shaped"))


_T = _PLAIN.format("text")


@query(f"SELECT doc_id, NOT regexp_matches(x, {_lit(screens.VISIBLE)}) OR {_sql_match('x', (screens.STRUCTURE, screens.CONTROL, screens.DISCLOSURE))} AS shaped FROM (SELECT doc_id, {_T} AS x FROM documents)")
def injection_screen(spark, sf):
    d = screens.normal(table(spark, sf, "documents"), "text")
    return d.select("doc_id", screens.instruction_shaped(F.col("text")).alias("shaped"))


_C = _PLAIN.format("content")


@query(f"""
SELECT coalesce(category, 'none') AS category, CASE WHEN {_sql_match('y', screens.CREDENTIALS)} THEN 'credential_shaped'
  WHEN NOT regexp_matches(x, {_lit(screens.VISIBLE)}) OR {_sql_match('x', (screens.STRUCTURE, screens.LEADING_CONTROL, screens.DISCLOSURE))} THEN 'instruction_shaped_content'
  WHEN {_sql_match('x', (screens.TASK,))} THEN 'task_shaped_content' ELSE 'kept' END AS reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT category, {_C} AS x, {_NORMAL.format("coalesce(content, '')")} AS y FROM facts) GROUP BY 1, 2""")
def proposal_screen(spark, sf):
    return screens.screen_report(table(spark, sf, "facts"), "content", "category")


_G = "SELECT case_id, CAST(unnest(range(0, len(facts))) AS INTEGER) AS item_no, unnest(facts) AS f FROM transcript_gate_gold"


def _reason(x: str, y: str) -> str:
    """SQL: why a proposal is not kept; ``x`` without format characters, ``y`` as it stands, both composed."""
    return f"""CASE WHEN {_sql_match(y, screens.CREDENTIALS)} THEN 'credential_shaped' WHEN NOT regexp_matches({x}, {_lit(screens.VISIBLE)}) OR {_sql_match(x, (screens.STRUCTURE, screens.LEADING_CONTROL, screens.DISCLOSURE))} THEN 'instruction_shaped_content'
  WHEN {_sql_match(x, (screens.TASK,))} THEN 'task_shaped_content' END"""


@query(f"""
WITH g AS ({_G}), n AS (SELECT case_id, item_no, f, {_PLAIN.format('f.content')} AS x, {_NORMAL.format("coalesce(f.content, '')")} AS y FROM g)
SELECT case_id, item_no, f.state.kind AS kind, coalesce({_reason('x', 'y')}, CASE WHEN f.evidence_excerpt IS NULL THEN 'no_evidence' WHEN f.evidence_role <> 'user' THEN 'not_said_by_user' END, 'kept') AS verdict FROM n""")
def gold_proposals(spark, sf):
    return screens.gold_proposals(table(spark, sf, "transcript_gate_gold"))


def _ranked(spark, sf):
    f, q = table(spark, sf, "facts"), search_queries(spark, sf)
    return ranking.lexical_first(f, q, SCOPES, NOW, limit=48)


@query(f"""
WITH {_LEXICAL}, u AS (SELECT query_id, fact_id, rank, sum(CAST(floor((length(coalesce(content, '')) + 3) / 4.0) AS BIGINT)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM y JOIN facts USING (fact_id) WHERE rank <= 48)
SELECT query_id, fact_id, CAST(rank AS INTEGER) AS rank, CAST(used AS BIGINT) AS used FROM u WHERE used <= 300""")
def budget_prefix(spark, sf):
    return context.budget_prefix(_ranked(spark, sf), 300).select("query_id", "fact_id", "rank", "used")


@query()
def mmr_select(spark, sf):
    """Diverse facts of each query, by vectors where a ranking has all of them, else by shared tokens."""
    return context.mmr(_ranked(spark, sf).join(_vectors(spark, sf).select("fact_id", "embedding"), "fact_id", "left"), 8)


# ---- claims, cases, gates -----------------------------------------------------------------------


def claims_sql(where: str) -> str:
    """CTEs ``c``: each claim's tokens, values, states, stems, residue and frame, from the definitions of their words."""
    from ..functions.text import NEGATIONS, STATE_GROUPS, STEM_SUFFIXES
    from ..operators.contradictions import FRAMES, RESIDUE_NEGATIONS

    states = _words_sql([w for g in STATE_GROUPS for w in g])
    fits = "ends_with({t}, '{x}') AND length({t}) > {n}"
    stems = ", ".join(f"list_transform(list_filter(base, lambda t: {fits.format(t='t', x=x, n=len(x) + 2)}), lambda t: substr(t, 1, length(t) - {len(x)}))" for x in STEM_SUFFIXES)
    collapse = " ".join(f"WHEN {fits.format(t='t', x=x, n=len(x) + 2)} AND list_contains(subj, substr(t, 1, length(t) - {len(x)})) THEN substr(t, 1, length(t) - {len(x)})" for x in STEM_SUFFIXES)
    return f"""c0 AS (SELECT fact_id, scope, subject_key, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+') AS tok FROM facts WHERE {ACTIVE} AND content IS NOT NULL AND {where}),
c1 AS (SELECT *, list_filter(tok, lambda t: regexp_matches(t, '[0-9]')) AS val, list_distinct(list_filter(tok, lambda t: t NOT IN {_words_sql(STOPWORDS)})) AS words, len(list_filter(tok, lambda t: t IN {_words_sql(NEGATIONS)})) > 0 AS neg,
  len(list_filter(tok, lambda t: t IN {_words_sql(FRAMES)})) > 0 AS framed FROM c0),
c2 AS (SELECT *, list_filter(words, lambda t: t IN {states}) AS states, list_filter(words, lambda t: t NOT IN {states}) AS base FROM c1),
c3 AS (SELECT *, list_distinct(list_concat(base, {stems})) AS subj, list_sort(list_filter(words, lambda t: t NOT IN {states} AND NOT list_contains(val, t))) AS frame FROM c2),
c AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(subj, lambda t: t NOT IN {_words_sql(RESIDUE_NEGATIONS)}), lambda t: CASE {collapse} ELSE t END))) AS residue FROM c3)"""


def _polarity_sql() -> str:
    from ..functions.text import STATE_GROUPS

    part = "list_sort(list_filter({0}.states, lambda t: t IN {1}))"
    tests = [f"(len({part.format('a', _words_sql(g))}) > 0 AND len({part.format('b', _words_sql(g))}) > 0 AND {part.format('a', _words_sql(g))} <> {part.format('b', _words_sql(g))})" for g in STATE_GROUPS]
    return f"(list_has_any(a.subj, b.subj) AND ({' OR '.join(tests)} OR a.neg <> b.neg))"


_UPDATE = f"(CASE WHEN a.val = b.val OR len(a.val) = 0 OR len(b.val) = 0 THEN {_polarity_sql()} ELSE a.frame = b.frame END)"


def _contradiction_sql() -> str:
    from ..operators.contradictions import COPULAS, FRAMES, PREFIX

    frames, verbs = _words_sql(FRAMES), _words_sql([w for w in FRAMES if w not in COPULAS])
    return f"""
WITH {claims_sql("(memory_kind IS NULL OR memory_kind <> 'state')")},
p AS (SELECT a.fact_id AS newer, b.fact_id AS older, a.tok AS x, b.tok AS y, {_polarity_sql()} AS turned, len(a.residue) > 0 AND a.residue = b.residue AS same, a.framed AND b.framed AS framed, {_UPDATE} AS updated, list_has_any(a.subj, b.subj) AS about,
  coalesce(list_filter(range(1, least(len(a.tok), len(b.tok)) + 1), lambda i: a.tok[i] <> b.tok[i])[1] - 1, least(len(a.tok), len(b.tok))) AS n FROM c a JOIN c b ON a.scope = b.scope AND a.fact_id > b.fact_id),
r AS (SELECT *, list_slice(x, n + 1, len(x)) AS rx, list_slice(y, n + 1, len(y)) AS ry FROM p)
SELECT newer, older FROM r WHERE CASE WHEN turned THEN same ELSE framed AND (updated OR (n >= {PREFIX} AND len(rx) > 0 AND len(ry) > 0 AND NOT list_has_any(rx, ry) AND len(list_filter(list_concat(rx, ry), lambda t: t IN {frames})) = 0
  AND (n >= 3 OR len(list_filter(list_slice(x, 1, n), lambda t: t IN {verbs})) > 0 OR len(list_filter(list_concat(rx, ry), lambda t: NOT regexp_matches(t, '[0-9]'))) = 0) AND about)) END"""


@query(_contradiction_sql())
def contradiction_pairs(spark, sf):
    from ..operators.contradictions import contradiction_pairs as pairs

    return pairs(table(spark, sf, "facts"))


_WORDS = "regexp_extract_all(lower(content), '[a-z0-9]+')"


def _restatement_sql() -> str:
    from ..functions.text import NEGATIONS, STOPWORDS

    return f"""
WITH r AS (SELECT fact_id, scope, list_sort(list_distinct(list_filter(t, lambda x: x NOT IN {_words_sql(STOPWORDS)}))) AS c, list_filter(t, lambda x: regexp_matches(x, '[0-9]')) AS v,
  len(list_filter(t, lambda x: x IN {_words_sql(NEGATIONS)})) > 0 AS neg, list_distinct(t) AS s FROM (SELECT fact_id, scope, {_WORDS} AS t FROM facts WHERE {ACTIVE} AND content IS NOT NULL))
SELECT a.fact_id AS newer, min(b.fact_id) AS older FROM r a JOIN r b ON a.scope = b.scope AND a.c = b.c AND a.v = b.v AND a.neg = b.neg AND a.fact_id > b.fact_id
WHERE len(a.s) > 0 AND CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) >= 0.8 GROUP BY 1"""


@query(_restatement_sql())
def restatement_pairs(spark, sf):
    from ..operators.contradictions import restatements

    return restatements(table(spark, sf, "facts"))


@query("SELECT concat('fact-', fact_id) AS id, content AS query, fact_id AS gold_fact_id, 'exact_fact' AS case_type FROM facts WHERE content IS NOT NULL AND content <> ''")
def exact_cases(spark, sf):
    from ..sources.arenas import exact_cases as cases

    return cases(table(spark, sf, "facts"))


@query()
def paraphrase_cases(spark, sf):
    from ..sources.arenas import paraphrase_cases as cases

    return cases(table(spark, sf, "facts"))


@query("SELECT CAST(count(*) AS BIGINT) AS cases, CAST(count(*) AS BIGINT) AS self_referential FROM facts WHERE content IS NOT NULL AND content <> ''")
def self_referential(spark, sf):
    from ..sources import arenas

    f = table(spark, sf, "facts")
    return arenas.self_referential(arenas.exact_cases(f), f)


@query()
def arena_matching(spark, sf):
    """Gold facts of each case matched to the case's excerpts by token overlap: a maximum matching and its scores."""
    from ..functions.text import jaccard, token_set
    from ..operators.matching import matched_counts

    f = table(spark, sf, "transcript_gate_gold").select("case_id", F.posexplode("facts").alias("i", "f"))
    e = f.select("case_id", F.col("i").alias("left"), token_set(F.col("f.content")).alias("t"))
    p = f.where("f.evidence_excerpt is not null").select("case_id", F.col("i").alias("right"), token_set(F.col("f.evidence_excerpt")).alias("u"))
    edges = e.join(p, "case_id").where(jaccard(F.col("t"), F.col("u")) >= 0.2).select("case_id", "left", "right")
    return matched_counts(e, p, edges)


@query(f"WITH {_LEXICAL}, n AS (SELECT query_id, score, rank, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS nxt FROM y) SELECT query_id, score AS top, round(score - coalesce(nxt, 0.0), 6) AS margin FROM n WHERE rank = 1")
def result_margins(spark, sf):
    from ..operators.gates import margins

    return margins(_ranked(spark, sf))


@query(f"""
WITH {_RESULTS}, m AS (SELECT
  count(*) FILTER (WHERE NOT abstain) AS n1, avg(CASE WHEN gr IS NOT NULL AND NOT list_has_any(list_slice(ranked, 1, 3), stale) THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT abstain) AS v1,
  count(*) FILTER (WHERE abstain) AS n2, avg(CASE WHEN len(ranked) = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE abstain) AS v2,
  count(*) FILTER (WHERE NOT abstain AND len(stale) > 0) AS n3, avg(CASE WHEN list_has_any(list_slice(ranked, 1, 3), stale) THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT abstain AND len(stale) > 0) AS v3 FROM e)
SELECT 'temporal' AS metric, CASE WHEN n1 = 0 THEN 'blocked' ELSE 'measured' END AS status, round(v1, 6) AS value FROM m
UNION ALL SELECT 'abstention', CASE WHEN n2 = 0 THEN 'blocked' ELSE 'measured' END, round(v2, 6) FROM m
UNION ALL SELECT 'stale_exposed', CASE WHEN n3 = 0 THEN 'blocked' ELSE 'measured' END, round(v3, 6) FROM m""")
def truth_scorecard(spark, sf):
    from ..operators.gates import truth_scorecard as card

    return card(results(spark, sf))


_COVERED = ("valid_from", "valid_to", "subject_key", "predicate_key", "object_value", "memory_kind", "confidence", "source_authority")


@query("SELECT CAST(count(*) AS BIGINT) AS facts, " + ", ".join(f"round(coalesce(count({c}) / nullif(CAST(count(*) AS DOUBLE), 0), 0.0), 6) AS {c}" for c in _COVERED) + " FROM facts")
def coverage_ratios(spark, sf):
    from ..operators.gates import coverage_ratios as ratios

    return ratios(table(spark, sf, "facts"))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value AS p FROM r WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)""")
def index_percentile(spark, sf):
    from ..operators.gates import index_percentile as p

    return p(table(spark, sf, "events"), "value", "event_type")


@query("""
SELECT DISTINCT fact_id, content FROM (
  (SELECT fact_id, content FROM facts ORDER BY trust_score DESC NULLS LAST, fact_id DESC LIMIT 25) UNION ALL (SELECT fact_id, content FROM facts ORDER BY fact_id DESC LIMIT 15))""")
def existing_summary(spark, sf):
    from ..operators.gates import summary_facts

    return summary_facts(table(spark, sf, "facts"))


@query()
def table_fingerprints(spark, sf):
    from ..operators.gates import fingerprint

    names = ("entities", "facts", "fact_provenance", "memory_sessions", "observations")
    parts = [fingerprint(table(spark, sf, n)).withColumn("name", F.lit(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
SELECT client_id, session_id, observation_id, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN first_value(content_sha256) OVER w = content_sha256 THEN 'replay' ELSE 'clash' END AS outcome
FROM observations WINDOW w AS (PARTITION BY client_id, session_id ORDER BY observation_id)""")
def write_idempotency(spark, sf):
    """The envelope's outcome where a client's session is taken as its idempotency key."""
    from ..operators.extraction import idempotent

    o = table(spark, sf, "observations").select("client_id", "session_id", "observation_id", "content_sha256")
    return idempotent(o, "client_id", "session_id", "content_sha256", "observation_id").select("client_id", "session_id", "observation_id", "outcome")


@query(f"""
WITH k AS (SELECT fact_id, memory_kind, object_value, confidence, regexp_replace(lower(trim(subject_key)), '\\s+', '_', 'g') AS s, regexp_replace(lower(trim(predicate_key)), '[\\s-]+', '_', 'g') AS p, {_C} AS x, {_NORMAL.format("coalesce(content, '')")} AS y FROM facts)
SELECT fact_id, coalesce(memory_kind IN ('state', 'preference', 'commitment', 'event') AND regexp_matches(s, '^[a-z0-9][a-z0-9._:/-]{{0,127}}$') AND regexp_matches(p, '^[a-z0-9][a-z0-9._-]{{0,63}}$') AND object_value IS NOT NULL AND coalesce(confidence, 0.0) >= 0.8, FALSE) AS typed,
  coalesce({_reason('x', 'y')}, 'kept') AS verdict FROM k""")
def typed_proposals(spark, sf):
    from ..operators.extraction import proposals

    return proposals(screens.normal(table(spark, sf, "facts"), "content"))


def _review_sql() -> str:
    words = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda x: x NOT IN " + _words_sql(STOPWORDS) + "))"
    shaped = lambda c: f"(NOT regexp_matches(regexp_replace(coalesce({c}, ''), '\\p{{Cf}}', '', 'g'), {_lit(screens.VISIBLE)}) OR {_sql_match(f'regexp_replace(coalesce({c}, {chr(39) * 2}), {_lit(screens.FORMAT_CHARS)}, {chr(39) * 2}, {_lit(chr(103))})', (screens.STRUCTURE, screens.CONTROL, screens.DISCLOSURE))})"
    return f"""
WITH g AS ({_G}), w AS (SELECT case_id, item_no, f.content AS c, coalesce(f.evidence_excerpt, '') AS e, {words.format('f.content')} AS cw, {words.format('f.evidence_excerpt')} AS ew FROM g)
SELECT case_id, item_no, trim(e) = '' OR length(e) > 2000 OR len(cw) = 0 OR {shaped('e')} OR {shaped('c')} OR NOT list_has_any(cw, ew) AS must_review FROM w"""


@query(_review_sql())
def evidence_review(spark, sf):
    """Gold facts whose excerpt cannot carry the claim."""
    from ..operators.extraction import must_review

    f = table(spark, sf, "transcript_gate_gold").select("case_id", F.posexplode("facts").alias("item_no", "f"))
    return f.select("case_id", "item_no", must_review(F.col("f.content"), F.col("f.evidence_excerpt")).alias("must_review"))


@query()
def hash_embeddings(spark, sf):
    """Deterministic feature-hash vectors of every fact."""
    return dense.hash_embedding(table(spark, sf, "facts"))


# ---- around the ranked list ---------------------------------------------------------------------

@query(f"""
WITH {_OPENING}, need AS (SELECT query_id, count(*) AS need FROM qt GROUP BY 1), p AS (SELECT fact_id, unnest(list_distinct({_TOK})) AS token FROM facts WHERE {_KNOWN}),
h AS (SELECT query_id, fact_id FROM qt JOIN p USING (token) JOIN need USING (query_id) GROUP BY query_id, fact_id, need HAVING count(*) = need),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(trust_score, 0) DESC, fact_id) AS rank FROM h JOIN facts USING (fact_id)) SELECT query_id, fact_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def asof_search(spark, sf):
    """Facts as they were known at an instant that hold every token of the query."""
    f = table(spark, sf, "facts")
    return firsts.holding_all(f, opening_queries(spark, sf), eligibility.as_of(known_at=AT_KNOWN), 10)


@query(f"""
WITH {_Q}, s AS (SELECT query_id, token, count(*) OVER (PARTITION BY query_id) AS n FROM qt WHERE token NOT IN {_words_sql(STOPWORDS)}),
d AS (SELECT fact_id, unnest(list_distinct({_WORDS})) AS token FROM facts WHERE content IS NOT NULL),
g AS (SELECT query_id, fact_id, round(CAST(count(*) AS DOUBLE) / any_value(n), 6) AS score FROM s JOIN d USING (token) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM g)
SELECT query_id, fact_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def lexical_baseline(spark, sf):
    return expansion.baseline(table(spark, sf, "facts"), search_queries(spark, sf))


@query(f"""
WITH {_Q}, u AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS t FROM q),
c AS (SELECT DISTINCT conflict_group, unnest(regexp_extract_all(lower(concat_ws(' ', subject_key, predicate_key, object_value)), '[\\p{{L}}\\p{{N}}]+')) AS t FROM facts WHERE conflict_group IS NOT NULL)
SELECT query_id, conflict_group FROM u JOIN c USING (t) GROUP BY 1, 2 HAVING count(*) >= 2 OR max(length(t)) >= 6""")
def relevant_receipts(spark, sf):
    return expansion.relevant_receipts(table(spark, sf, "facts"), search_queries(spark, sf))


@query(f"WITH {_BM25}, {_TOP} SELECT fact_id, CAST(count(*) AS BIGINT) AS returned FROM t WHERE rank <= 10 GROUP BY 1")
def retrieval_increments(spark, sf):
    return expansion.increments(_bm25_top(spark, sf))


@query(f"""
SELECT object_entity_id AS entity_id, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY fact_id) AS fact_ids FROM facts
WHERE {ACTIVE} AND object_entity_id IS NOT NULL AND memory_kind IS DISTINCT FROM 'insight' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25""")
def reflection_clusters(spark, sf):
    return expansion.entity_clusters(table(spark, sf, "facts"))


@query()
def entity_expansion_rank(spark, sf):
    return expansion.entity_expansion(_ranked(spark, sf), table(spark, sf, "facts"), table(spark, sf, "entities"))


@query("""
SELECT fact_id, CASE WHEN CAST('0x' || substr(sha256(concat('0:', fact_id)), 1, 8) AS BIGINT) / 4294967296.0 < 0.7 THEN 'tune' ELSE 'holdout' END AS split FROM facts""")
def tune_holdout(spark, sf):
    return expansion.tune_holdout(table(spark, sf, "facts").select("fact_id"), "fact_id")


VALUE_UPDATES = f"""WITH {claims_sql("(memory_kind IS NULL OR memory_kind <> 'state') AND subject_key IS NOT NULL")},
vu AS (SELECT a.fact_id AS newer, b.fact_id AS older FROM c a JOIN c b ON a.scope = b.scope AND a.subject_key = b.subject_key AND a.fact_id > b.fact_id WHERE {_UPDATE})"""


@query(VALUE_UPDATES + """, m AS (SELECT older AS fact_id, max(newer) AS superseded_by FROM vu GROUP BY 1)
SELECT m.fact_id, m.superseded_by, '2026-01-01T00:00:00Z' AS invalid_at, coalesce(o.valid_to, n.valid_from) AS valid_to FROM m JOIN facts o ON o.fact_id = m.fact_id JOIN facts n ON n.fact_id = m.superseded_by
WHERE o.superseded_by IS NULL AND o.conflict_group IS NULL AND (o.memory_kind IS NULL OR o.memory_kind <> 'state')""")
def supersede_plan(spark, sf):
    from ..operators.contradictions import value_update_pairs

    f = table(spark, sf, "facts")
    return expansion.supersede_plan(f, value_update_pairs(f.where("memory_kind is null or memory_kind != 'state'")), "2026-01-01T00:00:00Z")


@query(VALUE_UPDATES + " SELECT newer, older FROM vu")
def value_updates(spark, sf):
    """Untyped facts that give another one's subject a new value or the opposite polarity."""
    from ..operators.contradictions import value_update_pairs

    return value_update_pairs(table(spark, sf, "facts").where("memory_kind is null or memory_kind != 'state'"))


@query("SELECT conflict_group, CAST(count(*) AS BIGINT) AS members, max(fact_id) AS newest FROM facts WHERE conflict_group IS NOT NULL GROUP BY 1")
def open_conflicts(spark, sf):
    f = table(spark, sf, "facts").where("conflict_group is not null")
    return f.groupBy("conflict_group").agg(F.count(F.lit(1)).alias("members"), F.max("fact_id").alias("newest"))
