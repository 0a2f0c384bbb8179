"""The queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.history import build, current_versions, snapshot_cutoffs
from ..sources.tables import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every version of every slot with the period in which it was valid."""
    return current_versions(table(spark, sf, "facts"))


def p3_history(spark: SparkSession, sf: str) -> DataFrame:
    """All versions believed at either snapshot, with the snapshots that introduced and replaced them."""
    facts = table(spark, sf, "facts")
    return build(facts, snapshot_cutoffs(facts))


QUERIES = {f.__name__: f for f in (p3_found, p3_history)}


def _p3_sql() -> str:
    """The fold of every slot, statement by statement, as a recursion over their order."""
    from .store import at

    return f"""
WITH RECURSIVE s AS (SELECT DISTINCT fact_id, coalesce(scope, chr(0)) AS k1, subject_key AS k2, predicate_key AS k3, {at('coalesce(valid_from, created_at)')} AS t, lower(trim(regexp_replace(object_value, '\\s+', ' ', 'g'))) AS v,
    {at('valid_to')} AS until, superseded_by FROM facts WHERE fact_id IS NOT NULL AND subject_key IS NOT NULL AND predicate_key IS NOT NULL AND object_value IS NOT NULL),
u AS (SELECT * FROM s WHERE t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.fact_id = s.superseded_by AND o.fact_id <> s.fact_id AND o.k1 = s.k1 AND o.k2 = s.k2 AND o.k3 = s.k3 AND o.t = s.t)),
n AS (SELECT *, row_number() OVER (PARTITION BY k1, k2, k3 ORDER BY t, fact_id) AS i FROM u),
f(k1, k2, k3, i, v, fact_id, start, stop) AS (
  SELECT k1, k2, k3, i, v, fact_id, t, until FROM n WHERE i = 1
  UNION ALL SELECT n.k1, n.k2, n.k3, n.i, n.v, CASE WHEN n.v = f.v AND (f.stop IS NULL OR n.t < f.stop) THEN f.fact_id ELSE n.fact_id END, CASE WHEN n.v = f.v AND (f.stop IS NULL OR n.t < f.stop) THEN f.start ELSE n.t END,
    CASE WHEN n.v = f.v AND (f.stop IS NULL OR n.t < f.stop) THEN CASE WHEN f.stop IS NULL THEN n.until WHEN n.until IS NULL THEN f.stop ELSE least(f.stop, n.until) END ELSE n.until END
  FROM f JOIN n ON n.k1 = f.k1 AND n.k2 = f.k2 AND n.k3 = f.k3 AND n.i = f.i + 1),
v AS (SELECT k1, k2, k3, fact_id, start, arg_max(coalesce(stop, 9e15), i) AS stop FROM f GROUP BY ALL),
w AS (SELECT *, lead(start) OVER (PARTITION BY k1, k2, k3 ORDER BY start, stop, fact_id) AS nxt FROM v)
SELECT fact_id, strftime(make_timestamp(start * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS valid_from, CASE WHEN least(stop, coalesce(nxt, 9e15)) >= 9e15 THEN '' ELSE strftime(make_timestamp(CAST(least(stop, coalesce(nxt, 9e15)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS valid_to FROM w"""


ORACLE: dict[str, str] = {"p3_found": _p3_sql()}
