"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings facts observations fact_provenance fact_embeddings memory_sessions transcript_gate_gold entities"
).split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, small, db, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    assert len(entry.entry(spark).take(1)) == 1


def test_every_query_runs_whole(spark, small):
    """Queries without a twin give rows with the columns they name, and the same rows again."""
    for name in sorted(set(entry.catalog.QUERIES) - set(entry.oracle_sql()) - {"hash_embeddings", "p3_history"}):
        df = entry.queries()[name](spark, small)
        rows = sorted(map(repr, df.collect()))
        assert len(set(df.columns)) == len(df.columns) and rows == sorted(map(repr, entry.queries()[name](spark, small).collect())), name
        assert rows or name in ("semantic_duplicates",), name
