"""Lexical rankings without a table of all pairs: equal to the ranking of the whole table, at any chunk."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import best, firsts, lexical, ranking
from factloom.plans import retrieval

TEXTS = ["deploy port of atlas is 80", "the port of atlas is 81", "port of zephyr", "port port deploy", "the the of is", "an oak door", "atlas hall in march 2024", None, "atlas"]
COLUMNS = {"memory_kind": "state", "correction_status": None, "scope": "work", "sensitivity": "normal", "subject_key": "s", "predicate_key": "p", "object_value": "o", "valid_from": None, "valid_to": None, "invalid_at": None, "expired_at": None, "superseded_by": None, "updated_at": "2025-01-01T00:00:00Z", "created_at": "2025-01-01T00:00:00Z", "conflict_group": None, "category": None}
QUERIES = ["deploy port atlas", "port", "atlas port deploy", "of the", "nothing known", "", "Atlas port"]


@pytest.fixture
def facts(spark):
    rows = [(i + 1, None if (t := TEXTS[i % len(TEXTS)]) is None else t + " x" * (i % 4), "ops, port" if i % 5 == 0 else None, (i % 7) / 10 + 0.25) for i in range(600)]
    df = spark.createDataFrame(rows, "fact_id long, content string, tags string, trust_score double")
    return df.withColumns({c: F.lit(v).cast("long" if c == "superseded_by" else "string") for c, v in COLUMNS.items()})


def rows(df):
    return sorted((r["query_id"], r["rank"], r["fact_id"], r["lexical_rank"], r["fused"], r["score"], round(r["fts"], 9), round(r["jaccard"], 9)) for r in df.collect())


@pytest.mark.parametrize("chunk,kept", [(1 << 17, 200_000_000), (50, 1000)])
def test_lexical_first_equals_full_table(spark, facts, monkeypatch, chunk, kept):
    monkeypatch.setattr(firsts, "CHUNK", chunk)
    monkeypatch.setattr(firsts, "KEPT", kept)
    monkeypatch.setattr(firsts, "TOGETHER", 2)
    monkeypatch.setattr(best, "BLOCK", 3)
    q = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    for limit in (3, 48):
        want = ranking.fuse(ranking.candidates(facts, q, ["work"]), facts, q, 1767225600, ranking.LEXICAL, None, limit)
        assert rows(ranking.lexical_first(facts, q, ["work"], 1767225600, limit=limit)) == rows(want)


def test_more_candidates_than_the_window(spark, facts, monkeypatch):
    """The twin in SQL ranks every candidate: a share of the tokens may lift one from behind any place of the index."""
    monkeypatch.setattr(ranking, "WINDOW", 5)
    q = spark.createDataFrame([(0, "deploy port atlas")], "query_id long, query string")
    want = ranking.fuse(ranking.candidates(facts, q, ["work"]), facts, q, 1767225600, ranking.LEXICAL, None, 10, 10_000)
    assert rows(ranking.lexical_first(facts, q, ["work"], 1767225600)) == rows(want)


def test_places_of_wanted_facts(spark, facts):
    """Facts that are asked for bring their place in the whole list."""
    from factloom.runtime import Cut

    q = spark.createDataFrame([(0, "deploy port atlas")], "query_id long, query string")
    asked = firsts.classes(q, Cut(spark, "test"))
    every = {r["fact_id"]: r["lexical_rank"] for r in firsts.first(facts, asked, F.lit(True), 10_000, 0.35, 0.25, 0.75).collect()}
    far = [f for f, n in every.items() if n > 100][:5]
    extra = spark.createDataFrame([(0, f) for f in far], "rep long, fact_id long")
    got = {r["fact_id"]: r["lexical_rank"] for r in firsts.first(facts, asked, F.lit(True), 3, 0.35, 0.25, 0.75, extra).collect()}
    assert got == {f: n for f, n in every.items() if n <= 3 or f in far}


def no_pairs(monkeypatch):
    def scored(*_):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(lexical, "scored", scored)
    monkeypatch.setattr(ranking, "scored", scored)


def test_explain_rows_without_pairs(spark, small, monkeypatch):
    no_pairs(monkeypatch)
    assert retrieval.explain_rows(spark, small).count() > 0


@pytest.mark.parametrize("chunk,block", [(1 << 17, 20_000), (70, 2)])
def test_facts_that_hold_all_tokens(spark, facts, monkeypatch, chunk, block):
    monkeypatch.setattr(firsts, "CHUNK", chunk)
    monkeypatch.setattr(firsts, "BLOCK", block)
    f = facts.withColumn("trust_score", F.when(F.col("fact_id") % 11 != 0, F.col("trust_score")))
    q = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    keep = F.col("fact_id") % 4 != 0
    want = lexical.most_trusted(lexical.all_tokens(f, q, keep), f, 10)
    got = firsts.holding_all(f, q, keep, 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert firsts.holding_all(f, q.where("false"), keep, 10).count() == 0


def test_fts_and_search_without_pairs(spark, small, monkeypatch):
    def all_tokens(*_):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(lexical, "all_tokens", all_tokens)
    assert retrieval.fts_and_search(spark, small).count() > 0


def test_asof_search_without_pairs(spark, small, monkeypatch):
    def all_tokens(*_):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(lexical, "all_tokens", all_tokens)
    assert retrieval.asof_search(spark, small).count() > 0


def test_mmr_without_pairs(spark, small, monkeypatch):
    no_pairs(monkeypatch)
    assert retrieval.mmr_select(spark, small).count() > 0


def test_entity_expansion_without_pairs(spark, small, monkeypatch):
    no_pairs(monkeypatch)
    assert retrieval.entity_expansion_rank(spark, small).count() > 0


def test_context_pack_without_pairs(spark, small, monkeypatch):
    """One prompt a query, packed once for queries of one text."""
    from factloom.plans import writing

    no_pairs(monkeypatch)
    packed = []
    monkeypatch.setattr(writing.prompts, "packed", lambda ranked, *a, plain=writing.prompts.packed: packed.append(ranked.select("query_id").distinct()) or plain(ranked, *a))
    q = retrieval.search_queries(spark, small)
    twice = q.unionByName(q.withColumn("query_id", F.col("query_id") + 1_000_000))
    monkeypatch.setattr(retrieval, "search_queries", lambda *_: twice)
    got = {r["query_id"]: r["context"] for r in writing.context_pack(spark, small).collect()}
    assert got and all(got[n] == got[n + 1_000_000] for n in got if n < 1_000_000) and len(got) == twice.count()
    assert packed[0].count() < len(got)


def test_budget_prefix_without_pairs(spark, small, monkeypatch):
    no_pairs(monkeypatch)
    assert retrieval.budget_prefix(spark, small).count() > 0


def test_result_margins_without_pairs(spark, small, monkeypatch):
    no_pairs(monkeypatch)
    assert retrieval.result_margins(spark, small).count() > 0


@pytest.mark.parametrize("often", [1.0])
def test_frequent_tokens_are_added_up_once(spark, facts, monkeypatch, often):
    """Whatever counts as frequent, and however queries that share such tokens follow each other, the ranking is that of the whole table."""
    monkeypatch.setattr(firsts, "OFTEN", often)
    monkeypatch.setattr(firsts, "CHUNK", 150)
    monkeypatch.setattr(firsts, "TOGETHER", 3)
    q = spark.createDataFrame(list(enumerate([*QUERIES, "port oak", "port zephyr oak", "the port of hall", "the port"])), "query_id long, query string")
    want = ranking.fuse(ranking.candidates(facts, q, ["work"]), facts, q, 1767225600, ranking.LEXICAL, None, 5)
    assert rows(ranking.lexical_first(facts, q, ["work"], 1767225600, limit=5)) == rows(want)
