"""Best matches without a table of all pairs: equal to the full table, at any chunk and block."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import anchors, best, lexical
from factloom.plans import retrieval, writing

TEXTS = ["the port of atlas is 80", "the port of atlas is 81", "the port of zephyr is 80", "port port port", "the the of is", "an oak door", "door of the atlas hall in march 2024", "", "atlas"]


@pytest.fixture
def facts(spark):
    rows = [(i + 1, TEXTS[i % len(TEXTS)] + (f" x{i % 7}" if i % 3 else ""), "ops, port" if i % 5 == 0 else None, "work" if i % 2 else "private") for i in range(120)]
    return spark.createDataFrame(rows, "fact_id long, content string, tags string, scope string")


def rows(df):
    return sorted((r["query_id"], r["fact_id"], round(r["bm25"], 8), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("chunk,block", [(1 << 17, 20_000), (40, 16)])
def test_top_equals_full_table(spark, facts, monkeypatch, chunk, block):
    monkeypatch.setattr(best, "CHUNK", chunk)
    monkeypatch.setattr(best, "BLOCK", block)
    q = facts.where("fact_id <= 30").select(F.col("fact_id").alias("query_id"), F.col("content").alias("query"))
    for k in (3, 30):
        assert rows(lexical.bm25_top(facts, q, F.col("fact_id") % 4 != 0, k)) == rows(lexical.top(lexical.bm25(facts, q, F.col("fact_id") % 4 != 0), "bm25", k))
    assert lexical.bm25_top(facts, q.where("false"), None, 3).count() == 0
    assert lexical.bm25_top(facts.where("false"), q, None, 3).count() == 0


def test_held_anchors_are_match_tokens(spark):
    texts = ["Atlas Hall in Sept 2024", "new york city", "Mar", "september", "", "one"]
    names = ["atlashall", "hallin", "newyorkcity", "york", "september", "sep", "sept", "march", "one", "yorknew"]
    df = spark.createDataFrame([(t, names) for t in texts], "t string, a array<string>")
    from factloom.functions.text import tokens

    for r in df.select(anchors.held_anchors(F.col("a"), tokens(F.col("t"))).alias("x"), F.array_intersect("a", anchors.match_tokens(F.col("t"))).alias("y")).collect():
        assert sorted(r["x"]) == sorted(r["y"])


def no_pairs(spark, monkeypatch):
    """The table of all pairs is not made."""
    def scored(*_):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(lexical, "scored", scored)
    monkeypatch.setattr(retrieval.ranking, "scored", scored)


def test_strict_search_without_pairs(spark, small, monkeypatch):
    no_pairs(spark, monkeypatch)
    assert writing.strict_anchor_search(spark, small).count() > 0


def test_anchor_gate_without_pairs(spark, small, monkeypatch):
    no_pairs(spark, monkeypatch)
    assert writing.anchor_gate(spark, small).count() > 0


def test_near_writes_without_pairs(spark, small, monkeypatch):
    no_pairs(spark, monkeypatch)
    assert writing.write_near_duplicates(spark, small).count() > 0


def test_first_restated_without_pairs(spark, small, monkeypatch):
    no_pairs(spark, monkeypatch)
    assert writing.first_restated(spark, small).count() > 0


def test_first_updated_without_pairs(spark, small, monkeypatch):
    no_pairs(spark, monkeypatch)
    assert writing.first_updated(spark, small).count() > 0


@pytest.mark.parametrize("part", [4, 30])
def test_what_first_facts_say_cuts_nothing(spark, facts, monkeypatch, part):
    """The least score comes from the first facts of a chunk; frequent tokens wait, and are looked up both ways."""
    monkeypatch.setattr(best, "PART", part)
    q = facts.where("fact_id <= 30").select(F.col("fact_id").alias("query_id"), F.col("content").alias("query"))
    keep = F.col("fact_id") % 4 != 0
    for size in (128_000_000, 0):
        monkeypatch.setattr(best, "DENSE", size)
        for k in (1, 3, 30):
            assert rows(lexical.bm25_top(facts, q, keep, k)) == rows(lexical.top(lexical.bm25(facts, q, keep), "bm25", k))


def test_first_restated_splits_no_text_per_pair(spark, monkeypatch):
    """The comparison reads stored tokens."""
    from factloom.operators import service

    monkeypatch.setattr(service, "semantic_duplicates", lambda pairs, *_: pairs)
    p = spark.createDataFrame([(1, 1, 10, "the port is 80", "port is the 80", None), (2, 1, 11, "the port is 80", "the port is 81", None)], "request_id long, rank int, fact_id long, a_text string, b_text string, cosine double")
    got = service.restated_first(p)
    assert [tuple(r) for r in got.collect()] == [(1, 10)]
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
