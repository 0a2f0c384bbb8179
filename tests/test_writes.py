"""The write path, slot keys, scopes, merges and near vectors on tiny tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import dedup, keys, vector_join, writes
from factloom.sources.schemas import DDL

NAMES = [c.split()[0] for c in DDL["facts"].split(", ")]


def facts(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in rows], DDL["facts"])


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_policy(spark):
    cols = "client_id string, scope string, sensitivity string, relation string, source_type string, correction_status string, content string"
    rows = [
        ("a", "secret", "normal", "supports", "chat", None, "x"), ("b", "work", "sensitive", "supports", "chat", None, "x"), ("a", "work", "sensitive", "supports", "chat", None, "x"),
        ("b", "work", None, "corrects", "chat", None, "x"), ("a", "work", None, None, None, "human_confirmed", "x"), ("b", None, None, None, None, None, "password = hunter2hunter2"), (None, "work", None, "supports", "human_correction", None, None),
    ]
    got = [r["outcome"] for r in writes.evaluated(spark.createDataFrame(rows, cols), ["a"], ["a"]).collect()]
    assert got == ["rejected", "rejected", None, "needs_review", None, "rejected", "needs_review"]
    assert writes.evaluated(spark.createDataFrame(rows[:3], cols), [], []).where("outcome = 'rejected'").count() == 3


def test_batches_and_reviews(spark):
    d = spark.createDataFrame([(1, "p", "rejected", "r", "c"), (2, "p", None, None, "c"), (3, "q", "needs_review", "r", "c"), (4, None, None, None, None)], "i int, b string, outcome string, reason string, content string")
    assert {r["i"]: r["committed"] for r in writes.batches(d, "b").collect()} == {1: False, 2: False, 3: True, 4: True}
    r = writes.review_rows(d.withColumn("scope", F.lit("s")), "t", "i")
    assert r.count() == 1 and writes.review_page(r, "s").count() == 1 and writes.review_page(r, "s", 1, 1).count() == 0
    with pytest.raises(ValueError):
        writes.review_page(r, "s", 0)


def test_inserted_facts_are_checked_and_numbered(spark):
    f = facts(spark, {"fact_id": 7, "content": "old"})
    rows = spark.createDataFrame([(i, f"n{i}", "work", 0.5) for i in range(40)], "k int, content string, scope string, trust_score double")
    got = {r["fact_id"]: r["content"] for r in writes.inserted(f, rows, "k", "now").collect()}
    assert got == {7: "old", **{8 + i: f"n{i}" for i in range(40)}}
    for bad in (("x", "work", 1.5), (" ", "work", 0.5), ("x", "nowhere", 0.5)):
        with pytest.raises(Exception):
            writes.inserted(f, spark.createDataFrame([(1, *bad)], "k int, content string, scope string, trust_score double"), "k", "now").collect()


def test_supersession_protects(spark):
    f = facts(spark, {"fact_id": 1, "scope": "work", "source_authority": 0.9}, {"fact_id": 2, "scope": "work", "correction_status": "human_confirmed"}, {"fact_id": 3, "scope": "work", "memory_kind": "state"}, {"fact_id": 4, "scope": "work"})
    cols = "scope string, source_type string, relation string, correction_status string, source_authority double, supersede_fact_id long"
    r = spark.createDataFrame([("work", None, None, None, 0.5, i) for i in (1, 2, 3, 4, 9)] + [("work", "human_correction", None, None, 0.5, 2)], cols)
    got = [(x["supersede_fact_id"], (x["reason"] or "").split(" ")[-1]) for x in writes.superseding(r, f).collect()]
    assert sorted(got) == [(1, "authority"), (2, ""), (2, "correction"), (3, "supersession"), (4, ""), (9, "unavailable")]


def test_near_merge_and_untyped_conflict(spark):
    f = facts(
        spark, {"fact_id": 1, "content": "the cache is enabled", "trust_score": 0.5, "created_at": "a"}, {"fact_id": 2, "content": "the cache is disabled", "trust_score": 0.9, "created_at": "b"},
        {"fact_id": 3, "content": "x", "trust_score": 0.1, "memory_kind": "state"}, {"fact_id": 4, "content": "x", "trust_score": 0.9},
    )
    pairs = spark.createDataFrame([(2, 1), (4, 3)], "newer long, older long")
    m = {r["newer"]: (r["winner"], r["loser"]) for r in writes.near_merged(pairs, f).collect()}
    assert m == {2: (2, 1), 4: (3, 4)}  # typed state never loses implicitly
    s = {r["fact_id"]: r["superseded_by"] for r in writes.superseded(f, writes.near_merged(pairs, f).select("loser", "winner"), "t").collect()}
    assert s == {1: 2, 2: None, 3: None, 4: 3}
    c = writes.untyped_conflicts(pairs.where("newer = 2"), f)
    assert [(r["subject_key"], r["predicate_key"]) for r in c.collect()] == [("untyped", "claim")] or c.first()["subject_key"] == "cache"
    g = {r["fact_id"]: r["conflict_group"] for r in writes.with_conflicts(f, c).collect()}
    assert g[1] == g[2] is not None and g[3] is None
    assert writes.member_problem(spark.createDataFrame([("k", 3)], "conflict_id string, fact_id long"), f, spark.createDataFrame([], "conflict_id string, scope string")).first()["problem"].startswith("conflict does not exist")


def test_resolution_needs_authority(spark):
    f = facts(spark, {"fact_id": 1, "conflict_group": "g", "valid_from": "2025-01-01"}, {"fact_id": 2, "conflict_group": "g", "valid_from": "2025-02-01"})
    choice = spark.createDataFrame([("g", 2, "me")], "conflict_group string, winner long, client_id string")
    got = {r["fact_id"]: (r["conflict_group"], r["superseded_by"], r["valid_to"]) for r in writes.resolved(f, choice, ["me"], "t").collect()}
    assert got == {1: ("g", 2, "2025-02-01"), 2: (None, None, None)}
    with pytest.raises(Exception):
        writes.resolved(f, choice, ["you"], "t").collect()


def test_keys_and_scopes(spark):
    p = lambda t: one(spark, keys.plural(F.col("t")), t=t)
    assert [p(x) for x in ("port", "box", "city", "key", "on_call_boss")] == ["ports", "boxes", "cities", "keys", "on_call_bosses"]
    s = lambda t: one(spark, keys.extracted_subject_key(F.col("t")), t=t)
    assert s("Courses : CS-1010_ab") == "course:cs1010" and s("people: Ann") == "people:ann" and s("services:x_") == "service:x" and s("plain key") == "plain_key" and s("!") is None
    assert keys.requested_scopes(None, ["a"]) == ["a"] and keys.requested_scopes("run:x", ["private"]) == ["run:x"]
    with pytest.raises(PermissionError):
        keys.requested_scopes("work", ["private"])
    for bad in (F.col("s"),):
        with pytest.raises(Exception):
            spark.createDataFrame([("nowhere",)], "s string").select(keys.checked_scope(bad)).collect()
    with pytest.raises(Exception):
        spark.createDataFrame([(["a"], ["b"])], "r array<string>, g array<string>").select(keys.granted_scopes(F.col("r"), F.col("g"))).collect()
    with pytest.raises(Exception):
        keys.canonical_slots(facts(spark, {"fact_id": 1, "subject_key": "!!", "predicate_key": "p"})).collect()


def test_insert_report(spark):
    p = spark.createDataFrame([(1, " "), (2, "password = hunter2hunter2"), (3, "TODO buy"), (4, "known"), (5, "new"), (6, "new"), (7, "update me")], "proposal_id long, content string").withColumns({"category": F.lit("g"), "tags": F.lit("")})
    u = spark.createDataFrame([(7,)], "proposal_id long")
    got = {r["proposal_id"]: r["skipped"] for r in writes.insert_report(p, facts(spark, {"fact_id": 1, "content": "known"}), u).collect()}
    assert got == {1: "empty", 2: "credential_shaped", 3: "task_shaped_content", 4: "duplicate", 5: None, 6: "duplicate", 7: "refused_update"}


@pytest.mark.parametrize("chunk,share", [(4096, 500), (16, 20)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, chunk, share):
    monkeypatch.setattr(vector_join, "CHUNK", chunk)
    monkeypatch.setattr(vector_join, "ROWS_A_PIVOT", share)
    rng = np.random.default_rng(0)
    c = rng.normal(size=(40, 16))
    x = (c[rng.integers(0, 40, 500)] + 0.25 * rng.normal(size=(500, 16))).astype(np.float32)
    x[7], x[8] = x[9], 0
    g = rng.integers(0, 3, 500)
    df = spark.createDataFrame([(i, [float(a) for a in v], int(k)) for i, (v, k) in enumerate(zip(x, g, strict=True))] + [(900, [1.0, 2.0], 0), (901, [2.0, 4.0], 0)], "id long, embedding array<float>, k int")
    u = x.astype(np.float64)
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-30)
    s = np.round(u @ u.T, 6)
    want = {(i, j) for i in range(500) for j in range(i + 1, 500) if g[i] == g[j] and s[i, j] >= 0.8} | {(900, 901)}
    got = [(r["a"], r["b"]) for r in vector_join.near(df, ["k"], 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert vector_join.near(df.where("false"), ["k"], 0.8).count() == 0


def test_merge(spark):
    f = facts(
        spark, {"fact_id": 1, "content": "a note", "trust_score": 0.5, "retrieval_count": 4, "tags": "x, y"}, {"fact_id": 2, "content": "the note", "trust_score": 0.9, "retrieval_count": 9, "tags": "y,z"},
        {"fact_id": 3, "content": "note 7", "trust_score": 0.1}, {"fact_id": 4, "content": "i", "category": "insight", "tags": "source_facts:1,2,3", "superseded_by": None}, {"fact_id": 5, "content": "old", "superseded_by": 1}, {"fact_id": 6, "content": "superseded: x"},
    )
    m = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "cluster long, fact_id long")
    plan = dedup.merge_plan(f, m)
    r = plan.first()
    assert plan.count() == 1 and (r["survivor"], r["dropped"], r["retrieval_count"], r["tags"], r["suspicious"]) == (2, 1, 13, "x,y,z", False)  # 3 has a value of its own: the guard keeps it out
    lose = dedup.merged_ids(f, m)
    got = {x["fact_id"]: x for x in dedup.merged_facts(f, plan, lose).collect()}
    assert set(got) == {2, 3, 4, 5, 6} and got[2]["retrieval_count"] == 13 and got[4]["tags"] == "source_facts:2,3" and got[5]["superseded_by"] == 2
    assert dedup.mergeable(f).where("fact_id = 6").count() == 0
    dedup.check_merge(f, plan, 1, 1)
    for band in ((2, 9, 0.5), (0, 9, 0.1)):
        with pytest.raises(ValueError):
            dedup.check_merge(f, plan, *band)
    t = dedup.merged_references({"fact_provenance": spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "fact_id long, observation_id long"), "embedding_jobs": spark.createDataFrame([(1,), (9,)], "fact_id long")}, lose)
    assert sorted(map(tuple, t["fact_provenance"].collect())) == [(2, 5), (3, 5)] and [x["fact_id"] for x in t["embedding_jobs"].collect()] == [9]
    assert dedup.orphans(f, t).count() == 1
    v = spark.createDataFrame([("a",), ("b",)], "embedding_identity string")
    assert dedup.the_identity(v, "a") == "a" and dedup.the_identity(v.where("false")) is None
    with pytest.raises(ValueError):
        dedup.the_identity(v)
