"""The history fold against a plain one, on random statements, with and without hot slots."""

import datetime as dt
import random
from collections import defaultdict

from factloom.operators.history import build, current_versions, moved_slots, snapshot, snapshot_cutoffs, statements
from factloom.operators.merkle import differing_leaves, leaves, levels
from factloom.sources.schemas import DDL

BASE = int(dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc).timestamp())


def text(t):
    return None if t is None else dt.datetime.fromtimestamp(t, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def make(spark, rows):
    cols = [c.split()[0] for c in DDL["facts"].split(", ")]
    full = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(full, DDL["facts"])


def random_facts(seed, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = BASE + r.randrange(40) * 3600
        out.append({
            "fact_id": i, "scope": r.choice(["work", None]), "subject_key": r.choice(["a", "b", "hot", "hot", "hot"]), "predicate_key": "p", "object_value": r.choice(["x", " X ", "y", "z"]),
            "valid_from": text(t) if r.random() < 0.8 else None, "created_at": text(t + r.randrange(5) * 3600) if r.random() < 0.9 else None,
            "valid_to": text(t + r.randrange(1, 9) * 1800) if r.random() < 0.2 else None, "superseded_by": r.randrange(n) if r.random() < 0.5 else None,
        })
    return out


def plain(rows):
    slots = defaultdict(list)
    sec = lambda s: None if s is None else int(dt.datetime.fromisoformat(s.replace("Z", "+00:00")).timestamp())
    for f in rows:
        t = sec(f["valid_from"] or f["created_at"])
        if t is not None:
            slots[f["scope"], f["subject_key"]].append((t, f["fact_id"], " ".join(f["object_value"].split()).lower(), sec(f["valid_to"]), f["superseded_by"]))
    out = set()
    for s in slots.values():
        at = defaultdict(set)
        for x in s:
            at[x[0]].add(x[1])
        versions = []
        for t, i, v, e, sup in sorted(s):
            if sup is not None and sup != i and sup in at[t]:
                continue
            if versions and versions[-1][2] == v and (versions[-1][3] is None or t < versions[-1][3]):
                if e is not None:
                    versions[-1][3] = e if versions[-1][3] is None else min(e, versions[-1][3])
            else:
                if versions:
                    versions[-1][3] = t if versions[-1][3] is None else min(t, versions[-1][3])
                versions.append([i, t, v, e])
        out |= {(i, text(t), text(e) or "") for i, t, v, e in versions}
    return out


def got(df):
    return {tuple(r) for r in df.select("fact_id", "valid_from", "valid_to").collect()}


def test_random_statements(spark):
    for seed in (1, 2):
        rows = random_facts(seed)
        df = make(spark, rows)
        assert got(current_versions(df)) == plain(rows)
        assert got(current_versions(df, hot_rows=20)) == plain(rows)  # split into epochs


def test_versions_across_batches_and_epochs(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = random_facts(5)
        long = [{"fact_id": 1000 + i, "scope": "work", "subject_key": "long", "predicate_key": "p", "object_value": "same" if i != 150 else "other", "valid_from": text(BASE + i * 60), "created_at": None, "valid_to": text(BASE + 100 * 60) if i == 20 else None, "superseded_by": None} for i in range(200)]
        df = make(spark, rows + long)
        assert got(current_versions(df)) == plain(rows + long)
        assert got(current_versions(df, hot_rows=15)) == plain(rows + long)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_order_and_repeats_do_not_matter(spark):
    rows = random_facts(3, 120)
    mixed = rows + rows[:50]
    random.Random(0).shuffle(mixed)
    assert got(current_versions(make(spark, mixed))) == plain(rows)


def test_snapshots_keep_replaced_versions(spark):
    rows = [
        {"fact_id": 1, "scope": "work", "subject_key": "a", "predicate_key": "p", "object_value": "x", "valid_from": text(BASE), "created_at": text(BASE)},
        {"fact_id": 2, "scope": "work", "subject_key": "a", "predicate_key": "p", "object_value": "y", "valid_from": text(BASE + 60), "created_at": text(BASE + 7200)},
        {"fact_id": 3, "scope": "work", "subject_key": "b", "predicate_key": "p", "object_value": "x", "valid_from": text(BASE), "created_at": text(BASE)},
    ]
    h = {(r["fact_id"], r["valid_to"], r["since"], r["replaced"]) for r in build(make(spark, rows), [BASE + 3600]).collect()}
    assert h == {(1, "", 0, 1), (1, text(BASE + 60), 1, None), (2, "", 1, None), (3, "", 0, None)}


def test_a_statement_replaced_later_stood_before(spark):
    slot = {"scope": "work", "subject_key": "a", "predicate_key": "p", "valid_from": text(BASE)}
    rows = [
        slot | {"fact_id": 1, "object_value": "x", "created_at": text(BASE), "superseded_by": 2},
        slot | {"fact_id": 2, "object_value": "y", "created_at": text(BASE + 7200)},
        slot | {"fact_id": 3, "subject_key": "b", "object_value": "x", "created_at": text(BASE), "superseded_by": 4},
        slot | {"fact_id": 4, "subject_key": "b", "object_value": "y", "created_at": text(BASE + 60)},
    ]
    df = make(spark, rows + rows[:1])
    h = {(r["fact_id"], r["valid_to"], r["since"], r["replaced"]) for r in build(df, [BASE + 3600]).collect()}
    assert h == {(1, "", 0, 1), (2, "", 1, None), (4, "", 0, None)}
    h = {(r["fact_id"], r["valid_to"], r["since"], r["replaced"]) for r in build(df, [BASE, BASE + 3600]).collect()}
    assert h == {(1, "", 0, 2), (2, "", 2, None), (3, "", 0, 1), (4, "", 1, None)}
    assert got(current_versions(df)) == {(2, text(BASE), ""), (4, text(BASE), "")}


def test_only_slots_with_changed_rows_move(spark):
    rows = [
        {"fact_id": i, "subject_key": f"s{i}", "predicate_key": "p", "object_value": "x", "valid_from": text(BASE), "created_at": text(BASE), "valid_to": text(BASE + 60) if i % 2 else None}
        for i in range(6)
    ]
    every = statements(make(spark, rows + [rows[2] | {"fact_id": 9, "created_at": text(BASE + 7200)}]))
    before, after = snapshot(every, BASE + 3600), snapshot(every, None)
    want = after.where("fact_id = 9").select("s1", "s2").collect()
    assert moved_slots(before, after).collect() == want == moved_slots(after, before).collect()
    assert moved_slots(after, after).count() == 0


def test_empty_and_no_statements(spark):
    assert current_versions(make(spark, [])).count() == 0
    assert current_versions(make(spark, [{"fact_id": 1, "subject_key": "a"}])).count() == 0
    assert snapshot_cutoffs(make(spark, [])) == []


def test_merkle_finds_only_changed_leaves(spark):
    a = spark.range(2000).selectExpr("xxhash64(id) as k", "id as v")
    b = spark.range(2000).selectExpr("xxhash64(id) as k", "if(id = 77, -1, id) as v")
    ta, tb = levels(leaves(a, "k", 3), 3), levels(leaves(b, "k", 3), 3)
    want = a.where("v = 77").selectExpr("shiftrightunsigned(k, 52) as node").collect()
    assert differing_leaves(ta, tb).collect() == want
    assert differing_leaves(ta, ta).count() == 0
