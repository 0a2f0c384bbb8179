import random
import re
from collections import defaultdict

from factloom.llm import neardup
from factloom.llm.canonical import copies
from factloom.llm.collapse import groups
from factloom.llm.neardup import alike, group_members
from factloom.llm.survivor import golden, survivors

SCHEMA = "fact_id long, content string, first string, k1 string, rep string, id string"


def facts(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)


def sets_of(pairs):
    return {(f, m) for f, m in pairs}


def test_copies(spark):
    rows = [
        (5, "Port: 80; Owner: Ann Lee"), (3, '{"owner": "ann  lee", "port": "80"}'), (9, "OWNER=Ann-Lee | PORT=80"), (4, "port 80 owner ann lee"), (8, "port 80, owner: ann"),
        (20, "The  quick\nfox!"), (21, "the QUICK fox"), (22, "quick the fox"), (30, None), (31, ""), (32, " .!"), (33, "..."), (40, "Straße"), (41, "STRASSE"), (50, "a: 1; b: 2"), (51, "b: 2; a: 2"),
    ]
    sets, members = copies(facts(spark, rows + [rows[0]]))
    got = sets_of(members.where("fact_id != first").select("first", "fact_id").collect())
    assert got == {(3, 5), (3, 9), (3, 4), (20, 21), (40, 41)}
    assert {(r["first"], r["copies"]) for r in sets.collect()} == {(3, 4), (20, 2), (40, 2)}
    assert copies(facts(spark, []))[1].count() == 0


def test_hot_keys_take_the_salted_path(spark):
    rows = [(i, 0 if i % 3 == 0 else i // 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, k long")
    found, members = groups(df, ["k"], "i", 3000)
    want = defaultdict(list)
    for i, k in rows:
        want[k].append(i)
    want = {min(v): len(v) for v in want.values() if len(v) > 1}
    assert {r["first"]: r["copies"] for r in found.collect()} == want
    assert members.count() == sum(want.values())


def brute(rows, num=7, den=10, ngram=1):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if ngram > 1 and w:
            w = [" ".join(w[j : j + ngram]) for j in range(max(1, len(w) - ngram + 1))]
        if w:
            sets[i] = frozenset(w)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(find(i), i) for i in ids if find(i) != i}


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = out[r.randrange(len(out))][1].split()
            for _ in range(r.randrange(4)):
                w.insert(r.randrange(len(w) + 1), r.choice(vocabulary))
            if r.random() < 0.5:
                r.shuffle(w)
        else:
            w = [r.choice(vocabulary) for _ in range(r.randrange(1, 25))]
        out.append((i, " ".join(w)))
    return out


def test_groups_equal_brute_force(spark, monkeypatch):
    rows = texts(1, 250) + [(900, None), (901, ""), (902, "?!"), (903, "w1 " * 5000)]
    got = lambda **k: sets_of(group_members(alike(facts(spark, rows + rows[:20]), **k)).collect())
    assert got() == brute(rows)
    assert got(num=8, ngram=2) == brute(rows, 8, 10, 2)
    monkeypatch.setattr(neardup, "CHUNK", 8)  # every frequent word is cut into chunks
    monkeypatch.setattr(neardup, "STEP", 64)
    assert got() == brute(rows)
    plain = neardup.similar_pairs
    monkeypatch.setattr(neardup, "similar_pairs", lambda *a: plain(*a, hot_list=2))  # the list of cut columns is joined
    assert got() == brute(rows)
    monkeypatch.setattr(neardup, "LONG", 12)  # longer rows send no rest
    assert got() == brute(rows)


def test_a_hot_family_of_edits(spark):
    r = random.Random(2)
    base = [f"b{i}" for i in range(30)]
    rows = [(i, " ".join([*base[: r.randrange(26, 31)], f"x{i}"])) for i in range(120)] + [(500 + i, f"other{i} text{i}") for i in range(60)]
    assert sets_of(group_members(alike(facts(spark, rows))).collect()) == brute(rows)


def test_empty(spark):
    assert group_members(alike(facts(spark, []))).count() == 0


def test_survivors(spark):
    schema = "fact_id long, trust_score double, retrieval_count long, created_at string, tags string, category string, scope string, sensitivity string, memory_kind string, subject_key string, predicate_key string, object_value string"
    none = (None,) * 6
    rows = [
        (1, 0.5, 10, "2025-01-02", "B, a", "x", *none), (2, 0.5, 10, "2025-01-01T00:00:00Z", " A,c,,", None, *none), (3, None, 99, None, None, "x", *none),
        (4, 0.1, None, None, None, None, *none), (5, None, None, None, "", None, *none),
        (6, 0.0, 0, "2025-03-01", "z", None, *none), (7, 0.0, 0, "2025-03-01", "z", None, *none),
    ]
    f = spark.createDataFrame(rows, schema)
    m = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (6, 6), (6, 7)], "first long, fact_id long")
    assert {tuple(r) for r in survivors(m, f).collect()} == {(1, 2, 1, "a,b,c"), (4, 4, 4, ""), (6, 6, 6, "z")}
    assert {r["first_fact_id"]: r["category"] for r in golden(m, f).collect()}.get(1) == "x"
    assert survivors(m.where("false"), f).count() == 0


def test_golden_equals_brute_force(spark):
    from collections import defaultdict

    from factloom.llm.survivor import HALF_LIFE_DAYS, latest

    r = random.Random(4)
    day = [f"2025-{m:02d}-{d:02d}T00:00:00Z" for m in (1, 3, 6) for d in (1, 9)]
    rows = [(i, r.choice([None, 0.2, 0.5, 0.9]), r.randrange(5), r.choice([None, *day]), None, r.choice([None, "Ops", "ops ", "infra", "x"]), r.choice([None, "a", "b"]), *(None,) * 5) for i in range(120)]
    f = spark.createDataFrame(rows, "fact_id long, trust_score double, retrieval_count long, created_at string, tags string, category string, scope string, sensitivity string, memory_kind string, subject_key string, predicate_key string, object_value string")
    sets = {i: i % 17 for i in range(120)}
    m = spark.createDataFrame([(s, i) for i, s in sets.items()], "first long, fact_id long")
    import datetime as dt

    seconds = lambda t: None if t is None else int(dt.datetime.fromisoformat(t).timestamp())
    now = latest(f)
    assert now == max(seconds(x[3]) for x in rows if x[3])
    want = defaultdict(dict)
    for column, name in ((5, "category"), (6, "scope")):
        votes, tie, value = defaultdict(float), {}, {}
        for row in rows:
            if row[column] is not None:
                k = (sets[row[0]], row[column].strip().lower())
                at = seconds(row[3])
                votes[k] += (row[1] or 0) * 0.5 ** (max(0, now - (at or 0)) / 86400 / HALF_LIFE_DAYS)
                t = (at if at is not None else 253402300799, row[0])
                if k not in tie or t < tie[k]:
                    tie[k], value[k] = t, row[column]
        for s, norm in votes:
            best = want[s].get(name)
            rank = (round(votes[s, norm], 9), -tie[s, norm][0], -tie[s, norm][1])
            if best is None or rank > best[0]:
                want[s][name] = (rank, value[s, norm])
    for row in golden(m, f).collect():
        for name in ("category", "scope"):
            assert row[name] == want[row["first_fact_id"]].get(name, (0, None))[1]
