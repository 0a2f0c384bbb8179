"""Pairs that differ wholly behind their common prefix, against all pairs."""

import itertools
import random

import pandas as pd

from factloom.operators.contradictions import apart


def test_apart_equals_all_pairs():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    toks = [["we", "use", "the"][: rng.choice((2, 3))] + [rng.choice(words) for _ in range(rng.randrange(6))] for _ in range(300)]
    rows = pd.DataFrame({"fact_id": range(300), "tok": toks})
    want = set()
    for i, j in itertools.combinations(range(300), 2):
        n = next((k for k, (x, y) in enumerate(zip(toks[i], toks[j])) if x != y), min(len(toks[i]), len(toks[j])))
        a, b = set(toks[i][n:]), set(toks[j][n:])
        if a and b and not a & b:
            want.add((j, i))
    got = apart(rows)
    assert want and set(zip(got["newer"].tolist(), got["older"].tolist())) == want and len(got) == len(want)


def test_untyped_conflicts_split_no_text_per_pair(spark):
    """Labels are made of stored stems."""
    from factloom.operators import writes

    f = spark.createDataFrame([(1, "the cache of atlas is enabled"), (2, "the cache of atlas is disabled"), (3, "an oak door")], "fact_id long, content string")
    got = writes.untyped_conflicts(spark.createDataFrame([(2, 1), (2, 3)], "newer long, older long"), f)
    assert [(r["newer"], r["older"], r["subject_key"], r["predicate_key"]) for r in got.collect()] == [(2, 1, "cache", "atlas")]
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
