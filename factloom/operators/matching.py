"""Scoring predicted against expected facts by maximum bipartite matching, case by case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def maximum_matching(edges: list[tuple[int, int]]) -> dict[int, int]:
    """left -> right of a maximum matching; left and right in ascending order, so the result is deterministic."""
    to: dict[int, list[int]] = {}
    for a, b in sorted(set(edges)):
        to.setdefault(a, []).append(b)
    owner: dict[int, int] = {}

    def place(a: int, seen: set[int]) -> bool:
        for b in to[a]:
            if b not in seen:
                seen.add(b)
                if b not in owner or place(owner[b], seen):
                    owner[b] = a
                    return True
        return False

    for a in sorted(to):
        place(a, set())
    return {a: b for b, a in owner.items()}


def match_cases(edges: DataFrame) -> DataFrame:
    """(case_id, left, right) of (case_id, left, right): a maximum matching of every case.

    Cases are small by construction (a case is one transcript's facts), and
    each is matched on its own.
    """

    def run(pdf):
        import pandas as pd

        m = maximum_matching(list(zip(pdf["left"].tolist(), pdf["right"].tolist(), strict=True)))
        return pd.DataFrame({"case_id": pdf["case_id"].iloc[0], "left": list(m), "right": list(m.values())})

    return edges.select("case_id", F.col("left").cast("int"), F.col("right").cast("int")).groupBy("case_id").applyInPandas(run, "case_id string, left int, right int")


def matched_counts(expected: DataFrame, predicted: DataFrame, edges: DataFrame) -> DataFrame:
    """Per case: expected, predicted and matched facts, precision, recall and F1."""
    e = expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("expected"))
    p = predicted.groupBy("case_id").agg(F.count(F.lit(1)).alias("predicted"))
    m = match_cases(edges).groupBy("case_id").agg(F.count(F.lit(1)).alias("matched"))
    r = e.join(p, "case_id", "full").join(m, "case_id", "left").na.fill(0, ["expected", "predicted", "matched"])
    precision, recall = F.try_divide(F.col("matched").cast("double"), F.col("predicted")), F.try_divide(F.col("matched").cast("double"), F.col("expected"))
    r = r.withColumns({"precision": F.coalesce(precision, F.lit(0.0)), "recall": F.coalesce(recall, F.lit(0.0))})
    return r.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
