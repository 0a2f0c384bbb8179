"""Packing ranked facts into a prompt: budgets by running sums, diversity by greedy selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens

#: Rows of a ranking that one prompt looks at (four times twelve).
PER_QUERY = 48


def budget_prefix(ranked: DataFrame, budget: int, text: str = "content", by: str = "query_id") -> DataFrame:
    """The longest prefix of each ranking whose estimated tokens stay within the budget."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(estimated_tokens(F.col(text))).over(w)).where(F.col("used") <= budget)


def reviewed_first(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """Reviewed facts before others, each part in its order."""
    w = Window.partitionBy(by).orderBy(F.col("correction_status").isin("human_confirmed", "human_corrected").desc_nulls_last(), "rank")
    return ranked.withColumn("place", F.row_number().over(w))


def mmr(ranked: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(query_id, fact_id, place): greedy maximal marginal relevance; ties to the better rank.

    Two facts are alike by the cosine of their vectors (column ``embedding``,
    if there) where both have one, else by shared tokens. A query brings its
    first PER_QUERY rows: as many as its prompt may ask for.
    """
    has = "embedding" in ranked.columns

    def pick(pdf):
        import re

        import numpy as np
        import pandas as pd

        rows = pdf.sort_values("rank").head(PER_QUERY)
        toks = [frozenset(re.findall("[a-z0-9]+", (t or "").lower())) for t in rows["content"]]
        unit = []
        for v in rows["embedding"] if has else [None] * len(rows):
            x = None if v is None else np.asarray(v, np.float64)
            ok = x is not None and x.size and np.isfinite(x).all() and np.linalg.norm(x) > 0
            unit.append(x / np.linalg.norm(x) if ok else None)
        rel, ids = rows["score"].tolist(), rows["fact_id"].tolist()

        def like(i: int, j: int) -> float:
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]):
                return float(np.clip(unit[i] @ unit[j], -1, 1))
            every = toks[i] | toks[j]
            return len(toks[i] & toks[j]) / len(every) if every else 0.0

        chosen: list[int] = []
        left = list(range(len(ids)))
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (round(weight * rel[i] - (1 - weight) * max((like(i, j) for j in chosen), default=0.0), 9), -i))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({"query_id": [rows["query_id"].iloc[0]] * len(chosen), "fact_id": [ids[i] for i in chosen], "place": range(1, len(chosen) + 1)})

    cols = ["query_id", "fact_id", "rank", "score", "content", *(["embedding"] if has else [])]
    return ranked.where(F.col("rank") <= PER_QUERY).select(*cols).groupBy("query_id").applyInPandas(pick, "query_id long, fact_id long, place int")
