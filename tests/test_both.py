"""The hybrid ranking without a table of all pairs, and nearest vectors of many queries without a broadcast of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_firsts import QUERIES, facts, no_pairs  # noqa: F401

from factloom.operators import dense, firsts, ranking
from factloom.plans import retrieval


def test_hybrid_rank_without_pairs(spark, small, monkeypatch):
    no_pairs(monkeypatch)
    monkeypatch.setattr(dense, "_query_blocks", None)  # nor are query vectors collected
    assert retrieval.hybrid_rank(spark, small).count() > 0


def vectors(spark, n):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 6)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] * 2  # the same direction: equal cosines
    x[: n // 4] = x[0]
    return x, spark.createDataFrame([(i + 1, [float(a) for a in v], 6, "v") for i, v in enumerate(x)], "fact_id long, embedding array<float>, dim int, embedding_identity string")


@pytest.mark.parametrize("pack,asked,pairs", [(4096, 512, 1 << 17), (50, 7, 20)])
def test_nearest_equals_brute_force(spark, monkeypatch, pack, asked, pairs):
    """Of equal cosines at the last place the smaller identifiers stay."""
    monkeypatch.setattr(dense, "PACK", pack)
    monkeypatch.setattr(dense, "ASKED", asked)
    monkeypatch.setattr(dense, "PAIRS", pairs)
    x, v = vectors(spark, 600)
    q = v.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "embedding")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for i in range(20, 601, 20):
        c = dense.rounded(u @ u[i - 1])
        want |= {(i, int(f) + 1, n + 1) for n, f in enumerate(np.lexsort((np.arange(600), -c))[:9])}
    assert {(r["query_id"], r["fact_id"], r["rank"]) for r in dense.nearest(v, q, 9).collect()} == want


def test_hybrid_equals_full_table(spark, facts, monkeypatch):  # noqa: F811
    monkeypatch.setattr(firsts, "CHUNK", 150)
    _, v = vectors(spark, 600)
    # queries without a vector, without a token, with names, and of the same tokens with other vectors
    texts = [*QUERIES, "port atlas deploy", "port"]
    q = spark.createDataFrame([(20 * (i + 1), t) for i, t in enumerate(texts)], "query_id long, query string")
    qv = v.where("fact_id % 20 = 0 and fact_id != 40").select(F.col("fact_id").alias("query_id"), "embedding")
    keep = facts.where("trust_score >= 0.3").select("fact_id")
    near = dense.top_k(dense.present(v).join(keep, "fact_id", "left_semi"), qv, 600).where("rank <= 100").select("query_id", "fact_id", "cosine")
    full = ranking.fuse(ranking.candidates(facts, q, ["work"]), facts, q, 1767225600, ranking.Config(), near, 10)

    def rows(df):
        return sorted((r["query_id"], r["rank"], r["fact_id"], r["lexical_rank"], r["dense_rank"], r["fused"], r["score"]) for r in df.select("query_id", "rank", "fact_id", F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"), "fused", "score").collect())

    got = ranking.hybrid(facts, q, v, qv, ["work"], 1767225600)
    assert rows(got) == rows(ranking.margin_gate(full))
