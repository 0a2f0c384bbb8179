"""Metrics over ranked results and over extracted facts.

Ranked results: (case_id, case_type, gold, stale array, ranked array, scores array, abstain).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gold_rank() -> Column:
    """1-based rank of the gold fact, null if it is not ranked."""
    p = F.array_position("ranked", F.col("gold"))
    return F.when(p > 0, p)


def recall_at(k: int) -> Column:
    return F.avg(F.when(F.coalesce(gold_rank() <= k, F.lit(False)), 1.0).otherwise(0.0))


def ndcg_at(k: int) -> Column:
    return F.avg(F.when(F.coalesce(gold_rank() <= k, F.lit(False)), 1.0 / F.log2(gold_rank() + 1.0)).otherwise(0.0))


def mrr() -> Column:
    return F.avg(F.coalesce(1.0 / gold_rank(), F.lit(0.0)))


def stale_leak(k: int) -> Column:
    return F.avg(F.when(F.arrays_overlap(F.slice("ranked", 1, k), F.col("stale")), 1.0).otherwise(0.0))


def scorecard(results: DataFrame, by: str | None = None) -> DataFrame:
    """Recall and nDCG at 1, 3, 5, 10, reciprocal rank and stale leaks, for answerable cases."""
    aggs = [F.count(F.lit(1)).alias("cases")]
    for k in (1, 3, 5, 10):
        aggs += [F.round(recall_at(k), 6).alias(f"recall_{k}"), F.round(ndcg_at(k), 6).alias(f"ndcg_{k}")]
    aggs += [F.round(mrr(), 6).alias("mrr"), F.round(stale_leak(3), 6).alias("stale_3")]
    rows = results.where("not abstain")
    return (rows.groupBy(by) if by else rows).agg(*aggs)


def by_category(results: DataFrame) -> DataFrame:
    """Recall at 1 and 3 per case type and in total, as one rollup."""
    g = results.where("not abstain").rollup("case_type").agg(F.count(F.lit(1)).alias("cases"), F.round(recall_at(1), 6).alias("recall_1"), F.round(recall_at(3), 6).alias("recall_3"))
    return g.withColumn("case_type", F.coalesce("case_type", F.lit("(all)")))


def abstention(results: DataFrame) -> DataFrame:
    """The four cells of abstaining: a case abstains if nothing is ranked."""
    empty = F.size("ranked") == 0
    c = results.agg(
        F.count_if(F.col("abstain") & empty).alias("right_abstain"), F.count_if(F.col("abstain") & ~empty).alias("missed_abstain"),
        F.count_if(~F.col("abstain") & empty).alias("false_abstain"), F.count_if(~F.col("abstain") & ~empty).alias("answered"),
    )
    precision = F.try_divide(F.col("right_abstain").cast("double"), F.col("right_abstain") + F.col("false_abstain"))
    recall = F.try_divide(F.col("right_abstain").cast("double"), F.col("right_abstain") + F.col("missed_abstain"))
    return c.select("*", F.round(F.coalesce(precision, F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(recall, F.lit(0.0)), 6).alias("recall"))


def threshold_sweep(results: DataFrame, thresholds: list[float]) -> DataFrame:
    """Recall at 1 and abstained cases when results below each score threshold are dropped."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    r = results.withColumn("threshold", t)
    kept = F.filter(F.arrays_zip("ranked", "scores"), lambda x: x.scores >= F.col("threshold"))
    r = r.withColumn("ranked", F.transform(kept, lambda x: x.ranked))
    return r.groupBy("threshold").agg(
        F.round(F.avg(F.when(~F.col("abstain"), F.coalesce((gold_rank() == 1).cast("double"), F.lit(0.0)))), 6).alias("recall_1"), F.count_if(F.size("ranked") == 0).alias("empty"),
    )


def nearest_rank(values: DataFrame, column: str, percents: list[int], by: str) -> DataFrame:
    """Nearest-rank percentiles (an observed value) of a column by group."""
    return values.groupBy(by).agg(*[F.expr(f"percentile_disc({p / 100}) within group (order by {column})").alias(f"p{p}") for p in percents])


def set_prf(pairs: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Per row precision, recall and F1 of two sets; both empty counts as 1."""
    p, e = F.array_distinct(predicted), F.array_distinct(expected)
    hit = F.size(F.array_intersect(p, e)).cast("double")
    both = (F.size(p) == 0) & (F.size(e) == 0)
    precision = F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(hit, F.size(p)), F.lit(0.0)))
    recall = F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(hit, F.size(e)), F.lit(0.0)))
    r = pairs.withColumns({"precision": precision, "recall": recall})
    return r.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def answer_tokens(text: Column) -> Column:
    """Lower-case word tokens without articles, repetitions kept."""
    t = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.filter(t, lambda x: ~x.isin("a", "an", "the", ""))


def token_f1(pairs: DataFrame, ident: str, a: str, b: str) -> DataFrame:
    """(ident, f1): multiset token overlap of two texts; both empty counts as 1."""
    ta = pairs.select(ident, F.explode(answer_tokens(F.col(a))).alias("t")).groupBy(ident, "t").agg(F.count(F.lit(1)).alias("ca"))
    tb = pairs.select(ident, F.explode(answer_tokens(F.col(b))).alias("t")).groupBy(ident, "t").agg(F.count(F.lit(1)).alias("cb"))
    both = ta.join(tb, [ident, "t"]).groupBy(ident).agg(F.sum(F.least("ca", "cb")).alias("hit"))
    r = pairs.select(ident, F.size(answer_tokens(F.col(a))).alias("na"), F.size(answer_tokens(F.col(b))).alias("nb")).join(both, ident, "left")
    hit = F.coalesce("hit", F.lit(0)).cast("double")
    f1 = F.when((F.col("na") == 0) & (F.col("nb") == 0), 1.0).otherwise(F.coalesce(F.try_divide(2 * hit, F.col("na") + F.col("nb")), F.lit(0.0)))
    return r.select(ident, F.round(f1, 6).alias("f1"))


def gate_metrics(gold: DataFrame) -> DataFrame:
    """Per decision: cases, facts, shares of typed facts, of user-asserted ones and of facts with evidence."""
    f = gold.select("decision", "case_id", F.explode_outer("facts").alias("f"))
    has = F.col("f").isNotNull()
    return f.groupBy("decision").agg(
        F.countDistinct("case_id").alias("cases"), F.count_if(has).alias("facts"), F.count_if(has & F.col("f.state").isNotNull()).alias("typed"),
        F.count_if(has & (F.col("f.asserted_by") == "user")).alias("by_user"), F.count_if(has & F.col("f.evidence_excerpt").isNotNull()).alias("with_evidence"),
    )
