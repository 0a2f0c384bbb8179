"""Gates over ranked results, and scorecards that say when they cannot tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_gates(ranked: DataFrame, min_score: float = 0.0, min_trust: float = 0.0, category: str | None = None) -> DataFrame:
    """Rows that pass the score, trust and category gates; retired ones by content prefix do not."""
    from .eligibility import retired_by_prefix

    keep = (F.col("score") >= min_score) & (F.coalesce("trust_score", F.lit(0.0)) >= min_trust) & ~retired_by_prefix()
    return ranked.where(keep if category is None else keep & (F.col("category") == category))


def margins(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, top, margin): best score and its lead over the second; the lead is the score itself where there is no second."""
    w = Window.partitionBy(by).orderBy("rank")
    return ranked.withColumn("_next", F.lead("score").over(w)).where("rank = 1").select(by, F.col("score").alias("top"), F.round(F.col("score") - F.coalesce("_next", F.lit(0.0)), 6).alias("margin"))


def margin_gate(ranked: DataFrame, min_margin: float, by: str = "query_id") -> DataFrame:
    """Results of queries whose best row leads by at least the margin; the others abstain."""
    good = margins(ranked, by).where(F.col("margin") >= min_margin).select(by)
    return ranked.join(good, by, "left_semi")


def ordered_union(first: DataFrame, second: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, fact_id, place): candidates of two rankings, each once, where it occurs first."""
    both = first.select(by, "fact_id", F.lit(0).alias("l"), "rank").unionByName(second.select(by, "fact_id", F.lit(1).alias("l"), "rank"))
    g = both.groupBy(by, "fact_id").agg(F.min(F.struct("l", "rank")).alias("at"))
    return g.select(by, "fact_id", F.row_number().over(Window.partitionBy(by).orderBy("at", "fact_id")).alias("place"))


def summary_facts(facts: DataFrame, trusted: int = 25, recent: int = 15, limit: int = 40) -> DataFrame:
    """Most trusted and newest facts, each once."""
    a = facts.orderBy(F.col("trust_score").desc_nulls_last(), F.col("fact_id").desc()).limit(trusted)
    b = facts.orderBy(F.col("fact_id").desc()).limit(recent)
    return a.select("fact_id", "content").union(b.select("fact_id", "content")).distinct().limit(limit)


def metric_or_blocked(n: Column, value: Column) -> Column:
    """(status, value): blocked and null where there is nothing to measure, not zero."""
    return F.struct(F.when(n == 0, "blocked").otherwise("measured").alias("status"), F.when(n > 0, F.round(value, 6)).alias("value"))


def truth_scorecard(results: DataFrame, contradiction: DataFrame | None = None) -> DataFrame:
    """(metric, status, value): temporal correctness, abstention, staleness and contradiction coverage."""
    answer = ~F.col("abstain")
    gold = F.array_position("ranked", F.col("gold"))
    top3 = F.slice("ranked", 1, 3)
    temporal = F.when((gold > 0) & ~F.arrays_overlap(top3, F.col("stale")), 1.0).otherwise(0.0)
    exposed = answer & (F.size("stale") > 0)
    g = results.agg(
        metric_or_blocked(F.count_if(answer), F.avg(F.when(answer, temporal))).alias("temporal"),
        metric_or_blocked(F.count_if(F.col("abstain")), F.avg(F.when(F.col("abstain"), F.when(F.size("ranked") == 0, 1.0).otherwise(0.0)))).alias("abstention"),
        metric_or_blocked(F.count_if(exposed), F.avg(F.when(exposed, F.when(F.arrays_overlap(top3, F.col("stale")), 1.0).otherwise(0.0)))).alias("stale_exposed"),
    )
    out = g.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.status").alias("status"), F.col(f"{m}.value").alias("value")) for m in ("temporal", "abstention", "stale_exposed")])).alias("x")).select("x.*")
    if contradiction is not None:
        c = contradiction.agg(metric_or_blocked(F.count(F.lit(1)), F.avg(F.when(F.size(F.array_except("expected", "ranked")) == 0, 1.0).otherwise(0.0))).alias("x"))
        out = out.unionByName(c.select(F.lit("contradiction").alias("metric"), F.col("x.status").alias("status"), F.col("x.value").alias("value")))
    return out


def verdicts(cases: DataFrame, by: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall and false-verify rate of support verdicts, per group and in total."""
    s, p = F.col(label) == "supported", F.col(predicted) == "supported"
    r = cases.rollup(by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(s & p).alias("tp"), F.count_if(~s & p).alias("fp"), F.count_if(s & ~p).alias("fn"), F.count_if(~s).alias("negatives"))
    d = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    tp, fp = F.col("tp"), F.col("fp")
    return r.select(F.coalesce(by, F.lit("(all)")).alias(by), "cases", d(tp, tp + fp).alias("precision"), d(tp, tp + F.col("fn")).alias("recall"), d(fp, F.col("negatives")).alias("false_verify"))


def coverage_ratios(facts: DataFrame) -> DataFrame:
    """Share of rows with each optional column filled."""
    cols = ["valid_from", "valid_to", "subject_key", "predicate_key", "object_value", "memory_kind", "confidence", "source_authority"]
    return facts.agg(F.count(F.lit(1)).alias("facts"), *[F.round(F.coalesce(F.try_divide(F.count(c).cast("double"), F.count(F.lit(1))), F.lit(0.0)), 6).alias(c) for c in cols])


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): an order-free digest over all columns; equal tables have equal digests."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.hex(F.bit_xor(h)).alias("a"), F.hex(F.bit_xor(F.xxhash64(h))).alias("b")).select("rows", F.concat("a", F.lit(":"), "b").alias("digest"))


def index_percentile(values: DataFrame, column: str, by: str, share: float = 0.95) -> DataFrame:
    """The element at index ``int(share * n)`` of the sorted values: differs from nearest rank where the product is whole."""
    w = Window.partitionBy(by)
    r = values.where(F.col(column).isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy(column)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return r.where(F.col("_i") == F.least((F.col("_n") * share).cast("int"), F.col("_n") - 1)).select(by, F.col(column).alias("p"))
