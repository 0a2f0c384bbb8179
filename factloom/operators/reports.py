"""Reports over ranked results: gates by threshold and rule, leaks, sets, margins, tuning, and the gates of a release.

Results: (case_id, case_type, gold, expected array, stale array, abstain, rows),
where rows is the ranking: array of (fact_id, score, trust, category_ok, retired).
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The thresholds and rules of the report, and the bars of the capture gate.
THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
RULES = (
    {"name": "score>=0.5_margin>=0.02", "min_score": 0.5, "min_margin": 0.02},
    {"name": "score>=0.5_margin>=0.05", "min_score": 0.5, "min_margin": 0.05},
    {"name": "score>=0.5_trust>=0.5", "min_score": 0.5, "min_trust": 0.5},
    {"name": "score>=0.5_no_stale_prefix", "min_score": 0.5, "reject_stale_prefix": True},
    {"name": "score>=0.5_margin>=0.02_trust>=0.5_no_stale_prefix", "min_score": 0.5, "min_margin": 0.02, "min_trust": 0.5, "reject_stale_prefix": True},
)
CAPTURE_BARS = {
    "forbidden_rate": 0.0, "misattribution_rate": 0.0, "typed_precision": 1.0, "typed_recall": 0.90, "silent_demotion_rate": 0.0, "incidental_recall": 0.70, "incidental_precision": 0.90,
}
RULE_TYPE = "array<struct<rule: string, min_score: double, min_margin: double, min_trust: double, fresh: boolean, category: boolean>>"


def rules(thresholds=THRESHOLDS, named=RULES) -> Column:
    """All gates of a report as one array: none, each threshold, each named rule."""
    def one(name: str, r: dict) -> Column:
        num = lambda k: F.lit(r.get(k)).cast("double")
        return F.struct(F.lit(name).alias("rule"), num("min_score").alias("min_score"), num("min_margin").alias("min_margin"), num("min_trust").alias("min_trust"), F.lit(bool(r.get("reject_stale_prefix"))).alias("fresh"), F.lit(bool(r.get("require_category_match"))).alias("category"))

    every = [one("none", {}), *[one(f"score>={t:g}", {"min_score": t}) for t in thresholds], *[one(r["name"], r) for r in named]]
    return F.array(*every).cast(RULE_TYPE)


def gated(results: DataFrame, gates: Column) -> DataFrame:
    """The results once per gate, with ``ranked``: the identifiers that pass it. A margin counts where there are two scores at least."""
    r = results.withColumn("g", F.explode(gates)).withColumn("margin", F.when(F.size("rows") > 1, F.col("rows")[0]["score"] - F.col("rows")[1]["score"]))
    passes = F.filter("rows", lambda x: (
        (F.col("g.min_score").isNull() | F.coalesce(x.score >= F.col("g.min_score"), F.lit(False))) & (F.col("g.min_trust").isNull() | F.coalesce(x.trust >= F.col("g.min_trust"), F.lit(False)))
        & (~F.col("g.fresh") | ~x.retired) & (~F.col("g.category") | x.category_ok)
    ))
    open_ = F.col("g.min_margin").isNull() | F.col("margin").isNull() | (F.col("margin") >= F.col("g.min_margin"))
    return r.withColumn("ranked", F.when(open_, F.transform(passes, lambda x: x.fact_id)).otherwise(F.array().cast("array<bigint>"))).withColumn("rule", F.col("g.rule")).drop("g", "margin")


def _rate(n: Column, d: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(n.cast("double"), d), F.lit(0.0)), 6)


def block(ranked: DataFrame, by: list[str]) -> DataFrame:
    """One report row per group: ranking, answerable, abstention, leaks and sets."""
    p = F.array_position("ranked", F.col("gold"))
    rank = F.when(p > 0, p)
    hit = lambda k: F.when(F.coalesce(rank <= k, F.lit(False)), 1.0).otherwise(0.0)
    answer = ~F.col("abstain")
    expected = F.when(F.size("expected") > 0, F.array_distinct("expected")).otherwise(F.array("gold"))
    fresh = F.array_except("ranked", "stale")
    both = F.size(F.array_intersect(fresh, expected)).cast("double")
    precision, recall = F.coalesce(F.try_divide(both, F.size(fresh)), F.lit(0.0)), F.coalesce(F.try_divide(both, F.size(expected)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    found = F.arrays_overlap(F.array_except(expected, F.col("stale")), F.col("ranked"))
    leak = lambda k: F.arrays_overlap(F.slice("ranked", 1, k), F.col("stale"))
    exposed = F.size("stale") > 0
    count = F.count_if
    g = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), count(F.size("ranked") > 0).alias("accepted"),
        *[F.round(F.avg(hit(k)), 6).alias(f"recall_{k}") for k in (1, 3, 5, 10)], F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias("mrr"),
        count(answer).alias("answerable"), *[F.round(F.coalesce(F.avg(F.when(answer, hit(k))), F.lit(0.0)), 6).alias(f"answerable_recall_{k}") for k in (1, 3, 5, 10)],
        F.round(F.coalesce(F.avg(F.when(answer, F.coalesce(1.0 / rank, F.lit(0.0)))), F.lit(0.0)), 6).alias("answerable_mrr"),
        count(~answer & (F.size("ranked") == 0)).alias("true_abstain"), count(~answer & (F.size("ranked") > 0)).alias("false_confident"), count(answer & ~found).alias("false_abstain"), count(answer & found).alias("correct_answer"),
        count(exposed).alias("exposed"), count(leak(1)).alias("leaks_1"), count(leak(3)).alias("leaks_3"),
        F.round(F.avg(precision), 6).alias("set_precision"), F.round(F.avg(recall), 6).alias("set_recall"), F.round(F.avg(f1), 6).alias("set_f1"),
    )
    t, fa, fc = F.col("true_abstain"), F.col("false_abstain"), F.col("false_confident")
    g = g.withColumns({"leak_rate_3": _rate(F.col("leaks_3"), F.col("cases")), "exposed_leak_rate_3": _rate(F.col("leaks_3"), F.col("exposed")), "abstain_precision": _rate(t, t + fa), "abstain_recall": _rate(t, t + fc)})
    return g.withColumn("abstain_f1", _rate(2 * t, 2 * t + fa + fc))


def full_report(results: DataFrame, thresholds=THRESHOLDS, named=RULES) -> DataFrame:
    """(section, key, ...): the report of all results, by threshold and rule, and by case type."""
    by_rule = block(gated(results, rules(thresholds, named)), ["rule"]).select(F.lit("rule").alias("section"), F.col("rule").alias("key"), "*").drop("rule")
    by_type = block(gated(results, rules((), ())), ["case_type"]).select(F.lit("case_type").alias("section"), F.col("case_type").alias("key"), "*").drop("case_type")
    return by_rule.unionByName(by_type)


def score_spread(results: DataFrame) -> DataFrame:
    """(what, n, p50, p95, least, most): top scores and margins, by nearest rank; zeros where there are none."""
    top = results.where(F.size("rows") > 0).select(F.lit("top_score").alias("what"), F.col("rows")[0]["score"].alias("v"))
    gap = results.where(F.size("rows") > 1).select(F.lit("margin").alias("what"), F.round(F.col("rows")[0]["score"] - F.col("rows")[1]["score"], 6).alias("v"))
    return top.unionByName(gap).groupBy("what").agg(
        F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) within group (order by v)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by v)").alias("p95"), F.min("v").alias("least"), F.max("v").alias("most")
    )


def truth_metrics(results: DataFrame, injection: DataFrame | None = None, conflicts: DataFrame | None = None, tokens: DataFrame | None = None, latency: DataFrame | None = None) -> DataFrame:
    """(metric, status, value, cases) of all seven measures of a truthful memory; what has no cases is blocked, not zero.

    ``injection``: (held boolean) of the cases tagged so; ``conflicts``:
    (detected boolean); ``tokens`` and ``latency``: (value double) per query.
    """
    top = F.slice("ranked", 1, 3)
    temporal, abstain, exposed = F.col("case_type").isin("temporal", "as_of", "historical"), F.col("abstain"), F.size("stale") > 0
    right = (F.array_position("ranked", F.col("gold")) > 0) & ~F.arrays_overlap(top, F.col("stale"))
    r = results if "ranked" in results.columns else gated(results, rules((), ()))
    share = lambda where, good: F.round(F.avg(F.when(where, F.when(good, 1.0).otherwise(0.0))), 6)
    row = r.agg(
        F.struct(F.count_if(exposed).alias("n"), share(exposed, F.arrays_overlap(top, F.col("stale"))).alias("v")).alias("stale_fact_leak_rate"),
        F.struct(F.count_if(abstain).alias("n"), share(abstain, F.size("ranked") == 0).alias("v")).alias("abstention_correctness"),
        F.struct(F.count_if(temporal).alias("n"), share(temporal, right).alias("v")).alias("temporal_asof_correctness"),
    )
    names = ["stale_fact_leak_rate", "abstention_correctness", "temporal_asof_correctness"]
    out = row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.v").alias("value"), F.col(f"{m}.n").alias("cases")) for m in names])).alias("x")).select("x.*")
    spark = results.sparkSession
    for name, df, column in (("contradiction_detection_rate", conflicts, "detected"), ("injection_resistance", injection, "held")):
        part = spark.createDataFrame([(name, None, 0)], "metric string, value double, cases long") if df is None else df.agg(F.round(F.avg(F.col(column).cast("double")), 6).alias("value"), F.count(F.lit(1)).alias("cases")).select(F.lit(name).alias("metric"), "value", "cases")
        out = out.unionByName(part)
    for name, df, how in (("tokens_per_query", tokens, F.round(F.avg("value"), 6)), ("latency_ms", latency, F.expr("percentile_disc(0.5) within group (order by value)"))):
        part = spark.createDataFrame([(name, None, 0)], "metric string, value double, cases long") if df is None else df.agg(how.cast("double").alias("value"), F.count(F.lit(1)).alias("cases")).select(F.lit(name).alias("metric"), "value", "cases")
        out = out.unionByName(part)
    return out.select("metric", F.when(F.col("cases") > 0, "measured").otherwise("blocked").alias("status"), F.when(F.col("cases") > 0, F.col("value")).alias("value"), "cases")


def capture_metrics(cases: DataFrame) -> DataFrame:
    """One row of ratios over cases of counts; empty denominators give the ratio's neutral value.

    ``cases``: speaker_correct, speaker_predicted, misattributed, typed_expected,
    typed_complete, typed_predicted, typed_correct, silent, incidental_expected,
    incidental_matched, incidental_predicted, leaks.
    """
    s = cases.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "speaker_correct speaker_predicted misattributed typed_expected typed_complete typed_predicted typed_correct silent incidental_expected incidental_matched incidental_predicted leaks"
    ).split()], F.count_if(F.col("leaks") > 0).alias("leak_cases"), F.count(F.lit(1)).alias("cases"))
    ratio = lambda n, d, empty: F.round(F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(d)), empty), 6)
    none_expected = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(0.0)
    one, zero = F.lit(1.0), F.lit(0.0)
    return s.select(
        "cases", "leaks", ratio("leak_cases", "cases", zero).alias("forbidden_rate"), ratio("misattributed", "speaker_predicted", zero).alias("misattribution_rate"), ratio("speaker_correct", "speaker_predicted", one).alias("speaker_accuracy"),
        ratio("typed_correct", "typed_predicted", none_expected("typed_expected")).alias("typed_precision"), ratio("typed_complete", "typed_expected", one).alias("typed_recall"), ratio("silent", "typed_expected", zero).alias("silent_demotion_rate"),
        ratio("incidental_matched", "incidental_expected", one).alias("incidental_recall"), ratio("incidental_matched", "incidental_predicted", none_expected("incidental_expected")).alias("incidental_precision"),
    )


def capture_gate(metrics: DataFrame, bars: dict[str, float] = CAPTURE_BARS) -> DataFrame:
    """(ship, failed): whether automatic capture may go out, and the checks that stand against it."""
    over = [F.when((F.col("forbidden_rate") > bars["forbidden_rate"]) | (F.col("leaks") > 0), "forbidden_assistant_tool"), F.when(F.col("misattribution_rate") > bars["misattribution_rate"], "speaker_attribution")]
    under = [("typed_precision", "typed_slot_precision"), ("silent_demotion_rate", "silent_demotion"), ("typed_recall", "typed_slot_completeness"), ("incidental_recall", "incidental_durable_recall"), ("incidental_precision", "incidental_durable_precision")]
    checks = over + [F.when(F.col(c) > bars[c] if c == "silent_demotion_rate" else F.col(c) < bars[c], name) for c, name in under]
    failed = F.array_compact(F.array(*checks))
    return metrics.select((F.size(failed) == 0).alias("ship"), F.array_join(failed, ",").alias("failed"))


def latency_percentiles(runs: DataFrame, by: str, value: str, shares=(0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles of whole numbers by group; a group without values is missing."""
    return runs.where(F.col(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("runs"), *[F.expr(f"cast(percentile_disc({s}) within group (order by {value}) as long)").alias(f"p{round(s * 100)}") for s in shares])


# ---- personal cases -----------------------------------------------------------------------------

def _matches(text: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: F.regexp(text, F.concat(F.lit("(?i)"), p)))


def case_ranks(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """(case_id, expected_rank, forbidden_rank): the first ranks of an expected and of a forbidden fact, by identifier or pattern.

    ``cases``: case_id, expected_ids, expected_patterns, forbidden_patterns;
    ``ranked``: case_id, rank, fact_id, content.
    """
    r = ranked.join(cases, "case_id")
    text = F.coalesce("content", F.lit(""))
    good = F.array_contains("expected_ids", F.col("fact_id")) | _matches(text, F.col("expected_patterns"))
    g = r.groupBy("case_id").agg(F.min(F.when(good, F.col("rank"))).alias("expected_rank"), F.min(F.when(_matches(text, F.col("forbidden_patterns")), F.col("rank"))).alias("forbidden_rank"))
    return cases.select("case_id").join(g, "case_id", "left")


def case_problems(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, problem): cases that no eligible fact of their category can satisfy, or only one that is forbidden as well.

    A case's patterns are looked for in the facts of its category, so this is a
    scan per case by nature; the case file is small and is broadcast by its size.
    """
    from .eligibility import active

    f = facts.where(active() & (F.col("scope") == "private") & (F.col("trust_score") >= 0.3)).select("category", "fact_id", F.coalesce("content", F.lit("")).alias("content"))
    c = cases.where("not should_abstain")
    r = c.join(f, "category")
    good = F.array_contains("expected_ids", F.col("fact_id")) | _matches(F.col("content"), F.col("expected_patterns"))
    bad = _matches(F.col("content"), F.col("forbidden_patterns"))
    g = r.groupBy("case_id").agg(F.max((good & ~bad).cast("int")).alias("ok"), F.max((good & bad).cast("int")).alias("both"))
    out = c.select("case_id").join(g, "case_id", "left")
    return out.where("coalesce(ok, 0) = 0").select("case_id", F.when(F.col("both") == 1, "expected also matches a forbidden pattern").otherwise("expected is no active private fact of the category").alias("problem"))


def personal_summary(results: DataFrame) -> DataFrame:
    """Per category and in total: recall at 1 and 3, stale leaks, abstention. ``results``: category, should_abstain, abstained, protected, expected_rank, forbidden_rank."""
    p = ~F.col("should_abstain")
    hit = lambda k: p & ~F.col("abstained") & F.coalesce(F.col("expected_rank") <= k, F.lit(False))
    r = results.rollup("category").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(p).alias("_p"), F.count_if(hit(1)).alias("_h1"), F.count_if(hit(3)).alias("_h3"), F.count_if(F.col("protected")).alias("_q"),
        F.count_if(F.col("protected") & F.coalesce(F.col("forbidden_rank") <= 3, F.lit(False))).alias("_l"), F.count_if(~p).alias("_n"), F.count_if(~p & F.col("abstained")).alias("_a"), F.count_if(p & F.col("abstained")).alias("false_abstentions"),
    )
    return r.select(
        F.coalesce("category", F.lit("(all)")).alias("category"), "cases", _rate(F.col("_h1"), F.col("_p")).alias("recall_1"), _rate(F.col("_h3"), F.col("_p")).alias("recall_3"), _rate(F.col("_l"), F.col("_q")).alias("stale_leak_rate"),
        _rate(F.col("_a"), F.col("_n")).alias("abstention_correctness"), "false_abstentions",
    )


# ---- conflicts, evidence, decisions -------------------------------------------------------------

def conflict_search(facts: DataFrame, queries: DataFrame, limit: int = 10, min_trust: float = 0.3) -> DataFrame:
    """(query_id, conflict_group, fact_id, score, rank): members of open conflicts by the share of the query's tokens they hold."""
    from ..functions.text import token_set

    q = queries.select("query_id", token_set(F.col("query")).alias("q")).select("query_id", F.size("q").alias("n"), F.explode("q").alias("t"))
    m = facts.where(F.col("conflict_group").isNotNull() & F.col("invalid_at").isNull() & F.col("superseded_by").isNull() & (F.col("trust_score") >= min_trust)).select("fact_id", "conflict_group", F.explode(token_set(F.col("content"))).alias("t"))
    g = m.join(q, "t").groupBy("query_id", "conflict_group", "fact_id", "n").agg(F.count(F.lit(1)).alias("hit"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "fact_id")
    return g.select("query_id", "conflict_group", "fact_id", F.round(F.col("hit") / F.col("n"), 6).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def located_turns(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """(case_id, item_no, turn): the one turn that holds a fact's excerpt; of several, the one of its role; without an excerpt, the one turn of its role.

    ``facts``: case_id, item_no, excerpt, role; ``turns``: case_id, turn, role, content.
    """
    t = turns.select("case_id", "turn", F.col("role").alias("_role"), "content")
    r = facts.join(t, "case_id")
    said = F.coalesce(F.col("excerpt") != "", F.lit(False))
    hit, same = F.when(said, F.contains("content", F.col("excerpt"))).otherwise(F.lit(False)), F.col("_role").eqNullSafe(F.col("role")) & F.col("role").isNotNull()
    g = r.groupBy("case_id", "item_no").agg(
        F.max(said).alias("said"), F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("turn"))).alias("one"), F.count_if(hit & same).alias("rn"), F.min(F.when(hit & same, F.col("turn"))).alias("rone"),
        F.count_if(same).alias("sn"), F.min(F.when(same, F.col("turn"))).alias("sone"),
    )
    found = F.when(F.col("said") & (F.col("n") == 1), F.col("one")).when(F.col("said") & (F.col("rn") == 1), F.col("rone")).when(~F.col("said") & (F.col("sn") == 1), F.col("sone"))
    return facts.select("case_id", "item_no").join(g.select("case_id", "item_no", found.alias("turn")), ["case_id", "item_no"], "left")


def compatible_evidence(predicted: DataFrame, spans: DataFrame) -> DataFrame:
    """(case_id, item_no, compatible): whether a predicted excerpt (start, stop) lies within one span (lo, hi) of its case."""
    r = predicted.join(spans.select("case_id", "lo", "hi"), "case_id", "left")
    return r.groupBy("case_id", "item_no").agg(F.coalesce(F.max((F.col("start") >= F.col("lo")) & (F.col("stop") <= F.col("hi"))), F.lit(False)).alias("compatible"))


def write_decisions(outcomes: DataFrame) -> DataFrame:
    """(case_id, decision): the one outcome of a case's writes, none without writes, mixed for several."""
    said = F.array_distinct(F.collect_list(F.when(F.col("outcome").isin("inserted", "add"), "add").when(F.col("outcome").isin("existing", "dedup"), "dedup").otherwise(F.col("outcome"))))
    g = outcomes.groupBy("case_id").agg(said.alias("x"))
    return g.select("case_id", F.when(F.size("x") == 0, "none").when(F.size("x") == 1, F.col("x")[0]).otherwise("mixed").alias("decision"))


def decision_accuracy(cases: DataFrame) -> DataFrame:
    """(decision, cases, correct, accuracy): by expected decision and in total. ``cases``: expected, decision."""
    r = cases.rollup("expected").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("expected") == F.col("decision")).alias("correct"))
    return r.select(F.coalesce("expected", F.lit("(all)")).alias("decision"), "cases", "correct", _rate(F.col("correct"), F.col("cases")).alias("accuracy"))


def arena_tables(arena: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, members) of an arena (facts array<struct<fact_id, content, category, trust_score>>, conflicts array<struct<conflict_id, fact_ids>>).

    Repeated fact identifiers, and conflicts of fewer than two or of unknown facts, raise.
    """
    f = arena.select(F.explode("facts").alias("x")).select("x.*")
    n = F.count(F.lit(1)).over(Window.partitionBy("fact_id"))
    f = f.withColumn("_n", n).withColumn("fact_id", F.when(F.col("_n") == 1, F.col("fact_id")).otherwise(F.raise_error(F.lit("fact identifiers must be unique")).cast("long"))).drop("_n")
    c = arena.select(F.explode("conflicts").alias("x")).select("x.conflict_id", F.size("x.fact_ids").alias("n"), F.explode("x.fact_ids").alias("fact_id"))
    known = c.join(f.select("fact_id", F.lit(True).alias("_is")), "fact_id", "left")
    sound = F.col("_is").isNotNull() & (F.col("n") >= 2)
    return f, known.select(F.when(sound, F.col("conflict_id")).otherwise(F.raise_error(F.lit("a conflict needs two known facts")).cast("string")).alias("conflict_id"), "fact_id")


# ---- tuning -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Trial:
    """What a configuration scores on the tuning cases."""

    recall_1: float
    leaks_1: int
    p95_ms: float


def better(new: Trial, best: Trial, baseline: Trial) -> tuple[bool, str]:
    """Whether a trial replaces the best one: never with more leaks than the baseline; then recall, leaks, time."""
    if new.leaks_1 > baseline.leaks_1:
        return False, "more stale leaks than the baseline"
    for a, b, what in ((new.recall_1, best.recall_1, "recall"), (-new.leaks_1, -best.leaks_1, "stale leaks"), (-new.p95_ms, -best.p95_ms, "time")):
        if a != b:
            return a > b, f"{what} {'improved' if a > b else 'regressed'}"
    return False, "nothing improved"


def neighbour(config: dict[str, float], knobs: dict[str, tuple[float, float, float]], rng: random.Random) -> tuple[str, dict[str, float]]:
    """(knob, configuration): one knob (least, most, step) moved by a step; relevance weights are brought back to a sum of 1."""
    name = rng.choice(sorted(knobs))
    low, high, step = knobs[name]
    moved = min(high, max(low, config[name] + rng.choice((-step, step))))
    return name, rescaled({**config, name: moved}, name)


def rescaled(config: dict[str, float], fixed: str, weights=("fts", "jaccard", "dense")) -> dict[str, float]:
    """The relevance weights summing to 1 with one of them fixed; the others keep their proportion."""
    if fixed not in weights:
        return config
    rest = [w for w in weights if w != fixed]
    total = sum(config[w] for w in rest)
    left = 1.0 - config[fixed]
    return config | {w: left / len(rest) if math.isclose(total, 0.0) else config[w] * left / total for w in rest}


def tuned(evaluate: Callable[[dict[str, float]], Trial], config: dict[str, float], knobs: dict[str, tuple[float, float, float]], trials: int, seed: int = 0) -> tuple[dict[str, float], list[dict]]:
    """(best configuration, log): a hill climb over single steps of knobs; ``evaluate`` runs a whole batch of cases as one job."""
    rng = random.Random(seed)
    baseline = best_score = evaluate(config)
    best, log = dict(config), [{"trial": 0, "knob": None, "accepted": True, "why": "baseline", "score": baseline}]
    for t in range(1, trials + 1):
        knob, candidate = neighbour(best, knobs, rng)
        score = evaluate(candidate)
        good, why = better(score, best_score, baseline)
        log.append({"trial": t, "knob": knob, "accepted": good, "why": why, "score": score})
        if good:
            best, best_score = candidate, score
    return best, log
