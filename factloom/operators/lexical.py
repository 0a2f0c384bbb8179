"""Inverted index and BM25 for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_set, tokens
from ..runtime import Cut, spread
from .best import B, IDF_FLOOR, K1, best

#: So many (query, token) rows may be broadcast.
BROADCAST_TOKENS = 1_000_000


def indexed_text() -> Column:
    """What the index covers: content and tags."""
    return F.concat_ws(" ", "content", "tags")


def postings(facts: DataFrame, text: Column | None = None) -> DataFrame:
    """(fact_id, token, tf, dl) of every fact, retired ones included: statistics cover the whole index."""
    t = tokens(indexed_text() if text is None else text)
    rows = facts.select("fact_id", t.alias("t")).select("fact_id", F.size("t").alias("dl"), F.explode("t").alias("token"))
    return rows.groupBy("fact_id", "token", "dl").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(facts: DataFrame) -> DataFrame:
    """(token, df), combined map-side on the distinct tokens of each fact."""
    return facts.select(F.explode(token_set(indexed_text())).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token) of (query_id, query)."""
    return queries.select("query_id", F.explode(token_set(F.col("query"))).alias("token"))


def scored(facts: DataFrame, queries: DataFrame, keep: Column | None = None) -> DataFrame:
    """(query_id, fact_id, bm25, jaccard, coverage): kept facts that share an indexed token with the query.

    Higher is better throughout. The statistics of BM25 cover all facts; overlap
    and coverage look at contents only. One join by token serves all three. Only
    postings of query tokens go on to it. Postings are placed by fact once, so
    that counting them and adding them up per query needs no further shuffle as
    long as the query tokens, whose number is looked at first, can be broadcast;
    more are joined by a shuffle.
    """
    cut = Cut(facts.sparkSession, "bm25")
    q = queries.select("query_id", token_set(F.col("query")).alias("q")).select("query_id", F.size("q").alias("qn"), F.explode("q").alias("token"))
    q = cut(q, "queries")
    small = F.broadcast if q.count() <= BROADCAST_TOKENS else lambda df: df
    wanted = small(q.select("token").distinct())
    lists = facts.select("fact_id", (F.lit(True) if keep is None else keep).alias("keep"), tokens(F.col("content")).alias("t"), tokens(F.col("tags")).alias("g"))
    lists = cut(spread(lists), "lists")  # texts are tokenised once, not once per use
    stats = lists.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t") + F.size("g")).alias("avgdl"))
    distinct = lists.select(F.explode(F.array_distinct(F.concat("t", "g"))).alias("token")).join(wanted, "token", "left_semi")
    df = distinct.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    said = F.concat(F.transform("t", lambda x: F.struct(x.alias("token"), F.lit(1).alias("inside"))), F.transform("g", lambda x: F.struct(x.alias("token"), F.lit(0).alias("inside"))))
    kept = lists.where("keep").select("fact_id", (F.size("t") + F.size("g")).alias("dl"), F.size(F.array_distinct("t")).alias("dn"), F.explode(said).alias("s"))
    hits = kept.select("fact_id", "dl", "dn", "s.token", "s.inside").join(wanted, "token", "left_semi").repartition("fact_id")
    p = hits.groupBy("fact_id", "token", "dl", "dn").agg(F.count(F.lit(1)).alias("tf"), F.max("inside").alias("inside"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weights = p.join(small(df), "token").join(F.broadcast(stats)).select("fact_id", "token", "dn", "inside", weight.alias("w"))
    g = weights.join(small(q), "token").groupBy("query_id", "fact_id").agg(F.sum("w").alias("bm25"), F.sum("inside").alias("both"), F.max("qn").alias("qn"), F.max("dn").alias("dn"))
    return g.select("query_id", "fact_id", "bm25", (F.col("both") / (F.col("qn") + F.col("dn") - F.col("both"))).alias("jaccard"), (F.col("both") / F.col("qn")).alias("coverage"))


def bm25(facts: DataFrame, queries: DataFrame, keep: Column | None = None) -> DataFrame:
    """(query_id, fact_id, bm25) of ``scored``."""
    return scored(facts, queries, keep).select("query_id", "fact_id", "bm25")


def top(scored: DataFrame, score: str, k: int, by: str = "query_id") -> DataFrame:
    """The best ``k`` per query with their rank; ties to the greater identifier, as the index returns them."""
    w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col("fact_id").desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_top(facts: DataFrame, queries: DataFrame, keep: Column | None, k: int) -> DataFrame:
    """(query_id, fact_id, bm25, rank): ``top`` of ``bm25``, without a table of all pairs."""
    return top(best(facts, queries, k, keep), "bm25", k)


def all_tokens(facts: DataFrame, queries: DataFrame, keep: Column | None = None) -> DataFrame:
    """(query_id, fact_id): facts that hold every token of the query."""
    q = query_tokens(queries)
    need = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    rows = facts if keep is None else facts.where(keep)
    p = rows.select("fact_id", F.explode(token_set(indexed_text())).alias("token")).join(q, "token")
    return p.groupBy("query_id", "fact_id").agg(F.count(F.lit(1)).alias("have")).join(need, "query_id").where("have = need").select("query_id", "fact_id")


def most_trusted(hits: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """(query_id, fact_id, rank): the ``k`` most trusted hits of each query; ties to the smaller identifier."""
    w = Window.partitionBy("query_id").orderBy(F.coalesce("trust_score", F.lit(0.0)).desc(), "fact_id")
    r = hits.join(facts.select("fact_id", "trust_score"), "fact_id").withColumn("rank", F.row_number().over(w))
    return r.where(F.col("rank") <= k).select("query_id", "fact_id", "rank")


def overlap(facts: DataFrame, queries: DataFrame, least: float = 0.0) -> DataFrame:
    """(query_id, fact_id, jaccard, coverage) of facts that share a token with the query, by a token join."""
    docs = facts.select("fact_id", token_set(F.col("content")).alias("d"))
    q = queries.select("query_id", token_set(F.col("query")).alias("q"))
    shared = docs.select("fact_id", F.size("d").alias("dn"), F.explode("d").alias("token")).join(q.select("query_id", F.size("q").alias("qn"), F.explode("q").alias("token")), "token")
    g = shared.groupBy("query_id", "fact_id").agg(F.count(F.lit(1)).alias("both"), F.max("qn").alias("qn"), F.max("dn").alias("dn"))
    out = g.select("query_id", "fact_id", (F.col("both") / (F.col("qn") + F.col("dn") - F.col("both"))).alias("jaccard"), (F.col("both") / F.col("qn")).alias("coverage"))
    return out.where(F.col("jaccard") >= least)
