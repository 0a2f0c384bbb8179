"""The queries of the training-data problems tagged llm, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def _texts(spark: SparkSession, sf: str):
    from .pii import lexicon, sources

    texts = sources(table(spark, sf, "facts"), table(spark, sf, "observations"), table(spark, sf, "transcript_gate_gold"))
    return texts, lexicon(table(spark, sf, "entities"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct mention of personal information in each text."""
    from .pii import found

    return found(*_texts(spark, sf))


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with typed placeholders."""
    from .pii import redacted

    return redacted(*_texts(spark, sf))


def _key(spark: SparkSession) -> str:
    """The session's secret; without one, a word that only shows how the queries work."""
    return spark.conf.get("spark.factloom.pii.key", None) or "demonstration"


def p1_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct mention with its surrogate."""
    from .pii import genders, mentions, surrogates

    texts, lex = _texts(spark, sf)
    return surrogates(mentions(texts, lex), lex, _key(spark), genders(texts, lex))


def p1_pseudonymised(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with surrogates."""
    from .pii import pseudonymised

    return pseudonymised(*_texts(spark, sf), _key(spark))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every member but the first of a group of facts with alike contents."""
    from .neardup import alike, group_members

    return group_members(alike(table(spark, sf, "facts")))


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every class of equal word sets that has a link, with its group and its number of links."""
    from .neardup import alike

    parts = alike(table(spark, sf, "facts"))
    ends = parts["pairs"].select(F.explode(F.array("a", "b")).alias("fact_id")).groupBy("fact_id").agg(F.count(F.lit(1)).alias("links"))
    return ends.join(parts["roots"], F.col("fact_id") == F.col("node")).select("fact_id", F.col("root").alias("group_id"), "links")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every copy but the first of its set."""
    from .canonical import copies

    _, members = copies(table(spark, sf, "facts"))
    return members.where("fact_id != first").select(F.col("first").alias("first_fact_id"), "fact_id")


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every set's representative and number of copies."""
    from .canonical import copies

    sets, _ = copies(table(spark, sf, "facts"))
    return sets.select(F.col("first").alias("first_fact_id"), "copies")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of facts with very similar vectors, found among each other's five nearest."""
    from .knn import near_pairs

    return near_pairs(table(spark, sf, "fact_embeddings"))


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar vectors of each vector whose fact_id is divisible by 20, against all."""
    from .knn import searched

    n = searched(table(spark, sf, "fact_embeddings"))
    return n.select(F.col("identity").alias("embedding_identity"), F.col("id").alias("fact_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 5).alias("cosine"), "rank")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Survivor, newest member and merged tags of every set of copies."""
    from .canonical import copies
    from .survivor import survivors

    facts = table(spark, sf, "facts")
    return survivors(copies(facts)[1], facts)


def p6_golden(spark: SparkSession, sf: str) -> DataFrame:
    """The best value of each descriptive field of every set of copies."""
    from .canonical import copies
    from .survivor import golden

    facts = table(spark, sf, "facts")
    return golden(copies(facts)[1], facts)


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's token ids."""
    from .encode import token_ids

    return token_ids(table(spark, sf, "documents"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens."""
    from .encode import token_counts
    from .packing import pack

    return pack(token_counts(table(spark, sf, "documents")), "doc_id", "n_tokens")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are."""
    from .packing import fill_report

    return fill_report(p8_packed(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every document but the first of a set that looks the same."""
    from .confusables import look_alikes

    _, members = look_alikes(table(spark, sf, "documents"))
    return members.where("doc_id != first").select(F.col("first").alias("first_doc_id"), "doc_id")


def p9_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in its consistent form."""
    from .confusables import consistent

    return consistent(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p1_surrogates, p1_pseudonymised, p2_found, p2_links, p4_counts, p4_found, p5_found, p5_neighbours, p6_found, p6_golden, p7_ids, p8_packed, p8_fill, p9_found, p9_forms)}
ORACLE: dict[str, str] = {}
