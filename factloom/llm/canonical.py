"""Problem 4: copies that differ only in white space, case, punctuation or field order.

Two keys per content, both 128 bits wide:

* the sequence of its words;
* for a list of at least two fields (``name: value`` or ``name=value``, in
  JSON, lines, semicolons, bars, slashes or commas), the sorted list of
  (name, words of the value).

Contents are copies if either key agrees. The field key of a sequence, where
it has one, stands for the sequence, so that a list and the same words without
its punctuation meet. A sequence that parses to several field lists joins them;
such links are closed transitively over both halves of the keys.

Defined cases: null contents and contents without a word belong to no set;
repeated rows of one fact_id count once; extra columns are ignored; an empty
table gives an empty result; a tie for the representative cannot occur, as
identifiers are distinct. Texts are used whole, at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..runtime import Cut
from .collapse import groups
from .words import NO_WORD, WORD, fold, key128

#: Pieces of a field list end at a semicolon, bar, line end or spaced slash, or at a comma before the next field.
_CUT = r"[;|\n\r]+| [-/–—·•] |,(?=[\s\"'{\[(]*[\p{L}_][\p{L}\p{N}_ -]{0,40}[\"']?\s*[:=])"
_FIELD = r"^[^\p{L}\p{N}:=]*[\p{L}_][\p{L}\p{N}_ -]*[\"']?\s*[:=](?s:.*)$"
_NAME = r"^([^:=]*)[:=]"
_REST = r"^[^:=]*[:=]((?s).*)$"


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, NO_WORD, " "))


def keyed(facts: DataFrame, ident: str = "fact_id", text: str = "content") -> DataFrame:
    """(ident, s1, s2, f1, f2): the keys of every content with a word; f null if it is no field list."""
    t = facts.select(F.col(ident), fold(F.col(text)).alias("_t")).where(F.col("_t").rlike(WORD))
    t = t.withColumn("_seq", _words(F.col("_t")))
    pieces = F.filter(F.split(F.col("_t"), _CUT), lambda p: p.rlike(WORD))
    t = t.withColumn("_p", F.when(F.col("_t").rlike("[:=]"), pieces))
    is_list = (F.size("_p") >= 2) & F.forall("_p", lambda p: p.rlike(_FIELD))
    fields = F.array_sort(
        F.transform("_p", lambda p: F.concat(_words(F.regexp_extract(p, _NAME, 1)), F.lit("\u0001"), _words(F.regexp_extract(p, _REST, 1))))
    )
    t = t.withColumn("_f", F.when(is_list, F.array_join(fields, "\u0002")))
    (s1, s2), (f1, f2) = key128(F.col("_seq")), key128(F.col("_f"))
    is_null = F.col("_f").isNull()
    return t.select(
        ident, s1.alias("s1"), s2.alias("s2"), F.when(~is_null, f1).alias("f1"), F.when(~is_null, f2).alias("f2")
    )


def copies(facts: DataFrame, ident: str = "fact_id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(sets: first, copies; members: first, ident) of all sets of at least two copies."""
    spark = facts.sparkSession
    cut = Cut(spark, "copies")
    rows = cut(keyed(facts.select(ident, text), ident, text).dropDuplicates([ident]), "keys")
    total = rows.count()
    lists = rows.where(F.col("f1").isNotNull()).select("s1", "s2", "f1", "f2").distinct()
    by_seq = cut(lists.groupBy("s1", "s2").agg(F.min(F.struct("f1", "f2")).alias("f")), "lists")
    out = rows.drop("f1", "f2").join(by_seq, ["s1", "s2"], "left").select(ident, F.coalesce("f.f1", "s1").alias("f1"), F.coalesce("f.f2", "s2").alias("f2"))
    key = F.struct(F.col("f1"), F.col("f2"))
    links = lists.join(by_seq, ["s1", "s2"]).select(F.col("f").alias("a"), key.alias("b")).where("a != b")
    if not links.isEmpty():
        roots = components(links, "a", "b").select(F.col("node").alias("_k"), F.col("root").alias("_r"))
        keyed_out = out.withColumn("_k", key).join(roots, "_k", "left").withColumn("_k", F.coalesce("_r", "_k"))
        out = keyed_out.select(ident, F.col("_k.f1").alias("f1"), F.col("_k.f2").alias("f2"))
    return groups(out, ["f1", "f2"], ident, total)
