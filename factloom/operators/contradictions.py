"""Restatements and contradictions between untyped claims, over lossless blocks.

Each way two claims can clash demands that something be equal on both sides,
and that is the join key: the set of claim tokens left without polarity words,
the content tokens left without values and states, or the first two tokens.
Pairs that meet in several blocks are made distinct after the exact test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STATE_GROUPS, STEM_SUFFIXES, content_tokens, jaccard, negated, negated_of, opposing_states, plain_of, states_of, stemmed, subjectish, token_set, tokens, value_tokens, values_of, words_array, words_of
from ..runtime import Cut, ship, spread
from .eligibility import active

# Words that frame a claim about a value, plain copulas among them, and polarity words outside the residue.
FRAMES = "is are was were uses use used using prefers prefer preferred runs run running".split()
COPULAS = ("is", "are", "was", "were")
RESIDUE_NEGATIONS = ("never", "without")
PREFIX = 2


def _residue(subj: Column) -> Column:
    """Sorted claim tokens without polarity words, each collapsed to a stem that is there as well."""
    pool = F.array_except(subj, words_array(RESIDUE_NEGATIONS))

    def collapse(t: Column) -> Column:
        stems = [F.when(t.endswith(x) & (F.length(t) > len(x) + 2), F.substring(t, F.lit(1), F.length(t) - len(x))) for x in STEM_SUFFIXES]
        return F.coalesce(*[F.when(F.array_contains(subj, s), s) for s in stems], t)

    return F.sort_array(F.array_distinct(F.transform(pool, collapse)))


def claims(rows: DataFrame, cut: Cut, text: str = "content") -> DataFrame:
    """The rows with what the tests below look at: tokens, values, states, stems, residue, frame.

    A text is split once and each column is made from the one before. Written
    once per text, so that pairs compare stored arrays and nothing is tokenised
    per pair.
    """
    r = spread(rows).withColumn("tok", tokens(F.col(text)))
    t = F.col("tok")
    r = r.withColumns({"val": values_of(t), "words": words_of(t), "neg": negated_of(t), "framed": F.arrays_overlap(F.array_distinct(t), words_array(FRAMES))})
    r = r.withColumns({"states": states_of(F.col("words")), "_base": plain_of(F.col("words"))}).withColumn("subj", stemmed(F.col("_base")))
    kept = F.sort_array(F.array_except(F.array_except("words", "val"), "states"))
    return cut(r.withColumns({"residue": _residue(F.col("subj")), "frame": kept}).drop("words", "_base"), "claims")


def _of(side: str):
    return lambda c: F.col(f"{side}.{c}")


def suffix_swap(a: str, b: str) -> Column:
    """The claims share a frame of leading tokens and differ wholly behind it."""
    x, y = _of(a), _of(b)
    same = F.zip_with(x("tok"), y("tok"), lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, False)
    n = F.when(first == 0, F.least(F.size(x("tok")), F.size(y("tok")))).otherwise(first - 1).cast("int")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    rest_a, rest_b = rest(x("tok")), rest(y("tok"))
    frames, verbs = words_array(FRAMES), words_array(w for w in FRAMES if w not in COPULAS)
    both = (F.size(rest_a) > 0) & (F.size(rest_b) > 0) & ~F.arrays_overlap(rest_a, rest_b) & ~F.arrays_overlap(rest_a, frames) & ~F.arrays_overlap(rest_b, frames)
    digits = F.forall(F.concat(rest_a, rest_b), lambda t: t.rlike("[0-9]"))
    return (n >= PREFIX) & both & ((n >= 3) | F.arrays_overlap(F.slice(x("tok"), F.lit(1), n), verbs) | digits) & F.arrays_overlap(x("subj"), y("subj"))


def polarity_change(a: str, b: str) -> Column:
    x, y = _of(a), _of(b)
    return F.arrays_overlap(x("subj"), y("subj")) & (opposing_states(x("states"), y("states")) | (x("neg") != y("neg")))


def value_update(a: str, b: str) -> Column:
    """One claim gives the other's subject a new value or the opposite polarity."""
    x, y = _of(a), _of(b)
    plain = (x("val") == y("val")) | (F.size(x("val")) == 0) | (F.size(y("val")) == 0)
    return F.when(plain, polarity_change(a, b)).otherwise(x("frame") == y("frame"))


def contradicts(a: str, b: str) -> Column:
    """Opposite polarity of one claim, or a swapped value in a framed claim."""
    x, y = _of(a), _of(b)
    swapped = x("framed") & y("framed") & (value_update(a, b) | suffix_swap(a, b))
    return F.when(polarity_change(a, b), (F.size(x("residue")) > 0) & (x("residue") == y("residue"))).otherwise(swapped)


def contradiction_pairs(facts: DataFrame) -> DataFrame:
    """(newer, older): untyped active claims of one scope that contradict each other."""
    rows = facts.where(active() & F.col("content").isNotNull() & (F.col("memory_kind").isNull() | (F.col("memory_kind") != "state"))).select("fact_id", "scope", "content")
    cut = Cut(facts.sparkSession, "claims")
    c = claims(rows, cut).drop("content")
    # a swap behind three common tokens needs no more; behind two it needs a verb among them or values only; no frame
    # word may follow what is common, so the last one lies within it, at the same place on both sides
    verbs, frames = words_array(w for w in FRAMES if w not in COPULAS), words_array(FRAMES)
    short = F.arrays_overlap(F.slice("tok", 1, PREFIX), verbs) | F.forall(F.slice(F.col("tok"), F.lit(PREFIX + 1), F.greatest(F.size("tok") - PREFIX, F.lit(0))), lambda t: t.rlike("[0-9]"))
    last = F.array_max(F.transform("tok", lambda t, i: F.when(F.array_contains(frames, t), i + 1).otherwise(0)))
    common = F.greatest(last, F.lit(PREFIX + 1))
    keys = F.array(
        F.when(F.size("residue") > 0, F.xxhash64(F.lit(1), "residue")), F.when(F.col("framed"), F.xxhash64(F.lit(2), "frame")),
        F.when(F.col("framed") & (F.size("tok") > common), F.xxhash64(F.lit(3), F.slice(F.col("tok"), F.lit(1), common))),
        F.when(F.col("framed") & (F.size("tok") > PREFIX) & (last <= PREFIX) & short, F.xxhash64(F.lit(4), F.slice("tok", 1, PREFIX))),
    )
    # claims of one residue or frame meet by their keys; of those with a common prefix only the ones that differ wholly
    # behind it, which is found block by block; claims that meet no other one are not sent
    at = cut(c.select("fact_id", "scope", F.posexplode(keys).alias("kind", "k")).where("k is not null"), "keys")
    crowded = at.groupBy("scope", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and scope is not null").select("scope", "k")
    at = at.join(crowded, ["scope", "k"], "left_semi")
    x, y = at.where("kind < 2").alias("a"), at.where("kind < 2").alias("b")
    same = x.join(y, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fact_id") > F.col("b.fact_id")))
    same = same.select(F.col("a.fact_id").alias("newer"), F.col("b.fact_id").alias("older"))
    swaps = at.where("kind >= 2").select("fact_id", "scope", "k").join(c.select("fact_id", "tok"), "fact_id")
    ship(facts.sparkSession)
    swaps = swaps.groupBy("scope", "k").applyInPandas(apart, "newer long, older long")
    met = cut(same.unionByName(swaps).distinct(), "met")
    wide = c.drop("scope").join(met.select(F.explode(F.array("newer", "older")).alias("fact_id")).distinct(), "fact_id", "left_semi")
    side = lambda n, alias: wide.withColumnRenamed("fact_id", n).alias(alias)
    r = met.join(side("newer", "a"), "newer").join(side("older", "b"), "older")
    return r.where(contradicts("a", "b")).select("newer", "older").distinct()


def apart(rows):
    """(newer, older): pairs of rows (fact_id, tok) that share no token behind their common prefix.

    Rows are parted by their next token, level by level: two that part at a
    level have all before it in common. The most frequent tokens are bits of a
    mask, so most pairs are discarded by one comparison.
    """
    from collections import Counter

    import numpy as np
    import pandas as pd

    ids, tok = rows["fact_id"].to_numpy(), [list(t) for t in rows["tok"]]
    newer, older = [], []
    stack = [(np.arange(len(ids)), 0)]
    while stack:
        mine, c = stack.pop()
        mine = np.array([i for i in mine.tolist() if len(tok[i]) > c], np.int64)
        if len(mine) < 2:
            continue
        parts: dict[str, list[int]] = {}
        for i in mine.tolist():
            parts.setdefault(tok[i][c], []).append(i)
        stack += [(np.array(p), c + 1) for p in parts.values() if len(p) > 1]
        if len(parts) < 2:
            continue
        rest = {i: frozenset(tok[i][c:]) for i in mine.tolist()}
        bit = {t: 1 << n for n, (t, _) in enumerate(Counter(t for r in rest.values() for t in r).most_common(63))}
        mask = np.array([sum(bit.get(t, 0) for t in rest[i]) for i in mine.tolist()], np.int64)
        number = {t: n for n, t in enumerate(parts)}
        part = np.array([number[tok[i][c]] for i in mine.tolist()])
        for n, i in enumerate(mine.tolist()):
            for j in mine[n + 1 :][((mask[n + 1 :] & mask[n]) == 0) & (part[n + 1 :] != part[n])].tolist():
                if rest[i].isdisjoint(rest[j]) and ids[i] != ids[j]:
                    newer.append(max(ids[i], ids[j]))
                    older.append(min(ids[i], ids[j]))
    return pd.DataFrame({"newer": np.array(newer, np.int64), "older": np.array(older, np.int64)})


def value_update_pairs(facts: DataFrame, block: str = "subject_key") -> DataFrame:
    """(newer, older): facts of one scope and block where the newer updates the older's value.

    A value changes only within one frame, and polarity only between a negated
    and a plain claim or between two that name a state of one group. So rows
    meet by frame, across polarity, and by group of states; two plain claims
    that share no frame never do.
    """
    rows = facts.where(active() & F.col("content").isNotNull() & F.col(block).isNotNull()).select("fact_id", "scope", F.col(block).alias("k"), "content")
    c = claims(rows, Cut(facts.sparkSession, "claims")).drop("content")
    same = (F.col("a.scope") == F.col("b.scope")) & (F.col("a.k") == F.col("b.k"))
    framed = c.where(F.size("val") > 0).withColumn("_f", F.xxhash64("frame"))
    groups = F.array_compact(F.array(*[F.when(F.arrays_overlap("states", words_array(g)), F.lit(i)) for i, g in enumerate(STATE_GROUPS)]))
    stated = c.where(F.size("states") > 0).withColumn("_f", F.explode(groups))
    parts = [framed.alias("a").join(framed.alias("b"), same & (F.col("a._f") == F.col("b._f"))), stated.alias("a").join(stated.alias("b"), same & (F.col("a._f") == F.col("b._f"))), c.where("neg").alias("a").join(c.where("not neg").alias("b"), same)]
    out = None
    for met in parts:
        met = met.where((F.col("a.fact_id") != F.col("b.fact_id")) & value_update("a", "b")).select(F.greatest("a.fact_id", "b.fact_id").alias("newer"), F.least("a.fact_id", "b.fact_id").alias("older"))
        out = met if out is None else out.unionByName(met)
    return out.distinct()


def restatements(facts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(newer, older): every active fact that restates an earlier one of its scope, with the earliest such.

    Restated facts agree in values, content words and polarity, and their token
    sets are close. Facts of equal token sets are one class, so copies never
    meet each other; only classes do.
    """
    text = F.col("content")
    k = F.xxhash64(F.sort_array(content_tokens(text)), value_tokens(text), negated(text))
    t = F.sort_array(token_set(text))
    rows = facts.where(active() & text.isNotNull()).select("fact_id", "scope", k.alias("k"), F.xxhash64(t).alias("c"), t.alias("t")).where(F.size("t") > 0)
    classes = rows.groupBy("scope", "k", "c").agg(F.min("fact_id").alias("first"), F.first("t").alias("t"))
    a, b = classes.alias("a"), classes.alias("b")
    met = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.first") > F.col("b.first")))
    near = met.where(jaccard(F.col("a.t"), F.col("b.t")) >= threshold).groupBy(F.col("a.scope").alias("scope"), F.col("a.k").alias("k"), F.col("a.c").alias("c")).agg(F.min("b.first").alias("near"))
    known = classes.select("scope", "k", "c", "first").join(near, ["scope", "k", "c"], "left").select("scope", "k", "c", F.least("first", F.coalesce("near", "first")).alias("older"))
    return rows.join(known, ["scope", "k", "c"]).where("fact_id > older").select(F.col("fact_id").alias("newer"), "older")


def conflict_label(a: Column, b: Column) -> Column:
    """(subject, predicate) of a dispute: the stems both claims share, in the left one's order."""
    return label(shared_stems(tokens(a), subjectish(b)))


def shared_stems(tok: Column, right: Column) -> Column:
    """The left claim's tokens, or their stems, that the right claim's subject tokens hold."""

    def canonical(t: Column) -> Column:
        stems = [F.when(t.endswith(x) & (F.length(t) > len(x) + 2), F.substring(t, F.lit(1), F.length(t) - len(x))) for x in STEM_SUFFIXES]
        return F.coalesce(F.when(F.array_contains(right, t), t), *[F.when(F.array_contains(right, s), s) for s in stems])

    return F.array_distinct(F.filter(F.transform(tok, canonical), lambda t: t.isNotNull()))


def label(shared: Column) -> Column:
    """(subject, predicate) of a dispute from the stems its claims share."""
    n = F.size(shared)
    subject = F.when(n >= 2, F.array_join(F.slice(shared, F.lit(1), F.greatest(n - 1, F.lit(0))), ".")).when(n == 1, F.get(shared, F.lit(0))).otherwise("untyped")
    predicate = F.when(n >= 2, F.element_at(shared, -1)).otherwise("claim")
    return F.struct(F.substring(subject, 1, 128).alias("subject"), F.substring(predicate, 1, 64).alias("predicate"))
