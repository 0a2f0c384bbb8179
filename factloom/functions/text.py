"""Token, state and value expressions over fact contents, all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words without meaning for claims.
STOPWORDS = (
    "a an the is are was were be been being am of to in on at for and or with by as it its this that these those from into over under has have had "
    "do does did will would can could should may might must not no"
).split()
# Words of one group exclude each other as states of one thing (claims).
STATE_GROUPS = (
    ("enabled", "disabled"), ("active", "inactive", "archived"), ("on", "off"), ("open", "closed"), ("paused", "resumed"), ("up", "down"),
    ("alive", "dead"), ("started", "stopped"),
)
# Further groups that block a merge.
MERGE_STATE_GROUPS = (
    *STATE_GROUPS, ("pending", "running", "completed", "failed", "succeeded"), ("deployed", "undeployed", "installed", "uninstalled"),
    ("available", "unavailable"), ("approved", "rejected", "accepted", "denied"),
)
# Negations, date words, copulas after which on and off are states, suffixes of stems.
NEGATIONS = ("not", "no", "never", "without")
DATE_WORDS = (
    "january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday today tomorrow yesterday"
).split()
ON_OFF_AFTER = ("is", "was", "turned", "set")
STEM_SUFFIXES = ("ation", "ing", "ed", "ic", "ion", "s")


def words_array(values) -> Column:
    """A literal array of words."""
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 in order; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def unicode_tokens(text: Column) -> Column:
    """Lower-case runs of letters or digits of any script, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def values_of(t: Column) -> Column:
    """``value_tokens`` of a text's tokens; these forms do not split a text again."""
    return F.filter(t, lambda x: x.rlike("[0-9]"))


def words_of(t: Column) -> Column:
    """``content_tokens`` of a text's tokens."""
    return F.array_except(F.array_distinct(t), words_array(STOPWORDS))


def states_of(words: Column) -> Column:
    """``state_words`` of a text's content tokens."""
    return F.array_intersect(words, words_array(w for g in STATE_GROUPS for w in g))


def negated_of(t: Column) -> Column:
    """``negated`` of a text's tokens."""
    return F.arrays_overlap(F.array_distinct(t), words_array(NEGATIONS))


def plain_of(words: Column) -> Column:
    """Content tokens without state words."""
    return F.array_except(words, words_array(w for g in STATE_GROUPS for w in g))


def stemmed(base: Column) -> Column:
    """Tokens and their stems."""

    def cut(suffix: str) -> Column:
        long = F.filter(base, lambda t: t.endswith(suffix) & (F.length(t) > len(suffix) + 2))
        return F.transform(long, lambda t: F.substring(t, F.lit(1), F.length(t) - len(suffix)))

    return F.array_distinct(F.concat(base, *[cut(x) for x in STEM_SUFFIXES]))


def value_tokens(text: Column) -> Column:
    """Ordered tokens that hold a digit."""
    return values_of(tokens(text))


def merge_value_tokens(text: Column) -> Column:
    """Ordered tokens that hold a digit or name a date."""
    dates = words_array(DATE_WORDS)
    return F.filter(tokens(text), lambda t: t.rlike("[0-9]") | F.array_contains(dates, t))


def content_tokens(text: Column) -> Column:
    return words_of(tokens(text))


def state_words(text: Column) -> Column:
    return states_of(content_tokens(text))


def negated(text: Column) -> Column:
    """Whether the text holds an explicit negation."""
    return negated_of(tokens(text))


def merge_states(text: Column) -> Column:
    """Sorted state words; on and off only where every occurrence follows a copula."""
    t = tokens(text)
    bad = F.filter(
        F.transform(t, lambda x, i: F.when(x.isin("on", "off") & ((i == 0) | ~F.get(t, i - 1).isin(*ON_OFF_AFTER)), x)), lambda x: x.isNotNull()
    )
    return F.sort_array(F.array_except(F.array_intersect(F.array_distinct(t), words_array(w for g in MERGE_STATE_GROUPS for w in g)), F.array_distinct(bad)))


def subjectish(text: Column) -> Column:
    """Content tokens without state words, and their stems."""
    return stemmed(plain_of(content_tokens(text)))


def opposing_states(a: Column, b: Column) -> Column:
    """Both sides take a stand within one group of states, and not the same one."""
    tests = []
    for g in STATE_GROUPS:
        w = words_array(g)
        x, y = F.sort_array(F.array_intersect(a, w)), F.sort_array(F.array_intersect(b, w))
        tests.append((F.size(x) > 0) & (F.size(y) > 0) & (x != y))
    return reduce(lambda x, y: x | y, tests)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def coverage(query: Column, document: Column) -> Column:
    """Share of the query's tokens that the document holds; 0 for an empty query."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, document)) / F.size(query))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def truncated(text: Column, limit: int, marker: str = "...") -> Column:
    """The text, or its first characters without trailing blanks and the marker."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - len(marker))), F.lit(marker)))


def subject_key(text: Column) -> Column:
    """Trimmed, lower case, blanks as underscores; null where it is no valid subject key."""
    k = F.regexp_replace(F.lower(F.trim(text)), r"\s+", "_")
    return F.when(k.rlike(r"^[a-z0-9][a-z0-9._:/-]{0,127}$"), k)


def predicate_key(text: Column) -> Column:
    """As a subject key, with hyphens as underscores and without colon and slash."""
    k = F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_")
    return F.when(k.rlike(r"^[a-z0-9][a-z0-9._-]{0,63}$"), k)


def tag_list(tags: Column) -> Column:
    """Comma-separated tags as a list without blanks and empties, order kept."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def alias_list(aliases: Column) -> Column:
    """A JSON array, or text split at comma, semicolon, bar or line end."""
    parsed = F.from_json(aliases, "array<string>")
    plain = F.split(aliases, r"[,;|\n]")
    return F.filter(F.transform(F.when(F.ltrim(aliases).startswith("["), F.coalesce(parsed, plain)).otherwise(plain), lambda t: F.trim(t)), lambda t: t != "")
