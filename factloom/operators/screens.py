"""Safety screens over texts: credentials, injected instructions, tasks, echoes of prompts.

Matching is done by JVM regular expressions; only the composing of
compatibility forms passes Arrow, once per text (``normal``).
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Shapes of credentials.
CREDENTIALS = (
    r"-----BEGIN (?:[A-Z0-9]+(?: [A-Z0-9]+)* )?PRIVATE KEY-----",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\b(?:ghp|github_pat|sk-[A-Za-z0-9_-]{8})[A-Za-z0-9_-]{12,}\b",
    r"""(?i)\b(?:api[_ -]?key|client[_ -]?secret|password|token)\b['"]?\s*[:=]\s*['"]?[^\s'"]{8,}""",
    r"""(?i)\b(?:api[_ -]?(?:key|token)|client[_ -]?secret|password|token)\b['"]?\s+(?:is|was)\s+['"]?[^\s'"]{8,}""",
    r"(?i)\bauthorization\s*:\s*bearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"\bAIza[0-9A-Za-z_-]{30,}\b",
    r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^\s:/]+:[^\s/@]+@",
    r"(?i)\b(?:accountkey|sharedaccesssignature|aws_secret_access_key)\s*=\s*[^\s;]{8,}",
)
# Texts shaped like instructions to a model, and texts shaped like tasks.
STRUCTURE = r"(?i)(?:(?:^|\n)[ \t]*(?:[#>*-]+[ \t]*)?(?:system|developer|assistant)\s*(?:(?:message|prompt|instructions?)\s*)?:|\[(?:/?inst|system)\]|</?(?:system|developer|assistant)(?:\s|>))"
CONTROL = r"(?i)\b(?:ignore|disregard|forget|override|bypass|follow|obey)\b.{0,96}\b(?:instructions?|prompt|rules?|policy|memory)\b"
LEADING_CONTROL = r"(?i)^\s*(?:ignore|disregard|forget|override|bypass|follow|obey)\b.{0,96}\b(?:instructions?|prompt|rules?|policy|memory)\b"
DISCLOSURE = r"(?i)\b(?:reveal|expose|exfiltrate|disclose)\b.{0,64}\b(?:secrets?|private\s+data|hidden\s+instructions?)\b"
TASK = r"(?is)^\s*(?:pitch\b|todo\b|action items?:)"
# Fixed value: characters of category Cf, which are dropped before matching.
FORMAT_CHARS = r"\p{Cf}"
VISIBLE = r"[^\s\p{Z}]"
# Look-alike letters that are folded before echoes are looked for, and the letters they stand for.
LOOK_ALIKE, STANDS_FOR = "аеорсухіАЕОРСУХІ", "aeopcyxiaeopcyxi"
# Contents of the examples in extraction prompts, words that count for nothing between them, and the thresholds of an echo.
EXAMPLES = ("Dana now works at Northwind.", "Dana prefers split keyboards.", "Dana no longer lives in Springfield.")
ECHO_STOPWORDS = "a an as at in longer no now the".split()
ECHO_JACCARD, ECHO_SHARED = 0.65, 3

@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    from unicodedata import normalize

    return texts.map(lambda t: t if t is None or t.isascii() else normalize("NFKC", t))


def normal(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with compatibility forms of the named texts composed (NFKC), so that width forms and ligatures match plain patterns.

    Spark has no such function, so the texts pass an Arrow function once; texts
    in ASCII come back as they are.
    """
    return df.withColumns({c: _composed(F.col(c)) for c in columns})


def plain(text: Column) -> Column:
    """Without format characters."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), FORMAT_CHARS, "")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once per row, even within a branch of a case."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def echoes(text: Column) -> Column:
    """Whether a text repeats an example of the prompts: one holds the other, or they share most of their words."""

    def said_again(x: Column) -> Column:
        tests = []
        for said in EXAMPLES:
            k = re.sub(r"[^a-z0-9]", "", said.lower())
            w = F.array(*[F.lit(y) for y in sorted(set(re.findall("[a-z0-9]+", said.lower())) - set(ECHO_STOPWORDS))])
            shared, union = F.size(F.array_intersect(x.w, w)), F.size(F.array_union(x.w, w))
            tests.append(x.k.contains(k) | F.contains(F.lit(k), x.k) | ((shared >= ECHO_SHARED) & (shared / union >= ECHO_JACCARD)))
        return (x.k != "") & reduce(lambda a, b: a | b, tests)

    def parts(low: Column) -> Column:
        words = F.array_except(F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), F.array(*[F.lit(w) for w in ECHO_STOPWORDS]))
        return F.struct(F.regexp_replace(low, r"[^\p{L}\p{N}]", "").alias("k"), words.alias("w"))

    return _once(F.lower(F.translate(plain(text), LOOK_ALIKE, STANDS_FOR)), lambda low: _once(parts(low), said_again))


def blank(text: Column) -> Column:
    """Nothing but white space of any kind."""
    return ~text.rlike(VISIBLE)


def any_match(text: Column, patterns) -> Column:
    """Whether one of the patterns occurs: a single expression, as a long chain of them would be too large to be compiled."""
    return text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def credential_shaped(text: Column) -> Column:
    return any_match(F.coalesce(text, F.lit("")), CREDENTIALS)


def instruction_shaped(text: Column) -> Column:
    """Anything that reads like a control message, or nothing at all."""
    t = plain(text)
    return blank(t) | any_match(t, (STRUCTURE, CONTROL, DISCLOSURE))


def ephemeral_reason(text: Column) -> Column:
    """Why an automatic proposal is no durable memory, or null: the first of echo, instruction and task."""
    t = plain(text)
    injected = blank(t) | any_match(t, (STRUCTURE, LEADING_CONTROL, DISCLOSURE))
    return F.when(echoes(text), "prompt_example_echo").when(injected, "instruction_shaped_content").when(t.rlike("(?U)" + TASK), "task_shaped_content")


def rejection(text: Column) -> Column:
    """Why an automatic proposal is not kept, or null."""
    return F.when(credential_shaped(text), "credential_shaped").otherwise(ephemeral_reason(text))


def screen_report(docs: DataFrame, text: str, by: str) -> DataFrame:
    """Rows by group and rejection reason."""
    docs = normal(docs, text)
    return docs.groupBy(F.coalesce(by, F.lit("none")).alias(by), F.coalesce(rejection(F.col(text)), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def gold_proposals(gold: DataFrame) -> DataFrame:
    """Every proposed fact of the gate's cases with its verdict: grounded, spoken by the user, typed, screened."""
    f = gold.select("case_id", F.posexplode("facts").alias("item_no", "f"))
    f = normal(f.withColumn("content", F.col("f.content")), "content")
    reason = F.coalesce(
        rejection(F.col("content")), F.when(F.col("f.evidence_excerpt").isNull(), "no_evidence"), F.when(F.col("f.evidence_role") != "user", "not_said_by_user"),
    )
    return f.select("case_id", "item_no", F.col("f.state.kind").alias("kind"), F.coalesce(reason, F.lit("kept")).alias("verdict"))
