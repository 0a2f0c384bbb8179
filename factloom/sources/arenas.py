"""Evaluation files: JSON, JSON lines and wrappers, nested conversations with numbered sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = (
    "id string, query string, gold_fact_id long, category string, min_trust double, stale_fact_ids array<long>, tags array<string>, case_type string, "
    "expected_current_fact_ids array<long>, privacy_tier string, should_abstain boolean"
)
# Question templates for cases made from facts.
TEMPLATES = ("What is known about {cue}?", "Which memory covers {cue}?", "Recall the recorded fact regarding {cue}")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from a JSON list, JSON lines, or an object with ``cases``; unknown keys are ignored, missing ones null."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.from_json("v", f"array<struct<{_struct(CASE)}>>")
    wrapped = F.from_json("v", f"struct<cases: array<struct<{_struct(CASE)}>>>")["cases"]
    lines = F.transform(F.filter(F.split("v", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{_struct(CASE)}>"))
    single = F.when(F.col("v").startswith("["), listed).otherwise(F.coalesce(wrapped, lines))
    rows = text.select(F.explode(single).alias("c")).select("c.*")
    return rows.withColumns({"min_trust": F.coalesce("min_trust", F.lit(0.3)), "should_abstain": F.coalesce("should_abstain", F.lit(False))})


def load_rows(spark: SparkSession, path: str, schema: str, wrappers: tuple[str, ...] = ("cases", "rows", "data")) -> DataFrame:
    """Rows of a JSON list, of JSON lines, or of an object that holds the list under one of ``wrappers``; a file whose rows have none of the columns raises."""
    item = f"struct<{_struct(schema)}>"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    wrapped = F.coalesce(*[F.from_json("v", f"struct<{w}: array<{item}>>")[w] for w in wrappers])
    lines = F.transform(F.filter(F.split("v", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, item))
    rows = text.select(F.explode(F.when(F.col("v").startswith("["), F.from_json("v", f"array<{item}>")).otherwise(F.coalesce(wrapped, lines))).alias("c"))
    checked = F.when(F.to_json("c") != "{}", F.col("c")).otherwise(F.raise_error(F.lit(f"{path} holds a row without any of the columns")).cast(item))
    return rows.select(checked.alias("c")).select("c.*")


def verified(spark: SparkSession, path: str, sha256: str) -> str:
    """The path, if its file has the digest; a published data set is only read as it was published."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if got != sha256:
        raise ValueError(f"{path} is not the expected file: {got}")
    return path


def _struct(ddl: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.split(" ", 1) for x in ddl.split(", ")))


def load_numbered_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(conv, session, date, transcript, dialog_ids) of conversations whose sessions are keys ``session_N`` beside ``session_N_date_time``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<conversation: map<string, string>>>").alias("a"))
    conv = raw.select(F.posexplode("a").alias("conv", "c")).select("conv", F.col("c.conversation").alias("m"))
    e = conv.select("conv", "m", F.explode("m").alias("k", "v")).where(F.col("k").rlike(r"^session_\d+$"))
    turns = F.from_json("v", "array<struct<speaker: string, dia_id: string, text: string, blip_caption: string>>")
    e = e.select("conv", F.regexp_extract("k", r"(\d+)$", 1).cast("int").alias("session"), F.col("m")[F.concat("k", F.lit("_date_time"))].alias("date"), turns.alias("t"))
    said = F.transform("t", lambda x: F.concat(x.speaker, F.lit(": "), F.concat_ws(" ", x.text, F.concat(F.lit("[image: "), x.blip_caption, F.lit("]")))))
    return e.select("conv", "session", "date", F.array_join(said, "\n").alias("transcript"), F.transform("t", lambda x: x.dia_id).alias("dialog_ids"))


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """(conv, question_no, question, answer, evidence, category): every question row, none dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<qa: array<struct<question: string, answer: string, evidence: array<string>, category: int, adversarial_answer: string>>>>").alias("a"))
    q = raw.select(F.posexplode("a").alias("conv", "c")).select("conv", F.posexplode("c.qa").alias("question_no", "q"))
    return q.select("conv", "question_no", "q.question", F.coalesce("q.answer", "q.adversarial_answer").alias("answer"), "q.evidence", "q.category")


def load_haystacks(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, session_no, date, transcript) of questions with dated haystack sessions; a list or ``{data: [...]}``."""
    item = "struct<question_id: string, question: string, question_date: string, haystack_dates: array<string>, haystack_sessions: array<array<struct<role: string, content: string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", f"struct<data: array<{item}>>")["data"], F.from_json("value", f"array<{item}>")).alias("a"))
    q = raw.select(F.explode("a").alias("q")).select("q.question_id", F.posexplode(F.arrays_zip("q.haystack_dates", "q.haystack_sessions")).alias("session_no", "s"))
    return q.select("question_id", "session_no", F.col("s.haystack_dates").alias("date"), F.array_join(F.transform("s.haystack_sessions", lambda t: F.concat(F.upper(t.role), F.lit(": "), t.content)), "\n").alias("transcript"))


def load_dated_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question, answer, question_type, reference_time, evidence): one row per question; one without identifier, text or date raises.

    A file whose name says ``oracle`` holds only the sessions with the answers,
    so it is refused as a haystack.
    """
    if "oracle" in path.rsplit("/", 1)[-1].lower():
        raise ValueError("an oracle file is no haystack")
    item = "struct<question_id: string, question: string, answer: string, question_type: string, question_date: string, reference_time: string, answer_session_ids: array<string>, evidence: array<string>>"
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", f"struct<data: array<{item}>>")["data"], F.from_json("value", f"array<{item}>")).alias("a"))
    q = raw.select(F.explode("a").alias("q")).select("q.*")
    filled = lambda c: F.coalesce(F.trim(c), F.lit(""))
    at = F.when(filled("question_date") != "", F.trim("question_date")).otherwise(filled("reference_time"))
    whole = (filled("question_id") != "") & (filled("question") != "") & (at != "")
    ident = F.when(whole, F.trim("question_id")).otherwise(F.raise_error(F.lit("a question lacks its identifier, text or date")).cast("string"))
    return q.select(ident.alias("question_id"), F.trim("question").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), filled("question_type").alias("question_type"), at.alias("reference_time"), F.coalesce("answer_session_ids", "evidence", F.array().cast("array<string>")).alias("evidence"))


def exact_cases(facts: DataFrame) -> DataFrame:
    """A case per fact whose query is its own content."""
    return facts.where("content is not null and content != ''").select(F.concat(F.lit("fact-"), F.col("fact_id").cast("string")).alias("id"), F.col("content").alias("query"), F.col("fact_id").alias("gold_fact_id"), F.lit("exact_fact").alias("case_type"))


def paraphrase_cases(facts: DataFrame) -> DataFrame:
    """A case per fact whose query is a template, by identifier, around its words with the first one moved to the end."""
    words = F.filter(F.split(F.trim("content"), r"\s+"), lambda x: x != "")
    cue = F.when(F.size(words) <= 1, F.concat(F.lit("the topic "), F.trim("content"))).otherwise(F.array_join(F.concat(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 1, 1)), " "))
    t = F.element_at(F.array(*[F.lit(x) for x in TEMPLATES]), (F.col("fact_id") % 3 + 1).cast("int"))
    return facts.where("content is not null and trim(content) != ''").select(F.concat(F.lit("para-"), F.col("fact_id").cast("string")).alias("id"), F.replace(t, F.lit("{cue}"), cue).alias("query"), F.col("fact_id").alias("gold_fact_id"), F.lit("paraphrase").alias("case_type"))


def self_referential(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: cases, and those whose query is their gold fact's content."""
    c = cases.join(facts.select(F.col("fact_id").alias("gold_fact_id"), "content"), "gold_fact_id", "left")
    return c.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.trim("query") == F.trim("content")).alias("self_referential"))


def report_rows(cases: DataFrame) -> DataFrame:
    """Cases as JSON lines for a report: text of private cases is withheld."""
    shown = F.when(F.col("privacy_tier") == "public", F.col("query")).otherwise("[private]")
    return cases.withColumn("query", shown).select(F.to_json(F.struct("*")).alias("value"))


def write_report(cases: DataFrame, path: str) -> None:
    """The report rows as JSON lines."""
    report_rows(cases).write.mode("overwrite").text(path)
