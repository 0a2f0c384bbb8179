"""Transcripts to bounded, exact spans."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

# Longest span, least characters before a cut is looked for, and the cuts in order of preference.
MAX_CHARS = 2000
MIN_CUT = 64
CUTS = ("\n\n", "\n", ". ", "? ", "! ")


@cache
def _piece(limit: int) -> re.Pattern:
    """One readable piece: the rest of a block where it fits, else up to the last best cut within the limit, else the limit.

    Each alternative is greedy, so it takes the last place of its kind; their
    order is the preference. A piece's first character shows.
    """
    least, most = MIN_CUT, limit - 1
    cuts = []
    for c in CUTS:
        mark, blank = re.escape(c.rstrip()), re.escape(c[len(c.rstrip()) :])
        # the cut lies inside the window and is followed by its blank; a line end itself is not part of the piece
        cuts.append(rf"(?=\S)[\s\S]{{{max(least, 1)},{most - len(c) + 1}}}{mark}(?={blank})" if mark else rf"(?=\S)[\s\S]{{{least},{most - len(c) + 1}}}(?={blank})")
    return re.compile(rf"(?=\S)[\s\S]{{1,{limit}}}\Z|" + "|".join(cuts) + rf"|(?=\S)[\s\S]{{1,{limit}}}")


def split_spans(text: str, limit: int = MAX_CHARS) -> list[tuple[int, int]]:
    """(start, end) of the spans of a text: blocks between blank lines, cut readably where they exceed the limit."""
    out: list[tuple[int, int]] = []
    for block in re.finditer(r"(?:(?!\r?\n[ \t]*\r?\n)[\s\S])+", text):
        said = block[0].rstrip()
        shift = block.start()
        for m in _piece(limit).finditer(said):
            out.append((shift + m.start(), shift + m.start() + len(m[0].rstrip())))
    return out


def transcript_spans(docs: DataFrame, ident: str = "doc_id", text: str = "text", limit: int = MAX_CHARS) -> DataFrame:
    """(ident, span_id, start, stop, role, span): exact substrings; role is the speaker of the line the span starts in."""
    ship(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        role = re.compile(r"^(USER|ASSISTANT|TOOL):", re.M)
        for b in batches:
            row, start, stop, who, said, name = [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                marks = [(m.start(), m[1].lower()) for m in role.finditer(t)]
                k = 0
                for s, e in split_spans(t, limit):
                    while k < len(marks) and marks[k][0] <= s:
                        k += 1
                    row.append(i)
                    start.append(s)
                    stop.append(e)
                    who.append(marks[k - 1][1] if k else None)
                    said.append(t[s:e])
                    name.append(f"span-{s:06d}-{e:06d}")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(who, pa.string()), pa.array(said, pa.string())], ["id", "span_id", "start", "stop", "role", "span"])

    out = docs.select(ident, text).mapInArrow(run, f"id {kind}, span_id string, start int, stop int, role string, span string")
    return out.withColumnRenamed("id", ident)


def eligible_spans(spans: DataFrame) -> DataFrame:
    """Spans said by the user: only they are admitted to extraction."""
    return spans.where("role = 'user'")


def span_report(spans: DataFrame) -> DataFrame:
    """Per role: spans, characters, longest."""
    return spans.groupBy(F.coalesce("role", F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("chars"), F.max(F.col("stop") - F.col("start")).alias("longest"))
