"""Problem 9: one consistent form for texts that look the same.

DuckDB runs inside each Arrow partition: ``nfc_normalize`` composes accents,
``translate`` maps width forms, blanks, hyphens and look-alike letters of other
scripts, regular expressions remove invisible characters and expand ligatures,
all in one SQL statement over the batch, without leaving Arrow.

What shows stays: letter case, accents, digits and runs of blanks.
Compatibility forms come from the Unicode data by rule (decompositions tagged
wide, narrow or noBreak, and the Latin and Armenian ligatures); superscripts,
fractions and circled forms look different and stay.

Defined cases: a null text gives null; a text with nothing visible gives an
empty string and is in no set; texts are used whole at any length; equal texts
are copies as well; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Cut, ship
from .collapse import groups
from .words import key128

# Letters of the Cyrillic, Greek and Armenian scripts and the Latin letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H", "Ӏ": "I", "Ѵ": "V", "Ь": "b",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x",
    "у": "y", "ү": "y", "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "υ": "u", "ι": "i", "α": "a", "κ": "k", "γ": "y",
    "Օ": "O", "օ": "o", "Տ": "S", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M",
}
# Hyphens and dashes of a hyphen's look.
HYPHENS = "‐‑‒⁃−﹣－"
# Characters that show nothing and take no room, as ranges of code points.
INVISIBLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB),
    (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]


@cache
def tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for single characters, and the expansions of ligatures, by rule from the Unicode data."""
    single: dict[str, str] = {}
    many: dict[str, str] = {}
    for cp in (*range(0xA0, 0xD800), *range(0xF900, 0x10000)):
        c = chr(cp)
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if unicodedata.category(c) == "Zs":
            single[c] = " "
        elif kind in ("<wide>", "<narrow>", "<noBreak>"):
            to = unicodedata.normalize("NFKC", c)
            if len(to) == 1:
                single[c] = to
        elif kind == "<compat>" and (0xFB00 <= cp <= 0xFB17 or cp in (0x132, 0x133, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3)):
            many[c] = "".join(chr(int(x, 16)) for x in rest.split())
    single |= dict.fromkeys(HYPHENS, "-")
    for c, to in LOOKALIKES.items():
        single[c] = to
    for cp in (*range(0xC0, 0x600), *range(0x1E00, 0x2000)):  # the same letters under accents
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in LOOKALIKES:
            to = unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])
            if len(to) == 1:
                single[chr(cp)] = to
    return "".join(single), "".join(single.values()), many


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def statement() -> str:
    """The SQL over a batch ``b`` (id, text): (id, form)."""
    src, dst, many = tables()
    expr = "text"
    for c, to in many.items():
        expr = f"replace({expr}, {_quote(c)}, {_quote(to)})"
    gone = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in INVISIBLE)
    # Composed first, so that look-alikes with accents are single characters that the table maps; what composes only
    # after the mapping, a mapped base and a separate accent, is composed by the second pass.
    expr = f"regexp_replace({expr}, '[{gone}]', '', 'g')"
    expr = f"nfc_normalize(translate(nfc_normalize({expr}), {_quote(src)}, {_quote(dst)}))"
    return f"SELECT id, {expr} AS form FROM b"


#: Bytes of text that one statement works on, about; a longer text is a slice of its own.
SLICE_BYTES = 16 << 20


def _slices(batch):
    """The batch in slices of about SLICE_BYTES of text, one row at least."""
    at, size = 0, 0
    for i, n in enumerate(_lengths(batch)):
        if size and size + n > SLICE_BYTES:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _lengths(batch) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()


def _run(batches):
    import duckdb
    import pyarrow as pa

    con = duckdb.connect(":memory:", config={"threads": 1})
    sql = statement()
    try:
        for b in batches:
            schema = pa.schema([("id", b.schema.field(0).type), ("form", pa.string())])
            for part in _slices(b):
                con.register("b", pa.Table.from_batches([part]))
                got = con.sql(sql).to_arrow_table()
                con.unregister("b")
                yield from got.cast(schema).to_batches()
    finally:
        con.close()


def consistent(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, form): the consistent form of every text; null for null."""
    ship(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(_run, f"id {kind}, form string").withColumnRenamed("id", ident)


def look_alikes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, members) of documents whose texts look the same."""
    cut = Cut(docs.sparkSession, "looks")
    k1, k2 = key128(F.col("form"))
    visible = F.col("form").rlike(r"[^\s\p{Z}\p{C}]")
    rows = cut(consistent(docs, ident, text).where(visible).select(ident, k1.alias("k1"), k2.alias("k2")).dropDuplicates([ident]), "keys")
    return groups(rows, ["k1", "k2"], ident, rows.count())
