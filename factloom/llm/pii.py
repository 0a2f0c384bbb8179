"""Problem 1: personal information in free text, found and replaced.

``mentions`` finds e-mail addresses, phone numbers, identity numbers, street
addresses and persons' names; ``redacted`` puts typed placeholders in their
place; ``surrogates`` gives each distinct mention a keyed replacement of the
same type, gender, script and format, and ``pseudonymised`` writes the text
with them.

Names are found from a lexicon learnt from the person rows of ``entities``:
given names, and the stems and endings that family names are built of, so that
families the table lacks are known by their parts. The lexicon holds distinct
words, not persons; they are checked to be at most ``LEXICON_MAX`` before they
go to the workers.

Surrogates are drawn for the parts that mentions are made of, and mentions are
put together from them: a given name, a family name, a word of a street or
domain, the national digits of a phone number, an identity number. So ``Zelda
Plin``, ``Plin, Zelda``, ``Z. Plin`` and ``zelda.plin@...`` stay one person,
and one number in two notations stays one number.

* Digits pass a keyed permutation without fixed points; letters of numbers and
  postcodes are replaced one by one, and check letters are computed anew.
* Words become keyed syllables in their script and case. The first letter of a
  given name is mapped by a keyed permutation of the alphabet, which the
  initials share. Its ending shows the gender, which comes from titles and
  pronouns of the corpus, else from a table of usual names, else from the
  ending; names of unknown gender get a neutral one.
* A part's surrogate that another part has as well, or that is itself a part of
  the corpus, is drawn again, by grouping and joining over all parts, until
  none is left. So distinct mentions keep distinct surrogates.

Defined cases: null and empty texts have no mentions and stay as they are;
repeated rows give repeated mentions (queries take them distinct); overlapping
finds keep the one of the stronger type (e-mail, identity number, phone,
address, name), then the longer; texts are read whole, at any length; extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Cut, ship

LEXICON_MAX = 2_000_000
TYPES = ("email", "id_number", "phone", "street_address", "person_name")

_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_EMAIL = re.compile(
    rf"(?<![\w.+%-])[\w%+](?:[\w.%+-]*[\w%+-])?(?:@|\s?\(at\)\s?|\s?\[at\]\s?|＠)(?:{_LABEL}{_DOT})+[a-z]{{2,24}}(?![\w-]|\.\w)"
    rf"|(?<![\w.+%-])[\w%+](?:[\w.%+-]*[\w%+-])?\sat\s(?:{_LABEL}\sdot\s)+[a-z]{{2,24}}(?![\w-])",
    re.I,
)
_IDS = re.compile(
    r"(?<![\w/.-])(?:"
    r"\d{3}-\d{2}-\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|[A-Z]\d{3}-\d{4}-\d{4}"
    r"|[A-Z]{1,2}\d{7,8}"
    r")(?![\w-])"
)
_ID_LABEL = (
    r"(?:ssn|soc(?:ial|\.)\s?sec(?:urity|\.)(?:\s(?:number|no\.?))?|social security|national insurance|ni (?:no\.?|number)|dni|nie"
    r"|passport|reisepass(?:-nr\.?)?|driv(?:ing|er'?s?|er’s) licen[cs]e|tax id|steuer-id|tin|id card|personalausweis)"
)
_LABELLED_ID = re.compile(
    rf"\b{_ID_LABEL}(?:\s(?:no\.?|nr\.?|number))?[:\s#]+((?:[a-z]{{0,2}}\d[\d -]{{4,16}}\d[a-z]?|[a-z]{{2}}[ ]?\d{{2}}[ ]?\d{{2}}[ ]?\d{{2}}[ ]?[a-d]|\d{{8}}[a-z])(?![\w-]))",
    re.I,
)
_EXT = r"(?:,?\s?(?:ext\.?|x|extension|#)\s?\d{1,6})?"
_PHONE = re.compile(
    r"(?<![\w./+-])(?<!\d )(?:"
    r"(?:\+|00)\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}"
    r"|\+\d{1,3}(?:[ .-]\d{1,6}){2,6}"
    r"|\+\d{8,15}"
    r"|001[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|\d{3}([.-])\d{3}\1\d{4}"
    r"|\(?0\d{3,4}\)? \d{3} \d{3,4}"
    r"|0\d{2,4}[/-]\d{6,8}"
    r"|0\d(?:[ .]\d{2}){4}"
    rf"){_EXT}(?![\w/-]|[.:]\d)",
    re.I,
)
_CUED_PHONE = re.compile(
    r"\b(?:tel(?:ephone)?|phone|mobile|cell|landline|hotline|pager|fax|call|dial|ring|text|reach(?:able|ed)?)(?:\s(?:line|number|no|me|us|him|her|them|is|at|on|under|via))*"
    r"[.:]?\s(\d[\d ().-]{7,16}\d)(?![\w/-]|[.:]\d)",
    re.I,
)

_N = r"[^\W\d_][\w'’-]*"
_UNIT = r"(?:(?:apt|apartment|unit|suite|ste|flat|floor|fl|room|rm|no)\.?\s?#?\w{1,5}|#\s?\w{1,5}|\d{1,3}\s?(?:º|ª|°|er|ème|e)(?:\s\w{1,3})?|\d{1,2}(?:st|nd|rd|th) floor)"
_TOWN = rf"(?:(?:bad|saint|sankt|st\.?|san|santa|new|los|las|la|el|upper|lower|great|port)[ -])?{_N}"
_TYPE = r"(?:street|avenue|road|lane|drive|close|court|place|square|terrace|boulevard|crescent|parkway|highway|way|blvd\.?|hwy\.?|st\.?|ave\.?|rd\.?|ln\.?|dr\.?|ct\.?|pl\.?|sq\.?|terr?\.?)"
_SURE = r"(?:street|avenue|road|lane|drive|boulevard)"
_DIR = r"(?:(?:north|south|east|west|[nsew]\.?)\s)?"
_ENGLISH = re.compile(
    rf"(?<![\w/.-])(?:(?:flat|apt\.?|unit)\s\w{{1,4}},\s)?\d{{1,5}}[a-z]?\s{_DIR}{_N}(?:\s{_N})?\s(?P<kind>{_TYPE})(?![\w])"
    rf"(?P<unit>,?\s{_UNIT})?(?P<town>,\s{_TOWN}(?:,?\s(?:[A-Z]{{2}}\s)?\d{{5}}(?:-\d{{4}})?|,?\s[A-Z]{{1,2}}\d[A-Z\d]?\s\d[A-Z]{{2}})?)?(?![\w])",
    re.I,
)
_CITY = rf",\s\d{{4,5}}\s{_TOWN}(?!\w)"
_CONTINENTAL = re.compile(
    rf"(?<![\w/.-])(?:"
    rf"\d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s(?:rue|avenue|chemin|boulevard|place|impasse|allée|allee|quai|route|cours)\s(?:(?:de la|de l'|des|de|du|d')\s?)?{_N}(?:\s{_N})?{_CITY}"
    rf"|(?:calle|avenida|avda\.?|c/|plaza|paseo|camino|carrer|via|viale|piazza|rua)\s?(?:(?:de la|de los|de|del|da|do)\s)?{_N},?\s\d{{1,4}}(?:,\s{_UNIT})*{_CITY}"
    rf"|{_N}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer)\s\d{{1,4}}\s?[a-z]?(?:,\s{_UNIT})?{_CITY}"
    rf")",
    re.I,
)
_WORD = re.compile(r"[^\W\d_]+")
# Words between a given and a family name.
_PARTICLES = frozenset("von dem der van den de la los del della di da dos das du le zu zum zur ter ten al el bin ibn af av".split())
_MIDDLE = re.compile(r"(?<![\w.])((?:[^\W\d_]\.\s?){1,3})$")
# Words that stand before a family name without being a given name.
_NOT_GIVEN = frozenset(
    "a about after all an and are as ask at be before but by call cc dear dr email family for from had has hello herr hi his her if in into is it its "
    "loop m madam miss mme mr mrs ms nor not of on or our per ping please prof professor project regards señor señora service sir so spoke sr sra team "
    "tell thanks that the their then they this to tool user assistant was we were when which while who whom with yet your".split()
)
_AFTER = re.compile(r",\s([^\W\d_]+(?:-[^\W\d_]+)?)(\s[^\W\d_]\.)?(?![\w@])")
_INITIAL_AFTER = re.compile(r",\s([A-Z]\.)(\s?[A-Z]\.)?(?![\w@])")


# Letters that Unicode does not take apart, and their plain forms.
_PLAIN = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th"})


def plain(word: str) -> str:
    """Lower case; Latin and Greek letters without their accents."""
    low = word.lower().translate(_PLAIN)
    if low.isascii():
        return low
    bare = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
    return bare if _script(bare) in ("LATIN", "GREEK") else low


@cache
def _script(word: str) -> str:
    """The first word of the Unicode name of the first letter: LATIN, GREEK, ARABIC, CJK and so on."""
    return next((unicodedata.name(c, "LATIN").split(" ")[0] for c in word if c.isalpha()), "LATIN")


class Lexicon:
    """Given names, and family names with the stems and endings they share."""

    def __init__(self, given: set[str], family: set[str]):
        self.given = given
        self.family = {x for x in family if len(x) >= 3} - given
        self.plain_given = {plain(x) for x in given}
        # An ending counts if several stems take it and those stems take other endings too.
        by_end: dict[str, set[str]] = defaultdict(set)
        by_stem: dict[str, set[str]] = defaultdict(set)
        for f in self.family:
            for k in range(3, len(f) - 2):
                by_stem[f[:k]].add(f[k:])
                by_end[f[k:]].add(f[:k])
        best: Counter = Counter()
        for f in self.family:
            cuts = [(min(len(by_end[f[k:]]), 8) * min(len(by_stem[f[:k]]), 8), len(f[k:]), k) for k in range(3, len(f) - 2)]
            if cuts and max(cuts)[0] >= 6:
                k = max(cuts)[2]
                best["s" + f[:k]] += 1
                best["e" + f[k:]] += 1
        self.stems = {k[1:] for k, n in best.items() if k[0] == "s" and n >= 2}
        self.ends = {k[1:] for k, n in best.items() if k[0] == "e" and n >= 2}
        self.memo: dict[str, bool] = {}

    def is_family(self, word: str) -> bool:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = word in self.family or any(word[:k] in self.stems and word[k:] in self.ends for k in range(3, len(word) - 2))
            self.memo[word] = got
        return got


# Words that introduce a name.
_BEFORE_NAME = frozenset("and as by cc dear dr from hello hi in is miss mr mrs ms per prof regards thanks to was with".split())
_OPENERS = frozenset("\n.;:!?–—|([\"“")


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _word_before(text: str, end: int) -> int:
    """Where the word that ends at ``end`` begins; ``end`` itself where none does."""
    while end and _letter(text[end - 1]):
        end -= 1
    return end


def _given_before(text: str, end: int) -> int | None:
    """Where a word, or two joined by a hyphen, begins that stands before ``end`` and one blank."""
    if not end or text[end - 1] != " ":
        return None
    at = _word_before(text, end - 1)
    if at == end - 1:
        return None
    if at > 1 and text[at - 1] == "-" and (more := _word_before(text, at - 1)) < at - 1:
        at = more
    return None if at and (text[at - 1].isalnum() or text[at - 1] in "_.@+'’-") else at


def _is_given(text: str, at: int, word: str, family: str, lex: Lexicon) -> bool:
    """Known given names in any case; others where they are written like the family name and stand where a name begins."""
    low = word.lower()
    if low in lex.given or low.split("-")[0] in lex.given:
        return True
    if low in _NOT_GIVEN or len(low) < 2:
        return False
    if word.islower() and family.islower():
        end = at
        while end and text[end - 1].isspace() and text[end - 1] != "\n":
            end -= 1
        if not end or text[end - 1] in _OPENERS:
            return True
        end = at - 1 - (text[at - 2 : at - 1] == ".") if text[at - 1].isspace() else at
        return text[_word_before(text, end) : end].lower() in _BEFORE_NAME
    return (word.istitle() and family.istitle()) or (word.isupper() and family.isupper())


def _names(text: str, low: str, lex: Lexicon):
    """(start, end) of every full name."""
    tokens = [m for m in _WORD.finditer(text) if lex.is_family(low[m.start() : m.end()] if len(low) == len(text) else m[0].lower())]
    done = -1
    for i, m in enumerate(tokens):
        s, e = m.start(), m.end()
        if s < done:
            continue
        j = i + 1
        while j < len(tokens) and tokens[j].start() == e + 1 and text[e] == "-":
            e, j = tokens[j].end(), j + 1
        if text[e : e + 1] in ("@", "_") or text[e : e + 2] == "-" or (text[e : e + 1] in ".+" and text[e + 1 : e + 2].isalnum()):
            continue
        if s >= 2 and text[s - 1] in "'’" and text[s - 2] in "OoDd":
            s -= 2
        if s and (text[s - 1].isalnum() or text[s - 1] in "@._+-/#"):
            continue
        start = s
        while start and text[start - 1].isspace():
            at = _word_before(text, start - 1)
            if (at and not text[at - 1].isspace()) or text[at : start - 1].lower() not in _PARTICLES:
                break
            start = at
        mid = _MIDDLE.search(text[max(0, start - 16) : start])  # three initials are at most nine characters
        inner = start - len(mid[1]) if mid else start
        first = _given_before(text, inner)
        if first is not None and _is_given(text, first, text[first : inner - 1], text[m.start() : m.end()], lex):
            while (more := _given_before(text, first)) is not None and text[more : first - 1].lower() in lex.given:
                first = more
            yield first, e
            done = e
            continue
        a = _AFTER.match(text, e)
        if a and (a[1].lower() in lex.given or (a[1].istitle() and text[m.start() : m.end()].istitle() and a[1].lower() not in _NOT_GIVEN)):
            yield start, a.end()
            done = a.end()
            continue
        if mid:
            yield inner, e
            done = e
            continue
        a = _INITIAL_AFTER.match(text, e)
        if a:
            yield start, a.end()
            done = a.end()


def _addresses(text: str):
    for m in _ENGLISH.finditer(text):
        kind, end = m["kind"].lower(), m.end()
        if not m["unit"] and not m["town"]:
            continue
        lower_case = m[0] == m[0].lower()
        if lower_case and not (m["town"] and kind in _SURE_KINDS):
            continue
        if not lower_case and m["town"] and not m["unit"] and m["town"].strip(", ").islower():
            continue
        if m["unit"] and m["town"] and m["town"].strip(", ").islower() and not lower_case:
            end = m.start("town")
        yield m.start(), end
    for m in _CONTINENTAL.finditer(text):
        yield m.start(), m.end()


# An address holds one of these.
_STREET_SIGNS = (
    "street avenue road lane drive close court place square terrace boulevard crescent parkway highway way blvd hwy st. ave. rd. ln. dr. ct. pl. sq. "
    "rue chemin impasse all quai route cours calle avenida avda c/ plaza paseo camino carrer via piazza rua straße strasse str. weg gasse platz ring damm ufer"
).split() + [" st,", " ave,", " rd,", " ln,", " dr,", " ct,", " pl,", " sq,"]
_SURE_KINDS = set(_SURE.strip("(?:)").split("|"))
_DIGIT = re.compile(r"\d")


def find(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, type) of every mention, in order, without overlaps."""
    if not text:
        return []
    low = text.lower()
    got: list[tuple[int, int, int]] = []
    if "@" in text or "＠" in text or "(at)" in low or "[at]" in low or (" at " in low and " dot " in low):
        got += [(m.start(), m.end(), 0) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        got += [(m.start(), m.end(), 1) for m in _IDS.finditer(text)]
        got += [(m.start(1), m.end(1), 1) for m in _LABELLED_ID.finditer(text)]
        got += [(m.start(), m.end(), 2) for m in _PHONE.finditer(text)]
        got += [(m.start(1), m.end(1), 2) for m in _CUED_PHONE.finditer(text)]
        if any(k in low for k in _STREET_SIGNS):
            got += [(s, e, 3) for s, e in _addresses(text)]
    got += [(s, e, 4) for s, e in _names(text, low, lex)]
    if len(got) > 1:
        got.sort(key=lambda x: (x[2], x[0] - x[1], x[0]))
        kept: list[tuple[int, int, int]] = []
        for x in got:
            if all(x[1] <= y[0] or x[0] >= y[1] for y in kept):
                kept.append(x)
        got = sorted(kept)
    return [(s, e, TYPES[k]) for s, e, k in got]


def lexicon(entities: DataFrame) -> Lexicon:
    """The lexicon of the person rows; raises where their names hold more than LEXICON_MAX distinct words."""
    words = F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}&&[^\p{Nd}]]+"), F.lit(0))
    people = entities.where("entity_type = 'person' and name is not null").select(words.alias("w")).where(F.size("w") >= 2)
    given = people.select(F.col("w")[0].alias("w"), F.lit(True).alias("given"))
    family = people.select(F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("w"), F.lit(False).alias("given"))
    rows = given.unionByName(family).distinct().limit(LEXICON_MAX + 1).collect()
    if len(rows) > LEXICON_MAX:
        raise ValueError("more words of names than the lexicon may hold")
    return Lexicon({r["w"] for r in rows if r["given"]}, {r["w"] for r in rows if not r["given"]})


def sources(facts: DataFrame, observations: DataFrame, gold: DataFrame) -> DataFrame:
    """(source_table, record_key, item_no, text) of the three fields."""
    items = gold.select(F.col("case_id").alias("record_key"), F.posexplode("facts").alias("item_no", "f"))
    cols = ["source_table", "record_key", "item_no", "text"]
    parts = [
        facts.select(F.lit("facts").alias("source_table"), F.col("fact_id").cast("string").alias("record_key"), F.lit(0).cast("long").alias("item_no"), F.col("content").alias("text")),
        observations.select(F.lit("observations").alias("source_table"), F.col("observation_id").cast("string").alias("record_key"), F.lit(0).cast("long").alias("item_no"), F.col("observation_content").alias("text")),
        items.select(F.lit("transcript_gate_gold").alias("source_table"), "record_key", F.col("item_no").cast("long"), F.col("f.evidence_excerpt").alias("text")),
    ]
    return parts[0].select(cols).unionByName(parts[1].select(cols)).unionByName(parts[2].select(cols))


def mentions(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """(source_table, record_key, item_no, start, stop, pii_type, mention): every mention with its place."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        import pyarrow as pa

        lex = shared.value
        schema = pa.schema([("source_table", pa.string()), ("record_key", pa.string()), ("item_no", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("pii_type", pa.string()), ("mention", pa.string())])
        for b in batches:
            row, start, stop, kind, said = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for s, e, k in find(t, lex):
                    row.append(i)
                    start.append(s)
                    stop.append(e)
                    kind.append(k)
                    said.append(t[s:e])
            keys = [b.column(c).take(pa.array(row, pa.int64())) for c in ("source_table", "record_key", "item_no")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(kind, pa.string()), pa.array(said, pa.string())], schema=schema)

    return texts.where(F.length("text") > 0).mapInArrow(run, "source_table string, record_key string, item_no long, start int, stop int, pii_type string, mention string")


def found(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """p1_found: one row per distinct mention in a text."""
    m = mentions(texts, lex)
    return m.select("source_table", "record_key", "item_no", "pii_type", "mention").distinct()


def redacted(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """(source_table, record_key, item_no, redacted): the text with ``[EMAIL]`` and the like in place of mentions."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        import pyarrow as pa

        lex = shared.value
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                at, parts = 0, []
                for s, e, k in find(t, lex):
                    parts += [t[at:s], f"[{k.upper()}]"]
                    at = e
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("source_table"), b.column("record_key"), b.column("item_no"), pa.array(out, pa.string())], ["source_table", "record_key", "item_no", "redacted"])

    return texts.mapInArrow(run, "source_table string, record_key string, item_no long, redacted string")


# ---- surrogates -------------------------------------------------------------------------------

# Consonants and vowels that syllables are made of, and the endings of feminine, masculine and other given names.
_SYLLABLES = {
    "LATIN": ("b d f g k l m n p r s t v z br dr kr tr".split(), "a e i o u".split(), ("a", "n r s t l d m k".split(), "e")),
    "CYRILLIC": ("б д ф г к л м н п р с т в з бр др кр тр".split(), "а е и о у".split(), ("а", "н р с т л д м к".split(), "е")),
    "GREEK": ("β δ φ γ κ λ μ ν π ρ σ τ χ ζ βρ δρ κρ τρ".split(), "α ε ι ο υ".split(), ("α", ["ος", "ης", "ας"], "ι")),
}
# Given names that are usually borne by women, and by men (plain forms).
_WOMEN = frozenset(
    "adele agnes aisha alice amelia amina ana andrea anita anna anne astrid barbara beatriz begona birgit brigitte camille carla carmen caroline cecile chloe "
    "clara dalia diana dorothea elena elise elke elodie emily emma esther eva fatima fiona freya gisela greta hanna hannah hedda helen ilse ines ingrid irene "
    "iris isabel ivy jane jasmin jasmine joan judith julia karen karin katrin klara laila laura leonie lucia lucinda lucja lucy mara margaret maria marie "
    "mary miriam mirella monique nadia nina noor odile olga olympia paloma petra rachel renee rhea rosalind ruth sarah signe sofia sophie susan tamsin "
    "thea tilda ursula vesna wanda xenia yvonne zelda zoe".split()
)
_MEN = frozenset(
    "adam ahmed alan albert alex amos anders andre andrew anselm anton arthur bastian ben bruno carl caspian charles corwin daniel david dennis emil eric "
    "farid felix frank friedrich george gideon hamid hans harry henry hugo igor inaki ivo jack james jean joel john jonas jose joseph jovan juan jurgen karl "
    "kaspar kevin kim klaus lars leo lorenz louis lucas luke marc mark martin matteo max michael mike milo niko nils noah oliver oscar oskar otto paul pavel "
    "peter philip quentin ralph renko robert ruben samuel silas simon soren stellan stephen thomas tobias tom umberto victor viktor walter william yusuf".split()
)
# Titles and pronouns that tell a gender.
_HERS = frozenset("ms mrs miss madam frau mme mlle sra srta signora she her hers herself ella elle".split())
_HIS = frozenset("mr sir herr sr señor signor monsieur he him his himself".split())
# Country calling codes of one and of two digits; all others have three.
_SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Fixed value: the check letters of Spanish identity numbers by the remainder of 23.
_CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
# Words of an address and of a domain that tell nothing of a person.
_ADDRESS_WORDS = frozenset(
    "flat apt apartment unit suite ste floor fl room rm no street avenue road lane drive close court place square terrace boulevard crescent parkway highway way st ave rd ln dr ct "
    "pl sq terr blvd hwy north south east west rue chemin impasse allee quai route cours de du des la le los las bis ter quater calle avenida avda plaza paseo camino "
    "carrer via viale piazza rua da do del bad saint sankt san santa new el upper lower great port".split()
)
_ORDINALS = frozenset("st nd rd th er eme ème e º ª".split())
_STREET_END = re.compile(r"(straße|strasse|str|weg|gasse|platz|allee|ring|damm|ufer)$", re.I)
_DOMAIN_WORDS = frozenset("mail www co com org net ac edu gov".split())
_MARK = re.compile(r"@|＠|\s?\(at\)\s?|\s?\[at\]\s?|\sat\s", re.I)
_RUN = re.compile(r"[^\W_]+")
#: A part that is drawn this often has no free surrogate left.
MAX_DRAWS = 500


def _digest(key: str, *parts: object) -> int:
    return int.from_bytes(hmac.new(key.encode(), "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def _feistel(digits: str, key: str, sign: int) -> str:
    n = len(digits)
    h = n // 2
    a, b = int(digits[:h]), int(digits[h:])
    for r in range(0, 8, 2) if sign > 0 else range(6, -1, -2):
        if sign > 0:
            a = (a + _digest(key, n, r, b)) % 10**h
            b = (b + _digest(key, n, r + 1, a)) % 10 ** (n - h)
        else:
            b = (b - _digest(key, n, r + 1, a)) % 10 ** (n - h)
            a = (a - _digest(key, n, r, b)) % 10**h
    return f"{a:0{h}d}{b:0{n - h}d}"


def permute_digits(digits: str, key: str) -> str:
    """A keyed bijection without fixed points on digit strings of one length; a first digit other than 0 stays other than 0.

    A keyed network on the two halves numbers the strings, and each gets its
    successor: one cycle over all of them, in which those with a leading zero
    are passed over.
    """
    n = len(digits)
    if not n or not digits.isascii():
        return digits
    whole = 10**n
    lead = digits[0] != "0"
    while True:
        if n == 1:
            order = sorted(range(10), key=lambda d: _digest(key, "one", d))
            digits = str(order[(order.index(int(digits)) + 1) % 10])
        else:
            place = (int(_feistel(digits, key, 1)) + 1) % whole
            digits = _feistel(f"{place:0{n}d}", key, -1)
        if not lead or digits[0] != "0":
            return digits


@cache
def _alphabet(script: str) -> tuple[str, ...]:
    """The lower-case or caseless letters of a script, by their Unicode names."""
    if script == "LATIN":
        return tuple("abcdefghijklmnopqrstuvwxyz")
    reach = range(0x4E00, 0x9FA6) if script == "CJK" else range(0xAC00, 0xD7A4) if script == "HANGUL" else range(0x370, 0x3100)
    got = [chr(c) for c in reach if unicodedata.name(chr(c), "").startswith((script + " LETTER", script + " SMALL LETTER", script + " CHARACTER", script + " UNIFIED", script + " SYLLABLE"))]
    got = [c for c in got if unicodedata.category(c) in ("Lo", "Ll") and not unicodedata.decomposition(c)]
    if script == "GREEK":
        got = list("αβγδεζηθικλμνξοπρστυφχψω")
    if script == "CYRILLIC":
        got = list("абвгдежзиклмнопрстуфхцчшэюя")
    return tuple(got) or tuple("abcdefghijklmnopqrstuvwxyz")


@cache
def _letter_map(script: str, key: str, label: str) -> dict[str, str]:
    """A keyed permutation of an alphabet without fixed points."""
    order = sorted(_alphabet(script), key=lambda c: _digest(key, label, c))
    return dict(zip(order, order[1:] + order[:1], strict=True))


def _dress(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def initial(letter: str, key: str) -> str:
    """The first letter that given names with this one get."""
    low = plain(letter)[:1] or letter
    return _letter_map(_script(low), key, "initial").get(low, low)


def draw_word(word: str, kind: str, key: str, gender: str = "", attempt: int = 0) -> str:
    """Keyed syllables for a plain word, or keyed letters in scripts without a table of syllables."""
    script = _script(word)
    n = _digest(key, kind, word, attempt)
    if script not in _SYLLABLES:
        letters = _alphabet(script)
        out = ""
        for _ in range(len(word) + attempt // 8):  # longer where all of this length are taken
            n, i = divmod(n, len(letters))
            out += letters[i]
            n = n or _digest(key, kind, word, attempt, out)
        return initial(word[0], key) + out[1:] if kind == "given" and len(out) > 1 else out
    starts, vowels, (woman, man, other) = _SYLLABLES[script]
    out = ""
    for _ in range((3 if len(word) < 7 else 4) + attempt // 8):
        n, i = divmod(n, len(starts))
        n, j = divmod(n, len(vowels))
        out += starts[i] + vowels[j]
    if kind != "given":
        return out
    first = initial(word[0], key)
    out = first + (out[len(out) - len(out.lstrip("".join(starts))) :] if first not in vowels else out)
    return out[:-1] + woman if gender == "f" else out + man[n % len(man)] if gender == "m" else out[:-1] + other


def _draw_id(text: str, key: str) -> str:
    """An identity number of the same shape: digits permuted, letters mapped, check letters computed."""
    digits = "".join(c for c in text if c.isdecimal())
    new = permute_digits(digits, key)
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", text) and len(text) == 9:
        head = text[0] if text[0] in "XYZ" else ""
        return head + new + _CHECK_LETTERS[int(("XYZ".find(head) if head else 0) * 10**7 + int(new)) % 23]
    letters = _letter_map("LATIN", key, "id")
    fill = iter(new)
    out = [next(fill) if c.isdecimal() else letters.get(c.lower(), c).upper() for c in text]
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", text):
        out[-1] = "ABCD"[("ABCD".index(text[-1]) + 1 + _digest(key, "suffix") % 3) % 4]
    return "".join(out)


def draw(kind: str, part: str, gender: str, key: str, attempt: int) -> str:
    """The surrogate of a part: a word, the digits of a phone number, or an identity number."""
    if kind == "number":
        return permute_digits(part, f"{key}/{attempt}")
    if kind == "id":
        return _draw_id(part, f"{key}/{attempt}")
    return draw_word(part, kind, key, gender, attempt)


def _spread_over(text: str, at: int, new: str) -> str:
    """The text with its digits and letters from a place on replaced one after the other; a letter's case stays."""
    fill = iter(new)
    return text[:at] + "".join(c if not c.isalnum() else (x.lower() if c.islower() else x) if (x := next(fill, None)) is not None else c for c in text[at:])


def rebuild(mention: str, kind: str, lex: Lexicon, key: str, say: Callable[[str, str], str]) -> str:
    """The mention with each of its parts replaced by what ``say(part kind, part)`` gives."""
    if kind == "person_name":
        comma = mention.find(",")

        def named(m: re.Match) -> str:
            w = m[0]
            if len(w) == 1:
                return _dress(initial(w, key), w) if mention[m.end() : m.end() + 1] == "." else w
            first = m.start() > comma if comma >= 0 else m.start() == 0
            if not first and w.lower() in _PARTICLES:
                return w
            middle = comma < 0 and plain(w) in lex.plain_given and m.end() < len(mention)
            # both halves of a hyphenated given name are given names
            after_given = comma < 0 and "-" in mention[: m.start()] and " " not in mention[: m.start()]
            return _dress(say("given" if first or middle or after_given else "family", plain(w)), w)

        return _WORD.sub(named, mention)
    if kind == "email":
        mark = _MARK.search(mention)
        local, domain = mention[: mark.start()], mention[mark.end() :]

        def owner(m: re.Match) -> str:
            w, low = m[0], plain(m[0])
            if low in lex.plain_given:
                return _dress(say("given", low), w)
            if lex.is_family(low):
                return _dress(say("family", low), w)
            if lex.is_family(low[1:]):
                return _dress(initial(low[0], key) + say("family", low[1:]), w)
            return _dress(say("local", low), w)

        local = re.sub(r"\d+", lambda m: permute_digits(m[0], key), _WORD.sub(owner, local))
        labels = re.split(rf"({_DOT})", domain, flags=re.I)
        head = [x if i % 2 or x.lower() in _DOMAIN_WORDS else _WORD.sub(lambda m: _dress(say("domain", plain(m[0])), m[0]), x) for i, x in enumerate(labels[:-2])]
        return local + mark[0] + "".join(head + labels[-2:])
    if kind == "street_address":

        def placed(m: re.Match) -> str:
            w = m[0]
            if w.isdecimal():
                return permute_digits(w, key)
            if any(c.isdecimal() for c in w):  # house numbers with a letter, ordinals, postcodes
                tail = w.lstrip("0123456789")
                letters = _letter_map("LATIN", key, "code")
                if tail.lower() in _ORDINALS:
                    return permute_digits(w[: len(w) - len(tail)], key) + tail
                return re.sub(r"\d+", lambda d: permute_digits(d[0], key), "".join(_dress(letters[c.lower()], c) if c.lower() in letters else c for c in w))
            if plain(w) in _ADDRESS_WORDS or (len(w) == 1 and w.lower() in "nsewc"):
                return w
            if len(w) <= 2 and w.isupper():  # the outer letters of a postcode, or a state
                letters = _letter_map("LATIN", key, "code")
                return "".join(_dress(letters.get(c.lower(), c), c) for c in w)
            end = _STREET_END.search(w)
            stem = w[: end.start()] if end else w
            return (_dress(say("place", plain(stem)), stem) if stem else "") + (end[0] if end else "")

        return _RUN.sub(placed, mention)
    if kind == "phone":
        ext = re.search(r"(?:,?\s?(?:ext\.?|x|extension|#)\s?)(\d{1,6})$", mention, re.I)
        main, tail = (mention[: ext.start(1)], permute_digits(ext[1], key)) if ext else (mention, "")
        at = 0
        if m := re.match(r"\+|00", main):
            code = next((c for k in (1, 2, 3) if (c := re.match(r"\d*", main[m.end() : m.end() + k])[0]) in _SHORT_CODES), main[m.end() : m.end() + 3])
            at = m.end() + len(re.match(r"\d*", code)[0])
            if zero := re.match(r"\s?\(0\)", main[at:]):
                at += zero.end()
        elif m := re.match(r"\(?0(?=\d)", main):  # the trunk prefix
            at = m.end()
        digits = "".join(c for c in main[at:] if c.isdecimal())
        return (_spread_over(main, at, say("number", digits)) if digits else main) + tail
    bare = "".join(c for c in mention if c.isalnum()).upper()
    return _spread_over(mention, 0, say("id", bare))


def _parts(lex, key: str):
    """Batches of (pii_type, mention) to (pii_type, mention, kind, part)."""

    def run(batches):
        import pyarrow as pa

        lexicon = lex.value
        for b in batches:
            rows = []
            for t, m in zip(b.column("pii_type").to_pylist(), b.column("mention").to_pylist(), strict=True):
                said: set[tuple[str, str]] = set()
                rebuild(m, t, lexicon, key, lambda k, p, said=said: said.add((k, p)) or p)
                rows += [(t, m, k, p) for k, p in sorted(said)] or [(t, m, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["pii_type", "mention", "kind", "part"])

    return run


def genders(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """(part, gender): given names with the gender that titles before them and pronouns after them in the corpus mostly tell."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        import pyarrow as pa

        lexicon = shared.value
        for b in batches:
            votes: Counter = Counter()
            for t in b.column("text").to_pylist():
                if not t or not any(True for _ in _TELLING.finditer(t)):
                    continue
                names = [(s, e) for s, e, k in find(t, lexicon) if k == "person_name" and "," not in t[s:e]]
                for (s, e), nxt in zip(names, [*(x[0] for x in names[1:]), len(t)], strict=True):
                    given = plain(_WORD.search(t, s)[0])
                    at = s - 1 - (t[s - 2 : s - 1] == ".")
                    title = t[_word_before(t, at) : at].lower() if s > 1 else ""
                    stop = next((m.start() for m in re.finditer(r"[.!?\n]", t[e:nxt])), nxt - e)
                    said = {title, *(w.lower() for w in _WORD.findall(t[e : e + stop]))}
                    votes[given] += bool(said & _HERS) - bool(said & _HIS)
            yield pa.RecordBatch.from_arrays([pa.array(list(votes), pa.string()), pa.array(list(votes.values()), pa.int64())], ["part", "votes"])

    votes = texts.select("text").where(F.length("text") > 0).mapInArrow(run, "part string, votes long").groupBy("part").agg(F.sum("votes").alias("votes"))
    return votes.where("votes != 0").select("part", F.when(F.col("votes") > 0, "f").otherwise("m").alias("gender"))


_TELLING = re.compile(r"\b(?:" + "|".join(sorted(_HERS | _HIS)) + r")\b", re.I)


def usual_gender(given: str) -> str:
    """f, m or nothing, by the table and then by the ending."""
    return "f" if given in _WOMEN else "m" if given in _MEN else "f" if given.endswith(("a", "а", "я", "α")) else ""


def _draws(key: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("kind", "part", "gender", "attempt")}
            new = [draw(k, p, g if g is not None else usual_gender(p), key, a) for k, p, g, a in zip(c["kind"], c["part"], c["gender"], c["attempt"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("part"), b.column("gender"), b.column("attempt"), pa.array(new, pa.string())], ["kind", "part", "gender", "attempt", "new"])

    return run


def drawn_parts(parts: DataFrame, key: str, cut: Cut) -> DataFrame:
    """(kind, part, new): every part with a surrogate that no other part of its kind has and that is no part itself.

    ``parts``: distinct (kind, part, gender). Clashes are found by one grouping
    and one join, and drawn again until there are none; the smallest part keeps
    a surrogate that several drew.
    """
    schema = "kind string, part string, gender string, attempt int, new string"
    sort = F.when(F.col("kind").isin("number", "id"), F.col("kind")).otherwise("word")
    real = cut(parts.select(sort.alias("sort"), F.col("part").alias("new")).distinct(), "real")
    good = cut(parts.withColumn("attempt", F.lit(0)).mapInArrow(_draws(key), schema), "drawn")
    for _ in range(MAX_DRAWS):
        # of one kind's equal draws the smallest part keeps its own; every other row is drawn again
        keeps = good.groupBy("kind", "new").agg(F.min("part").alias("keeper"), F.count(F.lit(1)).alias("n"))
        held = keeps.withColumn("sort", sort).join(real.withColumn("real", F.lit(True)), ["sort", "new"], "left").where("n > 1 or real").select("kind", "new", F.when(F.col("real").isNull(), F.col("keeper")).alias("keeper"))
        held = cut(held, "clashes")
        if held.isEmpty():
            return good.select("kind", "part", "new")
        marked = good.join(held.withColumn("clash", F.lit(True)), ["kind", "new"], "left").withColumn("bad", F.col("clash").isNotNull() & ~F.col("part").eqNullSafe(F.col("keeper")))
        again = marked.where("bad").select("kind", "part", "gender", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_draws(key), schema)
        new = cut(marked.where("not bad").select(*good.columns).unionByName(again), "drawn")
        cut.drop(good)
        good = new
    raise RuntimeError("some parts have no free surrogate left")


def surrogates(found_mentions: DataFrame, lex: Lexicon, key: str, told: DataFrame | None = None) -> DataFrame:
    """(pii_type, mention, surrogate): distinct mentions with distinct surrogates that are no mentions themselves.

    ``key`` is the secret that makes them repeatable; ``told``: (part, gender)
    as ``genders`` gives it. Mentions that differ only in letter case share a
    surrogate but for its case.
    """
    spark = found_mentions.sparkSession
    ship(spark)
    if not key:
        raise ValueError("surrogates need a secret key")
    cut = Cut(spark, "surrogates")
    shared = spark.sparkContext.broadcast(lex)
    every = found_mentions.select("pii_type", "mention").distinct()
    long = cut(every.mapInArrow(_parts(shared, key), "pii_type string, mention string, kind string, part string"), "parts")
    parts = long.where("kind is not null").select("kind", "part").distinct()
    if told is None:
        parts = parts.withColumn("gender", F.lit(None).cast("string"))
    else:
        parts = parts.join(told.withColumn("kind", F.lit("given")), ["kind", "part"], "left").select("kind", "part", "gender")
    good = drawn_parts(parts, key, cut)
    swaps = long.join(good, ["kind", "part"], "left").groupBy("pii_type", "mention").agg(F.collect_list(F.struct("kind", "part", "new")).alias("swaps"))

    def run(batches):
        import pyarrow as pa

        lexicon = shared.value
        for b in batches:
            out = []
            for t, m, swap in zip(b.column("pii_type").to_pylist(), b.column("mention").to_pylist(), b.column("swaps").to_pylist(), strict=True):
                new = {(x["kind"], x["part"]): x["new"] for x in swap}
                out.append(rebuild(m, t, lexicon, key, lambda k, p, new=new: new[k, p]))
            yield pa.RecordBatch.from_arrays([b.column("pii_type"), b.column("mention"), pa.array(out, pa.string())], ["pii_type", "mention", "surrogate"])

    return swaps.mapInArrow(run, "pii_type string, mention string, surrogate string")


def pseudonymised(texts: DataFrame, lex: Lexicon, key: str) -> DataFrame:
    """(source_table, record_key, item_no, pseudonymised): the texts with surrogates in place of mentions."""
    cut = Cut(texts.sparkSession, "pseudonyms")
    m = cut(mentions(texts, lex), "mentions")
    swaps = (
        m.join(surrogates(m, lex, key, genders(texts, lex)), ["pii_type", "mention"])
        .groupBy("source_table", "record_key", "item_no").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "surrogate"))).alias("swaps"))
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, swap in zip(b.column("text").to_pylist(), b.column("swaps").to_pylist(), strict=True):
                at, parts = 0, []
                for x in swap or ():
                    parts += [t[at : x["start"]], x["surrogate"]]
                    at = x["stop"]
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("source_table"), b.column("record_key"), b.column("item_no"), pa.array(out, pa.string())], ["source_table", "record_key", "item_no", "pseudonymised"])

    joined = texts.join(swaps, ["source_table", "record_key", "item_no"], "left")
    return joined.mapInArrow(run, "source_table string, record_key string, item_no long, pseudonymised string")
