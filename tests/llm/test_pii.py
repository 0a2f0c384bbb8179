import pytest

from factloom.llm import pii
from factloom.llm.pii import Lexicon, find, permute_digits

FAMILIES = [f"{s}{e}" for s in ("calq", "holv", "plinz", "varnol") for e in ("ashti", "embry", "istadt")]
LEX = Lexicon({"zelda", "niko", "iñaki", "greta", "george", "ingrid", "carmen"}, set(FAMILIES))
KEY = "a secret of the tests"


def said(text):
    return [(k, text[s:e]) for s, e, k in find(text, LEX)]


@pytest.mark.parametrize("text,want", [
    ("write to zelda@example.com.", [("email", "zelda@example.com")]),
    ("ZELDA [AT] MAIL [DOT] EXAMPLE gets it", [("email", "ZELDA [AT] MAIL [DOT] EXAMPLE")]),
    ("zelda at mail dot example is", [("email", "zelda at mail dot example")]),
    ("see git@host-mirror:a/b.git, ping @x-bot, tool-cli@2.3.4", []),
    ("call +1 (202) 555-0156 ext. 12 or 030/23125100", [("phone", "+1 (202) 555-0156 ext. 12"), ("phone", "030/23125100")]),
    ("checksum 191527-28-5310, build 2024-10-771313, order PO-424-22-5191, 10.0.11.12:8018", []),
    ("SSN 666 90 6274 and DNI: 00076523W", [("id_number", "666 90 6274"), ("id_number", "00076523W")]),
    ("ni no. qq 12 34 56 c", [("id_number", "qq 12 34 56 c")]),
    ("at 140 N. Larkmoor Street, Unit 12C for", [("street_address", "140 N. Larkmoor Street, Unit 12C")]),
    ("lives at Flat 10, 120 Stonefold Avenue, Eddisford.", [("street_address", "Flat 10, 120 Stonefold Avenue, Eddisford")]),
    ("16 bis rue de Oakhanger, 26476 Eddisford – x", [("street_address", "16 bis rue de Oakhanger, 26476 Eddisford")]),
    ("Larkmoorstraße 45a, 22289 Eddisford", [("street_address", "Larkmoorstraße 45a, 22289 Eddisford")]),
    ("18 thistledown lane, villaluz. next", [("street_address", "18 thistledown lane, villaluz")]),
    ("section 7235 Road Map covers it; board ferry Street has a 3", []),
    ("Dr. Zelda M. Calqashti called", [("person_name", "Zelda M. Calqashti")]),
    ("cc Holvembry, Greta, who owns", [("person_name", "Holvembry, Greta")]),
    ("as Z. Plinzistadt asked", [("person_name", "Z. Plinzistadt")]),
    ("per Iñaki van der Calqembry's request", [("person_name", "Iñaki van der Calqembry")]),
    ("Lucinda Varnolashti-Holvembry signed", [("person_name", "Lucinda Varnolashti-Holvembry")]),
    ("per mara calqashti-plinzembry's request; the quiet calqashti group", [("person_name", "mara calqashti-plinzembry")]),
    ("Zelda signed; as Calqashti asked; team nornavane; zelda.calqashti@example.org", [("email", "zelda.calqashti@example.org")]),
    ("", []),
])
def test_find(text, want):
    assert said(text) == want


def test_long_text_is_read_whole():
    text = "x " * 400_000 + "zelda@example.com"
    assert said(text) == [("email", "zelda@example.com")]
    name = "Zelda " + "van der " * 40 + "Calqashti"
    assert said("as " + name) == [("person_name", name)]
    assert said(" " * 500 + "\n" + "zelda calqashti") == [("person_name", "zelda calqashti")]
    assert said("a " + "y" * 90 + "greta calqashti") == []  # one long word, not a known name behind it


# Sentences unlike those of the test tables.
@pytest.mark.parametrize("text,want", [
    ("You can dial 4155550136 99 in an emergency; the landline is at 020 7946 0018.", [("phone", "4155550136 99"), ("phone", "020 7946 0018")]),
    ("Rota for Tuesday: Niko Holvembry (nights), Greta Plinzashti (days).", [("person_name", "Niko Holvembry"), ("person_name", "Greta Plinzashti")]),
    ("{\"owner\": \"Zelda Calqembry\", \"mail\": \"z.calqembry@intranet.example\"}", [("person_name", "Zelda Calqembry"), ("email", "z.calqembry@intranet.example")]),
    ("Parcel left at 77 Quenby Road, Flat 3, Mittelbronn, thanks", [("street_address", "77 Quenby Road, Flat 3, Mittelbronn")]),
    ("her passport X1234567 expired; ticket X-1234, v1.2.3.4", [("id_number", "X1234567")]),
    ("approved by IÑAKI HOLVEMBRY / reviewed by g. holvembry", [("person_name", "IÑAKI HOLVEMBRY"), ("person_name", "g. holvembry")]),
    ("Holvembry wrote the holvembry module for team holvembry-tools", []),
])
def test_find_in_other_sentences(text, want):
    assert said(text) == want


def test_digit_permutation_is_a_bijection_without_fixed_points():
    for n in (1, 2, 4):
        got = {f"{i:0{n}d}": permute_digits(f"{i:0{n}d}", "k") for i in range(10**n)}
        plain = {k: v for k, v in got.items() if k[0] != "0"}
        assert len(set(plain.values())) == len(plain) and all(v[0] != "0" and v != k for k, v in plain.items())


def made(mention, kind, gender=""):
    return pii.rebuild(mention, kind, LEX, KEY, lambda k, p: pii.draw(k, p, gender or pii.usual_gender(p), KEY, 0))


def test_gender_shows():
    for name in ("Zelda", "Ingrid", "Carmen", "Greta"):
        assert made(f"{name} Holvembry", "person_name").split()[0].endswith("a")
    for name in ("George", "Niko", "Iñaki"):
        assert made(f"{name} Holvembry", "person_name").split()[0][-1] not in "aeiou"
    assert made("Quorin Holvembry", "person_name").split()[0].endswith("e")
    assert made("Quorin Holvembry", "person_name", "f").split()[0].endswith("a")


@pytest.mark.parametrize("name,script", [("Анна Иванова", "CYRILLIC"), ("Ελένη Παππά", "GREEK"), ("山田 太郎", "CJK"), ("ليلى حداد", "ARABIC"), ("דוד לוי", "HEBREW"), ("김 민수", "HANGUL"), ("さくら たなか", "HIRAGANA"), ("Zelda Plin", "LATIN")])
def test_script_stays(name, script):
    import unicodedata

    new = made(name, "person_name")
    assert new != name and {unicodedata.name(c).split(" ")[0] for c in new if c.isalpha()} == {script}


@pytest.mark.parametrize("kind,mention,shape", [
    ("street_address", "Flat 3, 12 Quenby Road, Eddisford, AB1 2CD", r"Flat [1-9], \d\d [A-Z][a-z]+ Road, [A-Z][a-z]+, [A-Z]{2}\d \d[A-Z]{2}"),
    ("street_address", "C/ Larkmoor 2, 7º, 18241 Nordhalm", r"C/ [A-Z][a-z]+ \d, \dº, \d{5} [A-Z][a-z]+"),
    ("id_number", "QQ 12 34 56 C", r"[A-Z]{2} \d\d \d\d \d\d [ABD]"),
    ("id_number", "00095196E", r"\d{8}[A-Z]"),
    ("id_number", "qq 12 34 56 c", r"[a-z]{2} \d\d \d\d \d\d [abd]"),
    ("phone", "+1 (202) 555-0156 ext. 12", r"\+1 \(\d{3}\) \d{3}-\d{4} ext\. \d\d"),
    ("phone", "030/23125186", r"0\d\d/\d{8}"),
    ("email", "ZELDA.HOLVEMBRY77 [at] Oldra [dot] co [dot] example", r"[A-Z]+\.[A-Z]+\d\d \[at\] [A-Z][a-z]+ \[dot\] co \[dot\] example"),
])
def test_format_stays(kind, mention, shape):
    import re

    new = made(mention, kind)
    assert re.fullmatch(shape, new), new
    assert new != mention
    if kind == "id_number" and len(mention) == 9:
        assert "TRWAGMYFPDXBNJZSQVHLCKE"[int(new[:8]) % 23] == new[8]


def test_one_person_and_one_number_in_all_forms():
    given, family = made("Zelda Holvembry", "person_name").split()
    assert made("Holvembry, Zelda", "person_name") == f"{family}, {given}"
    assert made("Z. Holvembry", "person_name") == f"{given[0]}. {family}"
    assert made("zelda.holvembry@x.example", "email").startswith(f"{given}.{family}@".lower())
    assert made("zholvembry@x.example", "email").startswith(f"{given[0]}{family}@".lower())
    assert made("inaki@x.example", "email").split("@")[0] == pii.plain(made("Iñaki Holvembry", "person_name").split()[0])
    digits = lambda x: "".join(c for c in x if c.isdigit())
    assert digits(made("+1 (202) 555-0156", "phone"))[1:] == digits(made("202.555.0156", "phone")) == digits(made("001 202 555 0156", "phone"))[3:]
    assert digits(made("+49 30 23125186", "phone"))[2:] == digits(made("030/23125186", "phone"))[1:]
    assert digits(made("666 35 9800", "id_number")) == digits(made("666-35-9800", "id_number"))


@pytest.fixture(scope="module")
def tables(spark):
    facts = spark.createDataFrame([(1, "Zelda Calqashti called 415-555-0136.", "x"), (2, None, "x"), (3, "", "x"), (4, "Calqashti, Zelda or Z. Calqashti, twice: Zelda Calqashti, Zelda Calqashti", "x")], "fact_id long, content string, text string")
    obs = spark.createDataFrame([(7, "mail zelda@example.com", "y")], "observation_id long, observation_content string, mention string")
    gold = spark.createDataFrame([("c", [("a", None), ("b", "ask Niko Holvembry")]), ("d", []), ("e", None)], "case_id string, facts array<struct<content: string, evidence_excerpt: string>>")
    return pii.sources(facts, obs, gold)


def test_found(tables):
    got = {tuple(r) for r in pii.found(tables, LEX).collect()}
    assert got == {
        ("facts", "1", 0, "person_name", "Zelda Calqashti"), ("facts", "1", 0, "phone", "415-555-0136"), ("facts", "4", 0, "person_name", "Calqashti, Zelda"), ("facts", "4", 0, "person_name", "Z. Calqashti"),
        ("facts", "4", 0, "person_name", "Zelda Calqashti"), ("observations", "7", 0, "email", "zelda@example.com"), ("transcript_gate_gold", "c", 1, "person_name", "Niko Holvembry"),
    }
    assert pii.found(tables.where("false"), LEX).count() == 0


def test_redacted_keeps_the_rest(tables):
    got = {r["record_key"]: r["redacted"] for r in pii.redacted(tables, LEX).where("source_table = 'facts'").collect()}
    assert got["1"] == "[PERSON_NAME] called [PHONE]." and got["2"] is None and got["3"] == ""


def test_surrogates_are_distinct_typed_and_coreferent(spark, tables):
    m = pii.mentions(tables, LEX)
    s = {(r["pii_type"], r["mention"]): r["surrogate"] for r in pii.surrogates(m, LEX, KEY).collect()}
    assert len(set(s.values())) == len(s) and not set(s.values()) & {k[1] for k in s}
    full, turned, short = s["person_name", "Zelda Calqashti"], s["person_name", "Calqashti, Zelda"], s["person_name", "Z. Calqashti"]
    given, family = full.split()
    assert turned == f"{family}, {given}" and short == f"{given[0]}. {family}" and given.endswith("a")
    assert [c.isdigit() for c in s["phone", "415-555-0136"]] == [c.isdigit() for c in "415-555-0136"]
    text = {r["record_key"]: r["pseudonymised"] for r in pii.pseudonymised(tables, LEX, KEY).where("source_table = 'facts'").collect()}
    assert text["1"] == f"{full} called {s['phone', '415-555-0136']}." and text["2"] is None
    other = {(r["pii_type"], r["mention"]): r["surrogate"] for r in pii.surrogates(m, LEX, "another").collect()}
    assert all(other[k] != v for k, v in s.items())
    with pytest.raises(ValueError):
        pii.surrogates(m, LEX, "")
    assert pii.surrogates(m.where("false"), LEX, KEY).count() == 0


def test_clashes_are_drawn_again_until_none_is_left(spark, tmp_path, monkeypatch):
    from factloom.runtime import Cut

    plain = pii.draw_word
    # the first twelve draws of all parts are one of three words, two of them parts themselves
    monkeypatch.setattr(pii, "draw", lambda kind, part, gender, key, attempt: ("aa", "bb", "cc")[attempt % 3] if attempt < 12 else plain(part, kind, key, gender, attempt))
    parts = spark.createDataFrame([("family", x, None) for x in ("aa", "bb", "dd", "ee", "ff")], "kind string, part string, gender string")
    rows = pii.drawn_parts(parts, KEY, Cut(spark, "clashes")).collect()
    assert len({r["new"] for r in rows}) == 5 and not {r["new"] for r in rows} & {"aa", "bb"}


def test_gender_from_the_corpus(spark):
    texts = spark.createDataFrame([("Ms. Quorin Holvembry called. He left.",), ("Quorin Holvembry said she would.",), ("Herr Belo Holvembry came",), ("Zelda Holvembry spoke",), (None,)], "text string")
    assert {tuple(r) for r in pii.genders(texts, LEX).collect()} == {("quorin", "f"), ("belo", "m")}


def test_surrogates_of_the_small_tables(spark, small):
    """Over the whole corpus: distinct, no mention of it, and found again as the same type."""
    from factloom.llm.queries import QUERIES, _texts

    _, lex = _texts(spark, small)
    rows = QUERIES["p1_surrogates"](spark, small).collect()
    low = [(r["pii_type"], r["mention"].lower(), r["surrogate"].lower()) for r in rows]
    assert len({x[2] for x in low}) == len({x[1] for x in low}) and not {x[2] for x in low} & {x[1] for x in low}
    for r in rows:
        if r["pii_type"] in ("email", "phone") or (r["pii_type"] == "id_number" and r["surrogate"][0].isalpha()):
            new = r["surrogate"]
            assert [(k, new[a:b]) for a, b, k in find(new, lex)] == [(r["pii_type"], new)], r
