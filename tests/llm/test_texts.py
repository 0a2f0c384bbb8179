import random

import pytest

from factloom.llm import encode
from factloom.llm.confusables import consistent, look_alikes
from factloom.llm.encode import decoded, encode_text, encoder, pieces, token_counts, token_ids
from factloom.llm.packing import CAPACITY, fill_report, pack, plan


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], "doc_id long, text string, id string, form string, ids string")


TEXTS = [
    "Hello  world\n\n'tis 42", None, "", " ", "<|endoftext|> is text", "日本語のテキスト", "👩‍💻🚀 é ﬁ", "a" * 3000, "def f(x):\n\treturn x  \n", "x\r\n\r\n  y",
]


def test_ids_equal_the_library_and_decode_back(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    df = docs(spark, TEXTS)
    ids = token_ids(df)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got == {i: other.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in decoded(ids).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert token_ids(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_long_texts_split_safely(seed, monkeypatch):
    r = random.Random(seed)
    parts = ["word", " ", "  ", "\n", "\t", "\n\n", "42", "'s", "!?", "é", "日本", "👩‍💻", " ", "　", "<|endoftext|>", "_x"]
    text = "".join(r.choice(parts) for _ in range(3000))
    enc = encoder()
    whole = enc.encode_ordinary(text)
    monkeypatch.setattr(encode, "PIECE", 50)
    assert "".join(pieces(text, 50)) == text and len(list(pieces(text, 50))) > 10
    assert encode_text(text, enc) == whole
    r = random.Random(5)
    mixed = "".join(r.choice(["a", "Zb", "7", "42", "²", "é", "_", "'s", "ß9", "١", "ab1"]) for _ in range(4000))
    assert len(list(pieces(mixed, 50))) > 10
    assert sum((enc.encode_ordinary(p) for p in pieces(mixed, 50)), []) == enc.encode_ordinary(mixed)


def test_consistent_forms(spark):
    same = ["Café fin-al A", "Café ﬁn‑al A", "Ｃａｆé fin‐al　А", "C​a­fé fi⁠n-al﻿ Α", "Саfé fin-al A"]
    other = ["Cafe fin-al A", "café fin-al A", "Café fin-al  A", "Café fin-al 4", "Café fin al A", None, "", "​ ﻿", " \n", "x²", "x2"]
    _, members = look_alikes(docs(spark, same + other + ["", None]))
    assert {tuple(r) for r in members.collect()} == {(0, i) for i in range(5)}
    form = {r["doc_id"]: r["form"] for r in consistent(docs(spark, [*same, None, "it's 'ok'", "ó", "ό"])).collect()}
    assert form[0] == "Café fin-al A" and form[5] is None and form[6] == "it's 'ok'" and form[7] == form[8] == "ó"
    assert look_alikes(docs(spark, []))[1].count() == 0


def test_consistent_form_is_stable(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    once = consistent(d).withColumnRenamed("form", "text")
    assert consistent(once).join(once, "doc_id").where("not (form <=> text)").count() == 0


def check_packing(spark, sizes, **k):
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, n int")
    got = pack(df, "i", "n", **k).collect()
    fill, seen = {}, {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["units"]
        seen.setdefault(r["i"], []).append((r["piece_no"], r["first_unit"], r["units"]))
    assert set(seen) == set(range(len(sizes))) and all(v <= CAPACITY for v in fill.values())
    for i, n in enumerate(sizes):
        n = n or 0
        p = sorted(seen[i])
        assert sum(x[2] for x in p) == n and [x[0] for x in p] == list(range(len(p))) and all(x[1] == CAPACITY * k for k, x in enumerate(p))
        assert len(p) == (1 if n <= CAPACITY else -(-n // CAPACITY))
    return len([v for v in fill.values() if v])


def test_packing(spark):
    r = random.Random(3)
    sizes = [int(r.lognormvariate(5.5, 1)) for _ in range(4000)] + [0, None, 1, 2048, 2049, 10_000, 4096] + [700] * 1500
    used = check_packing(spark, sizes)
    assert used <= 1.02 * sum(x or 0 for x in sizes) / CAPACITY + 1
    assert check_packing(spark, sizes, shard=50) <= 1.02 * sum(x or 0 for x in sizes) / CAPACITY + 25  # some 25 shards
    assert check_packing(spark, [2048, 2048]) == 2 and check_packing(spark, [1025] * 40) == 40 and check_packing(spark, [1024] * 40) == 20
    empty = spark.createDataFrame([], "i long, n int")
    assert pack(empty, "i", "n").count() == 0
    assert fill_report(pack(spark.createDataFrame([(1, 5)], "i long, n int"), "i", "n")).first()["containers"] == 1


def test_plan_places_each_item_once():
    r = random.Random(8)
    sizes = {s: r.randrange(1, 30) for s in r.sample(range(1, 101), 60)}
    runs, end = plan(sizes, 100)
    load: dict[int, int] = {}
    for s in sizes:
        mine = sorted((a, n) for x, a, n, _ in runs if x == s)
        at = 0
        for a, n in mine:
            assert a == at
            at += n
        assert at == sizes[s]
    for s, _, n, c in runs:
        for k in range(c, c + n):
            load[k] = load.get(k, 0) + s
    assert max(load.values()) <= 100 and set(load) == set(range(end))
