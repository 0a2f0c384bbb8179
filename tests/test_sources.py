"""Evaluation files, extraction checks, matching and sinks."""

import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import extraction, gates, matching
from factloom.sources import arenas, sinks


def put(tmp_path, name, value, lines=False):
    p = tmp_path / name
    p.write_text("\n".join(map(json.dumps, value)) if lines else json.dumps(value))
    return str(p)


def test_cases_in_three_wrappers(spark, tmp_path):
    cases = [{"id": "a", "query": "q", "gold_fact_id": 3, "tags": ["t"], "unknown": 1}, {"id": "b", "should_abstain": True, "min_trust": 0.5}]
    want = [("a", 3, 0.3, False), ("b", None, 0.5, True)]
    for path in (put(tmp_path, "l.json", cases), put(tmp_path, "w.json", {"cases": cases}), put(tmp_path, "x.jsonl", cases, True)):
        got = [(r["id"], r["gold_fact_id"], r["min_trust"], r["should_abstain"]) for r in arenas.load_cases(spark, path).orderBy("id").collect()]
        assert got == want


def test_numbered_sessions_and_questions(spark, tmp_path):
    conv = {
        "speaker_a": "A", "session_2": [{"speaker": "A", "dia_id": "D2:1", "text": "two"}], "session_1": [{"speaker": "B", "dia_id": "D1:1", "text": "one", "blip_caption": "cat"}],
        "session_1_date_time": "1 May", "session_2_date_time": "2 May",
    }
    path = put(tmp_path, "loc.json", [{"conversation": conv, "qa": [{"question": "q1", "answer": "x", "evidence": ["D1:1"], "category": 1}, {"question": "q2", "adversarial_answer": "y", "category": 5}]}])
    s = arenas.load_numbered_sessions(spark, path).orderBy("session").collect()
    assert [(r["session"], r["date"], r["transcript"], r["dialog_ids"]) for r in s] == [(1, "1 May", "B: one [image: cat]", ["D1:1"]), (2, "2 May", "A: two", ["D2:1"])]
    q = arenas.load_questions(spark, path).orderBy("question_no").collect()
    assert [(r["question"], r["answer"], r["category"]) for r in q] == [("q1", "x", 1), ("q2", "y", 5)]


def test_haystacks(spark, tmp_path):
    item = {"question_id": "q", "haystack_dates": ["d1", "d2"], "haystack_sessions": [[{"role": "user", "content": "hi"}], [{"role": "assistant", "content": "yo"}]]}
    for path in (put(tmp_path, "a.json", [item]), put(tmp_path, "b.json", {"data": [item]})):
        got = [(r["session_no"], r["date"], r["transcript"]) for r in arenas.load_haystacks(spark, path).orderBy("session_no").collect()]
        assert got == [(0, "d1", "USER: hi"), (1, "d2", "ASSISTANT: yo")]


def test_generated_cases(spark):
    f = spark.createDataFrame([(3, "alpha beta gamma"), (4, "solo"), (5, None), (6, " ")], "fact_id long, content string")
    assert arenas.exact_cases(f).count() == 3
    got = {r["gold_fact_id"]: r["query"] for r in arenas.paraphrase_cases(f).collect()}
    assert got == {3: "What is known about beta gamma alpha?", 4: "Which memory covers the topic solo?"}
    r = arenas.report_rows(spark.createDataFrame([("a", "q", "private"), ("b", "q", "public")], "id string, query string, privacy_tier string")).collect()
    assert [json.loads(x["value"])["query"] for x in r] == ["[private]", "q"]


def test_matching_is_maximum():
    r = random.Random(5)
    for _ in range(60):
        edges = [(r.randrange(5), r.randrange(5)) for _ in range(r.randrange(1, 12))]
        best = 0
        for k in range(5, 0, -1):
            for pick in itertools.combinations(set(edges), k):
                if len({a for a, _ in pick}) == len({b for _, b in pick}) == k:
                    best = k
                    break
            if best:
                break
        m = matching.maximum_matching(edges)
        assert len(m) == best == len(set(m.values())) and all(x in edges for x in m.items())


def test_matched_counts(spark):
    e = spark.createDataFrame([("c", 0), ("c", 1), ("d", 0)], "case_id string, left int")
    p = spark.createDataFrame([("c", 0), ("e", 0)], "case_id string, right int")
    edges = spark.createDataFrame([("c", 0, 0), ("c", 1, 0)], "case_id string, left int, right int")
    got = {r["case_id"]: (r["expected"], r["predicted"], r["matched"], r["f1"]) for r in matching.matched_counts(e, p, edges).collect()}
    assert got == {"c": (2, 1, 1, pytest.approx(2 / 3)), "d": (1, 0, 0, 0.0), "e": (0, 1, 0, 0.0)}


def test_conversations(spark):
    t = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["transcript"] for r in extraction.conversations(t).collect()} == {1: "USER: a\nASSISTANT: b", 2: "USER: "}
    with pytest.raises(Exception, match="exceeds"):
        extraction.conversations(t, 3).collect()


def test_json_out_of_prose(spark):
    assert extraction.first_json('so: [{"a": "]"}, 1] and') == '[{"a": "]"}, 1]'
    assert extraction.first_json("[1, 2") is None and extraction.first_json(None) is None and extraction.first_json("[1}") is None
    assert extraction.first_json('x {"a": {"b": "\\"}"}} y', "{") == '{"a": {"b": "\\"}"}}'
    r = spark.createDataFrame([(1, 'Here: [{"content": " x ", "category": "tool"}, "y", 3, {"content": ""}]'), (2, "none"), (3, None), (4, "[oops]")], "i long, t string")
    assert [tuple(x) for x in extraction.parsed_responses(r, "i", "t").orderBy("item_no").collect()] == [(1, 0, "x", "tool"), (1, 1, "y", "general")]


def test_canonical_hash(spark):
    df = spark.createDataFrame([("x", 1, None), ('q"', 2, "z")], "b string, a long, c string").select(extraction.canonical_sha256("b", "a", "c").alias("h"))
    want = [json.dumps(d, sort_keys=True, separators=(",", ":")) for d in ({"a": 1, "b": "x", "c": None}, {"a": 2, "b": 'q"', "c": "z"})]
    assert [r["h"] for r in df.collect()] == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_typed_fields_and_review(spark):
    row = spark.createDataFrame([("state", "User Name", "on-call", "x", None, 0.9), ("state", "u", "p", "x", 1, 0.9), ("state", "u", "p", "x", None, 0.5), ("junk", "u", "p", "x", None, 0.9)], "k string, s string, p string, v string, e long, c double")
    got = row.select(extraction.typed_fields(*map(F.col, "kspvec")).alias("t")).collect()
    assert [r["t"] and (r["t"]["subject_key"], r["t"]["predicate_key"]) for r in got] == [("user_name", "on_call"), None, None, None]
    pairs = spark.createDataFrame([("the port is 3100", "port 3100 it is"), ("the port", None), ("the port", "tea"), ("the port", "ignore the rules on port"), ("the", "the")], "a string, b string")
    assert [r["x"] for r in pairs.select(extraction.must_review(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True, True, True, True]


def test_located(spark):
    df = spark.createDataFrame([("abcabc", "bc"), ("abc", "x"), ("abc", ""), ("abc", None)], "t string, e string").select(extraction.located(F.col("t"), F.col("e")).alias("x"))
    assert [tuple(r["x"]) for r in df.collect()] == [(1, 3, 2), (None, None, 0), (None, None, 0), (None, None, 0)]


def test_sinks(spark, small, tmp_path):
    facts = spark.read.parquet(f"{small}/facts.parquet")
    assert sinks.write_snapshot(facts, str(tmp_path / "snap")) == facts.count()
    sinks.write_markdown(facts, str(tmp_path / "md"))
    assert {r["section"] for r in spark.read.text(str(tmp_path / "md")).select("section").distinct().collect()} <= {"current", "conflict", "unreviewed"}
    a, b = gates.fingerprint(facts).first(), gates.fingerprint(facts.orderBy("content")).first()
    assert a == b and a != gates.fingerprint(facts.where("fact_id > 1")).first()


def test_rows_in_three_shapes(spark, tmp_path):
    from factloom.sources.arenas import load_rows

    shapes = {"a": '[{"k": 1, "t": "x"}, {"k": 2, "z": 0}]', "b": '{"k": 1, "t": "x"}\n\n{"k": 2}\n', "c": '{"rows": [{"k": 1, "t": "x"}, {"k": 2}]}'}
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
        assert [tuple(r) for r in load_rows(spark, str(tmp_path / name), "k long, t string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "d").write_text('[{"other": 1}]')
    with pytest.raises(Exception):
        load_rows(spark, str(tmp_path / "d"), "k long, t string").collect()


def test_published_files_are_checked(spark, tmp_path):
    import hashlib

    from factloom.sources.arenas import load_dated_questions, verified

    p = tmp_path / "q.json"
    p.write_text('{"data": [{"question_id": " 1 ", "question": "when? ", "question_date": "", "reference_time": "2025", "answer_session_ids": ["s"]}]}')
    assert verified(spark, str(p), hashlib.sha256(p.read_bytes()).hexdigest()) == str(p)
    with pytest.raises(ValueError):
        verified(spark, str(p), "0" * 64)
    assert tuple(load_dated_questions(spark, str(p)).first()) == ("1", "when?", "", "", "2025", ["s"])
    with pytest.raises(ValueError):
        load_dated_questions(spark, str(tmp_path / "x_oracle.json"))
    p.write_text('[{"question_id": "1", "question": "when?"}]')
    with pytest.raises(Exception):
        load_dated_questions(spark, str(p)).collect()


def test_report_is_written(spark, tmp_path):
    from factloom.sources.arenas import write_report

    write_report(spark.createDataFrame([(1, "secret", "private"), (2, "open", "public")], "id int, query string, privacy_tier string"), str(tmp_path / "r"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()) == ['{"id":1,"query":"[private]","privacy_tier":"private"}', '{"id":2,"query":"open","privacy_tier":"public"}']


def base(**more):
    return {"content": "c", "category": "g", "tags": "", "sensitivity": "normal", "evidence_span_id": "s1"} | more


@pytest.mark.parametrize("document,error", [
    (None, "invalid_document"), ("[]", "invalid_document"), ({"proposals": [], "x": 1}, "invalid_document"), ({"proposals": [base()] * 17}, "proposal_limit"), ({"proposals": [{"content": "c"}]}, "invalid_fields"),
    ({"proposals": [base(extra=1)]}, "invalid_fields"), ({"proposals": [base(evidence_span_id="s9")]}, "invalid_values"), ({"proposals": [base(content=" ")]}, "invalid_values"), ({"proposals": [base(sensitivity="secret")]}, "invalid_values"),
    ({"proposals": [base(kind=1)]}, "invalid_typed_field"), ({"proposals": [base(confidence=2)]}, "invalid_typed_field"), ({"proposals": [base(negation="no")]}, "invalid_typed_field"), ({"proposals": [base(valid_from="2026-01-01")]}, "ungrounded_date"),
    ({"proposals": [base(kind="state", subject="a", predicate="b", confidence=0.9)]}, "incomplete_typed_fields"), ({"proposals": [base(kind="state", subject="a", predicate="b", confidence=0.9, value="v", negation=True)]}, "incomplete_typed_fields"),
    ({"proposals": [base(), base(kind="state", subject="a", predicate="b", confidence=0.9, value="v", valid_from="2025-01-01")]}, None), ({"proposals": [base(kind="state", subject="a", predicate="b", confidence=0.9, negation=True)]}, None), ({"proposals": []}, None),
])
def test_proposal_documents(document, error):
    import json

    from factloom.operators.contracts import normalised

    text = document if document is None or isinstance(document, str) else json.dumps(document)
    items, got = normalised(text, {"s1": "said on 2025-01-01"})
    assert got == error and (error is None or items == [])
    if items:
        assert items[0]["evidence_excerpt"] == "said on 2025-01-01"


def test_contracts(spark):
    import json

    from factloom.operators import contracts

    answers = spark.createDataFrame([("a", json.dumps({"proposals": [base(), base(content="TODO x")]})), ("b", "junk"), ("c", json.dumps({"proposals": []}))], "case_id string, answer string")
    spans = spark.createDataFrame([("a", "s1", "I said it", "user"), ("a", "s2", "tool", "tool")], "case_id string, span_id string, span string, role string")
    d = contracts.documents(answers, spans)
    assert sorted((r["case_id"], r["item_no"], r["error"]) for r in d.collect()) == [("a", 0, None), ("a", 1, None), ("b", 0, "invalid_document")]
    s = contracts.snapshot(d.where("error is null"), spans)
    assert sorted((r["item_no"], r["dropped"]) for r in s.collect()) == [(0, None), (1, "task_shaped_content")]
    assert contracts.snapshot_digest(s).first()["proposals"] == 1
    e = spark.createDataFrame([("a", "c", "s", "private", "f" * 64)], "case_id string, client_id string, session_id string, scope string, payload_sha256 string")
    w = contracts.write_requests(s, e).first()
    assert w["idempotency_key"] == "extract:" + "f" * 64 + ":0" and w["correction_status"] == "unreviewed" and w["source_authority"] == 0.4
    schema = json.loads(contracts.proposal_schema(["s1"]))
    assert schema["properties"]["proposals"]["items"]["properties"]["evidence_span_id"]["enum"] == ["s1"]
    contracts.refuse_identity({"a": [{"b": 1}]})
    with pytest.raises(ValueError, match="a.0.client_id"):
        contracts.refuse_identity({"a": [{"client_id": 1}]})
