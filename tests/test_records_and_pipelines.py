import json

import pytest
from pyspark.sql import functions as F

from docmeter.functions import records as R
from docmeter.operators import items, pipelines as P
from docmeter.schemas import PAPERS


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def answer(**kw):
    return {"answer": {"free_form_answer": None, "extractive_spans": [], "yes_no": None, "unanswerable": False, "evidence": [], "highlighted_evidence": []} | kw}


def paper(name, *questions, evidence=("e",)):
    qas = [{"question_id": q, "question": f"What is {q}?", "answers": [answer(free_form_answer="x", evidence=list(evidence))]} for q in questions]
    return {"paper_id": name, "title": "T", "abstract": "", "full_text": [{"section_name": "S", "paragraphs": ["p", " "]}], "qas": qas}


def table(spark, tmp_path, *papers):
    path = tmp_path / "papers.jsonl"
    path.write_text("\n".join(json.dumps(p) for p in papers))
    return spark.read.schema(PAPERS).json(str(path))


def test_items(spark, tmp_path):
    rows = items.paper_questions(table(spark, tmp_path, paper("pA", "qA1", "qA2", "qA3"), paper("pB", "qB1"), paper("pC", "qC1", "qC2")))
    first = rows.where("question_id = 'qA1'").first()
    assert first["document"] == "T\n\nS\n\np" and first["gold_answers"] == ["x"] and first["gold_evidence"] == ["e"] and first["answer_type"] == "abstractive"
    held = spark.createDataFrame([("qA2",)], "question_id string")
    pairs = lambda df: sorted((r["paper_id"], r["question_id"]) for r in df.collect())
    assert pairs(items.full_split(rows, held, [])) == [("pA", "qA1"), ("pA", "qA3"), ("pC", "qC1"), ("pC", "qC2")]
    assert pairs(items.full_split(rows, held, [], documents=1)) == [("pA", "qA1"), ("pA", "qA3")]
    assert pairs(items.full_split(rows, held, ["pA"])) == [("pC", "qC1"), ("pC", "qC2")]


def test_pools(spark, tmp_path):
    good, bare, test = [paper(f"g{i}", "q1", "q2") for i in range(30)], [paper(f"n{i}", "q", evidence=()) for i in range(5)], [paper(f"t{i}", "q") for i in range(5)]
    papers = table(spark, tmp_path, *good, *bare, *test)
    pool = items.calibration_pool(papers, papers.where(F.col("paper_id").startswith("t"))).collect()
    assert len({r["paper_id"] for r in pool}) == 20 and all(r["paper_id"][0] == "g" and r["question_id"] == "q1" for r in pool)
    questions = spark.createDataFrame([(f"n{i}", f"q{j}") for i in range(9) for j in range(9)], "novel_id string, question_id string")
    assert items.novel_pool(questions).groupBy("novel_id").count().select("count").collect() == [(5,)] * 4


def test_gold_answer_order(spark):
    schema = "a struct<free_form_answer: string, extractive_spans: array<string>, yes_no: boolean, unanswerable: boolean>"
    for value, text, kind in [(("f", ["s"], None, False), "f", "extractive"), ((" ", ["s", "t"], None, False), "s t", "extractive"), ((None, [], True, False), "Yes", "yes_no"), ((None, [], None, True), "", "unanswerable"), ((None, None, None, None), None, "other")]:
        assert one(spark, R.gold_answer(F.col("a")), schema, value) == text
        assert one(spark, R.answer_type(F.col("a")), schema, value) == kind


def test_options(spark):
    assert one(spark, R.rendered_options(F.col("o")), "o map<string,string>", {"B": "two", "A": "one"}) == "A. one\nB. two"
    assert one(spark, R.absent_letters(F.col("o")), "o map<string,string>", {"A": "No one", "B": "something", "C": "He never did", "D": "x"}) == ["A", "C"]
    assert one(spark, R.options_literal(F.col("t")), "t string", "{'A': 'it''s', 'B': 'x'}".replace("''", "’")) == {"A": "it’s", "B": "x"}
    assert one(spark, R.options_literal(F.col("t")), "t string", "oops") == {}


def test_outputs(spark):
    schema = "entities array<string>"
    for text, found in [('{"entities": ["a"]}', ["a"]), ('```json\n{"entities": ["b"]}\n```', ["b"]), ('Sure: {"x": 1} and {"entities": ["c", "d"]}', ["c", "d"])]:
        assert one(spark, R.json_block(F.col("t"), schema)["entities"], "t string", text) == found
    assert one(spark, R.json_block(F.col("t"), schema), "t string", "garbage") is None
    assert one(spark, R.malformed(F.col("t")), "t string", " ") == "empty_response" and one(spark, R.malformed(F.col("t")), "t string", "fine") is None
    assert one(spark, R.malformed(F.col("t")), "t string", "x <Thinking>") == "leaked_control_tag:<thinking>"
    for value, strength in [("7", 7), ("0", 1), ("99", 10), ("2.5", 2), ("3.5", 4), ("x", None), (None, None)]:
        assert one(spark, R.clamped_strength(F.col("t")), "t string", value) == strength
    assert one(spark, R.evidence_parts(F.col("t")), "t string", "a\n\n \n\n b") == ["a", "b"]
    assert one(spark, R.shortened(F.col("t"), 4), "t string", "abcdef") == "abc…"
    keys = {one(spark, R.config_key(F.col("m")), "m map<string,string>", m) for m in ({"a": "1", "b": None}, {"b": None, "a": "1"})}
    assert len(keys) == 1


@pytest.fixture(scope="module")
def study(spark):
    text = "The old mill stands by the river. " * 30 + "The letter was found by Anna Torvel in Lorwick. Then Anna Torvel met Karl Benno there. " + "Rain fell on the town for days. " * 30
    docs = spark.createDataFrame([("p1", text), ("p2", "Nothing of note."), ("p3", None)], "paper_id string, text string")
    questions = spark.createDataFrame([("q1", "p1", "Who was the letter found by?"), ("q2", "p2", "What is of note?"), ("q3", "p3", "Anything?")], "question_id string, paper_id string, question string")
    return questions, docs


@pytest.mark.parametrize("name", sorted(P.ARCHITECTURES))
def test_architectures(study, name):
    rows = {r["question_id"]: r for r in P.run_architecture(name, *study).collect()}
    assert set(rows) == {"q1", "q2", "q3"} and not any(r["failed"] for r in rows.values())
    assert "found by Anna Torvel" in rows["q1"]["answer"]
    assert rows["q3"]["answer"] == "Unanswerable"


def test_calls_fail_softly(spark, study):
    assert P.closed_book(study[0]).first()["answer"] == "Unanswerable"
    calls = P.called(spark.createDataFrame([("p", "x\n\nQuestion: y"), ("p", None)], "paper_id string, prompt string"), "extractive")
    rows = P.ledger_rows(calls, "flat", "generate", "extractive").collect()
    assert sorted(r["failed"] for r in rows) == [False, True] and [r["failure_reason"] for r in rows if r["failed"]] == ["ValueError: no prompt"]
    with pytest.raises(ValueError):
        P.called(study[0], "unknown")
    with pytest.raises(ValueError):
        P.run_architecture("unknown", *study)
