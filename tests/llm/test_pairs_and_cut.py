import pytest
from pyspark.sql import functions as F

from docmeter.llm import cut, languages, pairs

PAIRS = "result_id bigint, question string, predicted_answer string, architecture string, response_token_count int, defect string"
Q = "Why does Anna Torvel leave Lorwick?"
GOOD = ["It was the quarrel with Karl Benno that made Anna Torvel go away.", "Anna Torvel leaves Lorwick because Karl Benno has sold the house."]


def classify(spark, *answers, question=Q):
    filler = [(1000 + i, Q, f"{GOOD[i % 2]} This holds for all {i} settings that the paper describes.", "flat", 20) for i in range(40)]
    rows = [(i, question, a, "flat", None) for i, a in enumerate(answers)] + filler
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAIRS)
    got = {r["result_id"]: r["defect"] for r in pairs.defects(df).collect()}
    assert len(got) == len(rows) and not any(got[r[0]] for r in filler)
    return [got[i] for i in range(len(answers))]


def test_empty(spark):
    assert set(classify(spark, None, "", "  \n", "​", "**Answer:** ", "<answer></answer>", "N/A", "null", "[]", "```\n```", "...", "-")) == {"empty"}


def test_copies(spark):
    same = [Q, Q.lower(), f'"{Q}"', "The question is: " + Q, "OK. " + Q, "does Anna Torvel leave Lorwick", "Why doess Anna Torvel leave Lorwick."]
    assert set(classify(spark, *same)) == {"copied_question"}
    assert classify(spark, Q + " " + GOOD[0]) == [None]


def test_refusals_and_sound_answers(spark):
    no = ["I'm sorry, but I can't help with that request.", "No comment.", "My instructions prevent me from going further with this.", "I pass on this one.", "Diese Frage darf ich leider nicht beantworten.", "Lo siento, pero no puedo ayudar con esa petición.", "Unfortunately, I can’t help with that request."]
    assert set(classify(spark, *no)) == {"refusal"}
    yes = ["The paper does not say.", "Unanswerable", '"I\'m not able to answer," says Karl Benno when the judge asks.', "Sorry is the only word that he utters before the trial.", "I am sorry, but the text does not mention this.", "B", "(A) because of the debt", "Karl Benno", "42.1 percent"]
    assert classify(spark, *yes) == [None] * len(yes)


def test_truncated(spark):
    bad = ["It was the quarrel with Ka", "Anna Torvel leaves Lorwick because Karl Benno has so", GOOD[0] + " This holds for all 3 set", "Anna Torvel leaves Lor�"]
    assert set(classify(spark, *bad)) == {"truncated"}


def truncated(spark, *rows):
    """Ids of the truncated ones of rows (source, answer)."""
    df = spark.createDataFrame([(i, Q, a, source, None, "") for i, (source, a) in enumerate(rows)], PAIRS)
    return [r["result_id"] for r in pairs.defects(df).where("defect = 'truncated'").orderBy("result_id").collect()]


def test_truncated_where_many_answers_end_open(spark):
    cut_ones = ["Anna Torvel leaves Lorwick because of the", "All of them know that (by the letter", "The house was old and nobody saw Anna Tor", "Lorw"]
    names = ["Karl", "Anna", "Otto", "Emma", "Hugo"]
    whole = [f"{a} and {b} in the garden" for a in names for b in names if a != b]
    full = [f"Anna Torvel leaves Lorwick because of the letter that Karl Benno wrote in {1800 + i}." for i in range(30)]
    assert truncated(spark, *[("terse", a) for a in cut_ones + whole + full + ["Karl", "Lorwick"]]) == [0, 1, 2, 3]


def test_copies_of_a_truncated_answer_do_not_set_the_baseline(spark):
    full = [f"{GOOD[i % 2]} This holds for all {i} settings that the paper describes." for i in range(40)]
    rows = ["Nobody else in the town saw a carriage"] + ["It was sold by the elder brother of Benno"] * 40 + full
    assert truncated(spark, *[("flat", a) for a in rows]) == list(range(41))


def test_other_language(spark):
    other = ["Anna Torvel quitte Lorwick parce que Karl Benno a vendu la maison.", "Anna Torvel verlässt Lorwick, weil Karl Benno das Haus verkauft hat.", "安娜离开了那里,因为房子已经卖了。", "Анна покидает город, потому что дом продан."]
    assert set(classify(spark, *other)) == {"other_language"}
    assert classify(spark, "Anna leaves because of „das alte Haus ist nicht mehr da und wird verkauft“, as the text has it.") == [None]
    assert classify(spark, "It is sold.", question=None) == [None]


def test_copies_of_a_result_and_empty_table(spark):
    df = spark.createDataFrame([(1, Q, None, "flat", None, ""), (1, Q, None, "flat", None, "")], PAIRS)
    assert [tuple(r) for r in pairs.defects(df).collect()] == [(1, "empty")]
    assert pairs.defects(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, language", [("The house is sold and they leave.", "en"), ("Das Haus ist verkauft und sie gehen.", "de"), ("La maison est vendue et ils partent.", "fr"), ("El libro no lo indica.", "es"), ("Il testo non lo dice.", "it"), ("B", None), (None, None), ("Karl Benno", None)])
def test_language(text, language):
    assert languages.no_model().of([text]) == [language]


def test_fitted_languages(spark):
    stems = {"en": "the corpus holds {} documents kept for the final test", "es": "la evaluación usa {} documentos reservados para la prueba", "it": "la valutazione usa {} documenti tenuti da parte per la prova"}
    rows = [(i, t.format(i), x) for i in range(20) for x, t in stems.items()] + [(90, None, "en"), (91, "x", None), (92, "y", "und"), (93, "", "es")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, defect int")
    model = languages.fit(docs)
    assert model.languages == ["en", "es", "it"]
    assert model.of(["La evaluación usa KelnoshaQA, con 4 documentos reservados", "Holwick contiene 88 documenti tenuti da parte", "Karl Benno", None]) == ["es", "it", None, None]
    pair = (1, "What data do the authors use to test HolnachGraph?", "La valutazione usa LanorQA, con 7 documenti tenuti da parte per la prova.", "flat", None, "")
    got = pairs.defects(spark.createDataFrame([pair], PAIRS), model).first()["defect"]
    assert got == "other_language" and languages.fit(docs.limit(0)).of(["The house is sold and they leave."]) == ["en"]


def test_latin_names_in_other_scripts():
    assert languages.no_model().of(["A: Frederick Cortamere离开Fenwin,因为Marek Rosteck卖掉了房子。", "KormigraveGraph лучше, чем WenanwinGraph, на 9.0 процента.", "the name 安娜 is hers and of the house"]) == ["zh", "ru", "en"]


@pytest.mark.parametrize("text, state", [
    ('He said "yes" (twice).', False), ('He said "yes', True), ("a (b [c] d", True), ("smile :) and :(", False), ('{"a": [1, 2], "b": "x"}', False), ('{"a": [1, 2], "b": "x', True),
    ('{"a": 1}\n{"b": [1', True), ("```\ncode", True), ("```\n(code\n```", False), ("“So it is” she said", False), ("“So it is", True), ("a) first b) second", False), ("<div><b>x</b>", True), ("<div>\n\n<b>x</div>", False), ("<p>one<br/>two <s> three", False), ('<table class="a">x</table>', False), ("a < b and c > d", False), ('"open in one paragraph\n\nclosed in the next', False), ("", False),
])
def test_stack_automaton(text, state):
    assert cut.open_marks(text) is state


def documents(spark, extra):
    base = [(100 + i, "report", f"Members travel between Lor{i} and the coast. The strongest tie concerns the letter and has a weight of {i}.", "x") for i in range(60)]
    base += [(300 + i, "comment", f"I think the section on trees is too short, see page {i}. works for me now", "x") for i in range(60)]
    return spark.createDataFrame(base + [(i, s, t, "x") for i, (s, t) in enumerate(extra)], "doc_id bigint, source string, text string, cut string")


def test_cut_documents(spark):
    extra = [
        ("report", "Members travel between Lor1 and the co"), ("report", "The strongest tie concerns the letter and has a"), ("comment", "I think the section on tr"),
        ("report", "The strongest tie concerns the letter and has a weight of 7."), ("comment", "A fine book, I think. works for me now"), (None, "The strongest tie concerns the letter."),
        ("report", None), ("report", ""), ("report", "  \n"), ("report", "Members travel between Lor2 and the coast. " * 3000 + "Members trav"),
    ]
    got = {r["doc_id"]: r["cut"] for r in cut.cut_documents(documents(spark, extra)).collect()}
    assert [got.get(i) for i in range(len(extra))] == [True, True, True, False, False, False, None, None, None, True]
    assert not any(got[i] for i in got if i >= 100)


def test_evidence(spark):
    extra = [("report", "Members travel between Lor1 and the co"), ("report", "The strongest tie concerns the letter and has a"), ("report", 'He said "the letter. And then.'), ("report", "<div>The strongest tie concerns the letter.")]
    got = {r["doc_id"]: r["evidence"] for r in cut.cut_documents(documents(spark, extra)).collect()}
    assert [got[i] for i in range(4)] == ["within_word", "unusual_ending", "structure", "structure"] and got[100] is None


def test_rows_of_one_key_are_spread(spark):
    from docmeter.llm.segments import SALTS, looked_up

    rows = spark.range(3200).select("id", F.when(F.col("id") % 10 > 0, F.lit("hot")).alias("word"), F.lit(1).alias("extra"))
    known = spark.createDataFrame([("hot", True), ("cold", True)], "word string, seen boolean")
    joined = looked_up(rows, known, ["word"], "id")
    assert joined.columns == ["word", "id", "extra", "seen"] and joined.count() == 3200 and joined.where("seen").count() == 2880
    salted = rows.groupBy("word", F.pmod(F.xxhash64("id"), F.lit(SALTS))).count()
    assert salted.where("word = 'hot'").agg(F.max("count")).first()[0] < 3200 / SALTS * 1.5


def test_cut_documents_copies_and_empty(spark):
    df = documents(spark, [("report", "Members travel between Lor1 and the co")] * 1)
    twice = df.where("doc_id = 0").unionByName(df)
    assert cut.cut_documents(twice).where("doc_id = 0 AND cut").count() == 2
    assert cut.cut_documents(df.limit(0)).count() == 0


def test_copies_of_a_cut_document_do_not_make_its_ending_usual(spark):
    extra = [("report", "Members travel between Lor1 and the")] * 40 + [("report", "The strongest tie concerns the silv")] * 30 + [("report", f"The silver of Lor{i} lies at the coast.") for i in range(20)]
    extra += [("report", "They came by the old road and the"), ("report", "Members travel between Lor7 and the coast.")]
    got = {r["doc_id"]: r["cut"] for r in cut.cut_documents(documents(spark, extra)).collect()}
    assert [got[i] for i in range(len(extra))] == [True] * 70 + [False] * 20 + [True, False]


def test_cut_answers(spark):
    rows = [(i, i, "flat", 20, f"{GOOD[i % 2]} This holds for all {i} settings.") for i in range(40)] + [(100, 100, "flat", 5, "Anna Torvel leaves Lorwick because Ka"), (101, None, "flat", None, "Karl Benno"), (102, 102, "flat", None, None), (100, 100, "flat", 5, "Anna Torvel leaves Lorwick because Ka")]
    rows = [(*r, Q) for r in rows] + [(103, None, "flat", None, "why does anna torvel leave lorwick", Q), (104, None, "flat", None, "Some answer to nothing that was asked", None)]
    results = spark.createDataFrame(rows, "result_id bigint, call_id bigint, architecture string, response_token_count int, predicted_answer string, question string")
    ledger = spark.createDataFrame([(i, "m", 20, None) for i in range(40)] + [(100, "m", 5, 5), (100, "m", 5, 5)], "call_id bigint, model string, output_tokens bigint, max_tokens int")
    got = [tuple(r) for r in cut.cut_answers(results, ledger).where("cut").collect()]
    assert sorted(got) == [(100, "m", True, "neighbour"), (104, None, True, "baseline")]
    assert cut.cut_answers(results, ledger).where(F.col("result_id") == 101).first()["model"] is None


def test_cut_answers_with_an_open_structure(spark):
    answers = ['He wrote "the house is sold. Nobody came.', "The list (see page 4. It ends there.", '{"answer": "the house", "page": [1', "```\nx = 1.", 'He wrote "the house is sold." Nobody came.', "The list (see page 4) ends there."]
    rows = [(i, None, "flat", None, a, Q) for i, a in enumerate(answers)] + [(100 + i, None, "flat", None, f"{GOOD[i % 2]} This holds for all {i} settings.", Q) for i in range(40)]
    results = spark.createDataFrame(rows, "result_id bigint, call_id bigint, architecture string, response_token_count int, predicted_answer string, question string")
    ledger = spark.createDataFrame([], "call_id bigint, model string, output_tokens bigint, max_tokens int")
    assert sorted(r["result_id"] for r in cut.cut_answers(results, ledger).where("cut").collect()) == [0, 1, 2, 3]
