import pytest
from pyspark.sql import functions as F

from docmeter.functions import text as T
from docmeter.functions.metrics import accuracy, best_f1, evidence_f1, evidence_hit, reference_tokens, token_f1


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [("HELLO World", "hello world"), ("the cat and the dog", "cat and dog"), ("Hello, world!", "hello world"), (None, ""), ("it's", "its"), ("a-b", "ab"), ("éa a", "éa")])
def test_normalize(spark, text, expected):
    assert one(spark, T.normalize_text(F.col("t")), "t string", text) == expected


@pytest.mark.parametrize("p, g, expected", [("cat sat", "the cat sat there", 0.8), ("", "", 1.0), ("the", "the", 1.0), ("", "cat", 0.0), (".", "cat", 0.0)])
def test_token_f1(spark, p, g, expected):
    assert one(spark, token_f1(T.tokens(F.col("p")), T.tokens(F.col("g"))), "p string, g string", p, g) == pytest.approx(expected)


def test_best_f1(spark):
    assert one(spark, best_f1(T.tokens(F.col("p")), reference_tokens(F.col("g"))), "p string, g array<string>", "the quick brown fox", ["quick brown", "the cat", None]) == pytest.approx(0.8)
    assert one(spark, best_f1(T.tokens(F.col("p")), reference_tokens(F.col("g"))), "p string, g array<string>", "x", []) == 0


@pytest.mark.parametrize("a, b, expected", [(["One.", "Two."], ["one", "three"], 0.5), (["x", "x"], ["x", "y"], 2 / 3), ([], [], 0.0), (None, ["x"], 0.0)])
def test_evidence_f1(spark, a, b, expected):
    assert one(spark, evidence_f1(F.col("a"), F.col("b")), "a array<string>, b array<string>", a, b) == pytest.approx(expected)


def test_evidence_hit(spark):
    hit = evidence_hit(F.col("e"), F.col("c"))
    assert one(spark, hit, "e string, c string", "The Cat sat.", "yes, the cat sat there")
    assert one(spark, hit, "e string, c string", "one two three four five six seven", "seven six five four three two zero one")
    assert not one(spark, hit, "e string, c string", "red green", "green red")


@pytest.mark.parametrize("p, g, expected", [("a", "A", 1.0), (" B ", "b", 1.0), (None, "A", 0.0)])
def test_accuracy(spark, p, g, expected):
    assert one(spark, accuracy(F.col("p"), F.col("g")), "p string, g string", p, g) == expected


@pytest.mark.parametrize("raw, letter", [("(C)", "C"), ("B. the mill", "B"), ("D", "D"), ("A.", "A"), ("A\nbecause", "A"), ("The option is c, I think", "C"), ("I choose (b) here", "B"), ("Answer: C", "C"), ("  A  ", "A"), ("\nB\n", "B"), ("( B )", "B"), ("A:", "A"), ("A)", "A"), ("B. Big Ben is a clock tower in London.", "B"), ("D) The Pyramid", "D"), ("option b", "B"), ("The answer is D", "D"), ("(option A)", "A"), ("Answer: A. The Eiffel Tower", "A"), ("A cat sat", None), ("   ", None), ("I do not know", None), ("The model could not determine the answer.", None), ("42", None), ("nothing here", None), ("", None), (None, None), ("options are many", None)])
def test_choice_letter(spark, raw, letter):
    assert one(spark, T.choice_letter(F.col("t")), "t string", raw) == letter


@pytest.mark.parametrize("raw, letter", [("Spanish necklace", "B"), ("it is the spanish necklace.", "B"), ("not at all", None), ("No", "A"), ("", None)])
def test_choice_by_text(spark, raw, letter):
    assert one(spark, T.choice_by_text(F.col("t"), F.array(F.lit("No"), F.lit("Spanish necklace"))), "t string", raw) == letter


def test_keys(spark):
    assert one(spark, T.title_key(F.col("t")), "t string", "Mrs. Dalloway") == "mrsdalloway"
    assert one(spark, T.title_key(F.col("t")), "t string", "À la recherche") == "alarecherche"
    assert one(spark, T.slug(F.col("t")), "t string", "--Hello, World!") == "hello-world"
    assert one(spark, T.slug(F.col("t")), "t string", "!!") == "x"
    assert one(spark, T.approx_tokens(F.col("t")), "t string", "abc") == 1
