"""Problem 1: broken question and answer pairs.

Answers are split into sentences, and the distinct sentences of all answers are sorted: one that is a strict prefix of
its neighbour is a shortened version of it. Answers that pile up at one length show a limit (a spike). Then the rules for
empty answers, copies of the question, refusals and other languages apply; languages are told by function words and by a
model that the documents' own languages fit (see languages).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docmeter.llm import languages
from docmeter.llm.rules import EMPTY_WORDS, REFUSAL, UNSTATED, any_of, without_label
from docmeter.llm.segments import TERMINATED, looked_up, next_in_order, sentences, words
from docmeter.session import stored, table

# Openings that add nothing to a repeated question.
OPENINGS = [
    "ok", "okay", "well", "so", "hmm", "sure", "certainly", "of course", "let me think", "let me see", "that is a good question", "that s a good question", "good question", "great question",
    "you asked", "you ask", "i was asked", "your question is", "your question was", "the question is", "the question was", "the question reads", "question", "q", "user", "repeat", "again",
    "die frage ist", "die frage lautet", "frage", "la question est", "la question posée est", "la pregunta es", "pregunta", "la domanda è", "domanda", "a pergunta é", "pergunta", "вопрос", "问题",
]

QUOTED = r""""[^"]*"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」"""
LETTER_OPTION = r"(?iU)^\W*(?:option|choice|answer)?\s*\(?[A-H]\)?[.:)]?(?:\s.*)?$"
SPIKE_RATIO = 3.0
OPEN_RATE = 0.3
LEAST_WORDS = 3


def plain_words(text: Column) -> Column:
    """Lower case, letters and digits only, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def is_empty(bare: Column) -> Column:
    """Whether no answer content is left of a text, its label and markup taken away, besides fillers."""
    return ~bare.rlike(r"[\p{L}\p{N}]") | F.lower(bare).isin(EMPTY_WORDS)


OPENING = rf"^(?:(?:{'|'.join(re.escape(x) for x in sorted(OPENINGS, key=len, reverse=True))}) )+"


def is_copy(q: Column, a: Column) -> Column:
    """Whether an answer gives back the question, perhaps with a slip or without its beginning, and no more; both come as
    plain_words() leaves them, without an opening."""
    slips = F.greatest(F.lit(2), F.floor(F.length(q) * 0.12))
    near = F.abs(F.length(a) - F.length(q)) <= slips
    part = (F.length(a) >= 0.5 * F.length(q)) & (q.endswith(a) | q.startswith(a))
    return F.coalesce((a != "") & (F.length(q) >= 6) & (part | F.when(near, F.levenshtein(a, q) <= slips).otherwise(False)), F.lit(False))


def is_refusal(said: Column) -> Column:
    """Whether an answer, without quotations, declines to answer; saying that the document lacks it is none."""
    return any_of(said, REFUSAL) & ~any_of(said, UNSTATED)


def _said(answer: Column) -> Column:
    """The answer with straight apostrophes and without quotations; most answers have neither and stay as they are."""
    straight = F.when(answer.contains("’") | answer.contains("ʼ"), F.regexp_replace(answer, r"(?<=\p{L})[’ʼ](?=\p{L})", "'")).otherwise(answer)
    return F.when(straight.rlike('["“„«「]'), F.regexp_replace(straight, QUOTED, " ")).otherwise(straight)


def _after_question(question: Column, answer: Column) -> Column:
    """The answer without a repetition of the question before it."""
    return F.when(F.lower(answer).startswith(F.lower(F.trim(question))), F.substring(answer, F.length(F.trim(question)) + 1, F.lit(1 << 30))).otherwise(answer)


def marked(answers: DataFrame) -> DataFrame:
    """answers (with text) and n_words and open: whether no sentence ends the text. A null or blank text has no open end."""
    return answers.withColumn("n_words", words(F.coalesce("text", F.lit("")))).withColumn("open", (F.col("n_words") > 0) & ~F.coalesce(F.col("text").rlike(TERMINATED), F.lit(False)) & ~F.trim("text").rlike(LETTER_OPTION))


def open_ends(answers: DataFrame, key: str = "result_id") -> DataFrame:
    """The rows of answers (marked(), with source and length) that have an open end, and the evidence that the end is missing.

    shortened: the last sentence is a strict prefix of its neighbour in the sorted order of all sentences; spike: texts with
    an open end pile up at its length; baseline: the rate of open ends among the distinct texts of its source; structure,
    going, alone and begun: see with_own_evidence(). key is a column that tells rows apart, so that the rows of one text or
    word are spread over tasks.
    """
    from docmeter.llm.cut import distinct_texts, with_own_evidence  # which imports this module

    long = F.col("open") & (F.col("n_words") >= LEAST_WORDS)
    order = next_in_order(answers.select(F.explode(sentences("text")).alias("segment")), "segment")
    shortened = order.where(F.col("next").startswith(F.col("segment"))).select(
        F.col("segment").alias("tail"),
        F.concat(F.substring("segment", -1, 1), F.substring(F.col("next"), F.length("segment") + 1, F.lit(1))).rlike(r"(?U)^\p{L}\p{L}$").alias("within_word"),
    )
    lengths = answers.groupBy("source", "length").agg(F.count_if(long).alias("n_open"))
    around = Window.partitionBy("source").orderBy("length").rangeBetween(-3, 3)
    spikes = lengths.withColumn("others", (F.sum("n_open").over(around) - F.col("n_open")) / 6).where((F.col("n_open") >= 5) & (F.col("n_open") >= SPIKE_RATIO * F.col("others")) & F.col("length").isNotNull())
    once = stored(distinct_texts(answers, "n_words", "open"), "texts")
    rates = once.where(F.col("n_words") >= LEAST_WORDS).groupBy("source").agg(F.avg(F.col("open").cast("int")).alias("baseline"))
    rows = answers.where("open").withColumn("source", F.coalesce("source", F.lit(""))).withColumn("tail", F.element_at(sentences("text"), -1))
    rows = looked_up(rows, stored(shortened, "shortened"), ["tail"], key).drop("tail")
    rows = looked_up(rows, spikes.select(F.coalesce("source", F.lit("")).alias("source"), "length", F.lit(True).alias("spike")), ["source", "length"], key)
    rows = looked_up(rows, rates, ["source"], key)
    rows = rows.withColumns({"shortened": F.col("within_word").isNotNull(), "within_word": F.coalesce("within_word", F.lit(False)), "spike": F.coalesce("spike", F.lit(False))})
    return with_own_evidence(rows, once, key)


def is_cut(ends: DataFrame) -> Column:
    """From the evidence of open_ends(): a longer text with an open end is cut if its source usually ends its sentences,
    if it is a shortened version of a neighbour, lies at a spike or shows by itself that it goes on; a short one only if a
    neighbour goes on within its last word, and if it is no number; a single word also must be none that is used whole."""
    odd = F.trim("text").rlike(r"(?U)�[…\s]*$")
    long = (F.col("n_words") >= LEAST_WORDS) & (F.col("shortened") | F.col("spike") | F.col("structure") | F.col("going") | F.col("begun") | (F.coalesce("baseline", F.lit(0.0)) < OPEN_RATE))
    short = ((F.col("n_words") == 2) | ((F.col("n_words") == 1) & F.col("alone"))) & F.col("within_word")
    return F.col("open") & (odd | long | short)


def defects(pairs: DataFrame, model: languages.LanguageModel | None = None) -> DataFrame:
    """result_id and defect (empty, copied_question, refusal, truncated, other_language, or null for a sound pair) of each
    result; pairs has result_id, question, predicted_answer, architecture and response_token_count.

    model tells languages beside function words and scripts. A null answer is empty. A null question has no copies and no other language. A null count is at no spike. Copies of a
    result come out once, an empty table gives no rows, other columns are not read. The first defect in the order above
    counts.
    """
    texts = pairs.select("result_id", "question", F.col("architecture").alias("source"), F.col("response_token_count").alias("length"), without_label(F.col("predicted_answer")).alias("text"))
    plain = texts.withColumns({"q": F.regexp_replace(plain_words(F.col("question")), OPENING, ""), "a": F.regexp_replace(plain_words(F.col("text")), OPENING, ""), "said": _said(F.col("text"))})
    rule = F.when(is_empty(F.col("text")), "empty").when(is_copy(F.col("q"), F.col("a")), "copied_question").when(is_refusal(F.col("said")), "refusal")
    ruled = stored(plain.withColumn("rule", rule).drop("q", "a", "said"), "pairs")
    rest = stored(marked(ruled.where(F.col("rule").isNull()).drop("rule")), "marked")
    ends = open_ends(rest)
    kept = ends.withColumn("cut", is_cut(ends)).select("result_id", "question", "text", "cut").unionByName(rest.where(~F.col("open")).select("result_id", "question", "text", F.lit(False).alias("cut")))
    told_in = [languages.language(model or languages.no_model(), c) for c in (F.col("question"), _after_question(F.col("question"), F.col("text")))]
    foreign = told_in[0] != told_in[1]
    told = kept.where(~F.col("cut")).select("result_id", F.when(foreign, "other_language").alias("defect"))
    shortened = kept.where("cut").select("result_id", F.lit("truncated").alias("defect"))
    return ruled.where(F.col("rule").isNotNull()).select("result_id", F.col("rule").alias("defect")).unionByName(told).unionByName(shortened).distinct()


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "architecture_results", "result_id", "question", "predicted_answer", "architecture", "response_token_count")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """result_id, defect: one row per broken result."""
    model = languages.fit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return defects(_pairs(spark, sf_dir), model).where(F.col("defect").isNotNull())


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and defects by kind, for each architecture, beside what the runs say of themselves: results marked failed,
    marked failed for a stated reason, marked failed though sound, and defective though not marked."""
    kinds = ["empty", "truncated", "refusal", "copied_question", "other_language"]
    results = table(spark, sf_dir, "architecture_results", "result_id", "architecture", "failed", "failure_reason")
    pairs = results.groupBy("result_id", "architecture").agg(F.max(F.coalesce("failed", F.lit(False))).alias("failed"), F.max("failure_reason").alias("reason"))
    n, counts = F.count(F.lit(1)), [F.count_if(F.col("defect") == k).alias(k) for k in kinds]
    broken = F.col("defect").isNotNull()
    return pairs.join(found(spark, sf_dir), "result_id", "left").groupBy("architecture").agg(
        n.alias("n_results"), *counts, (F.count_if(broken) / n).alias("defect_rate"), F.count_if("failed").alias("n_failed"), F.count_if(F.col("failed") & F.col("reason").isNotNull()).alias("n_with_reason"),
        F.count_if(F.col("failed") & ~broken).alias("n_failed_sound"), F.count_if(~F.col("failed") & broken).alias("n_unmarked"),
    )


QUERIES = {"p1_found": found, "p1_rates": rates}
