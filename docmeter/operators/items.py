"""Work items from nested sources: questions of papers and novels, hold-outs, eligibility, slices, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docmeter.functions import records as R


def paper_questions(papers: DataFrame) -> DataFrame:
    """One row per question of nested papers, with the document, its gold answers and evidence."""
    rows = papers.select("paper_id", R.linear_document(F.col("title"), F.col("abstract"), F.col("full_text")).alias("document"), F.explode("qas").alias("qa"))
    return rows.select(
        F.lit("qasper").alias("dataset"), "paper_id", F.col("qa.question_id").alias("question_id"), F.col("qa.question").alias("question"), "document",
        R.gold_answers(F.col("qa.answers")).alias("gold_answers"), R.gold_evidence(F.col("qa.answers")).alias("gold_evidence"), R.answer_type(F.col("qa.answers")[0]["answer"]).alias("answer_type"),
    )


def novel_questions(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per question of novels (novel_id, question_id, Question, Options) with the text (name, text)."""
    return questions.join(texts.select(F.col("name").alias("novel_id"), F.col("text").alias("document")), "novel_id", "left").select(
        F.lit("novelqa").alias("dataset"), F.col("novel_id").alias("paper_id"), "question_id", F.col("Question").alias("question"), F.col("Options").alias("options"), "document"
    )


def full_split(items: DataFrame, held_out: DataFrame, excluded: list[str], least: int = 2, documents: int | None = None) -> DataFrame:
    """Items without held-out questions and excluded documents, of documents that keep at least `least` questions; of these
    the first `documents` in the order of their ids, so that a smaller slice is the beginning of a larger one."""
    rest = items.join(held_out.select("question_id").distinct(), "question_id", "left_anti").where(~F.col("paper_id").isin(excluded) if excluded else F.lit(True))
    counts = rest.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("paper_id")
    kept = counts.orderBy("paper_id").limit(documents) if documents is not None else counts
    return rest.join(kept, "paper_id", "left_semi")


def calibration_pool(papers: DataFrame, test: DataFrame, size: int = 20, seed: int = 42) -> DataFrame:
    """The first question with evidence of each paper that is not in the test split; of these papers `size`, drawn by a
    seeded hash."""
    rows = papers.join(test.select("paper_id"), "paper_id", "left_anti").select("paper_id", F.explode("qas").alias("qa")).where(R.has_evidence(F.col("qa.answers")))
    first = rows.groupBy("paper_id").agg(F.min(F.struct(F.col("qa.question_id").alias("question_id"), F.col("qa.question").alias("question"))).alias("q")).select("paper_id", "q.*")
    return first.orderBy(F.sha2(F.concat(F.lit(str(seed)), "paper_id"), 256)).limit(size)


def novel_pool(questions: DataFrame, novels: int = 4, each: int = 5, seed: int = 42) -> DataFrame:
    """`each` questions of `novels` novels, drawn by a seeded hash."""
    chosen = questions.select("novel_id").distinct().orderBy(F.sha2(F.concat(F.lit(str(seed)), "novel_id"), 256)).limit(novels)
    draw = Window.partitionBy("novel_id").orderBy(F.sha2(F.concat(F.lit(str(seed)), "novel_id", "question_id"), 256))
    return questions.join(chosen, "novel_id", "left_semi").withColumn("n", F.row_number().over(draw)).where(F.col("n") <= each).drop("n")
