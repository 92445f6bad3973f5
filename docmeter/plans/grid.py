"""Queries over the grid of cells: what is missing, what is left to run, samples, set operations, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docmeter.session import table

CELL = ["arch", "paper_id", "question_id", "run_index"]
RUNS = 5
SEED = "20260616"


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions", *CELL).distinct()


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the scored set with every architecture and run."""
    questions = table(spark, sf_dir, "scored_cells", F.col("cluster").alias("paper_id"), F.col("qid").alias("question_id")).distinct()
    archs = F.array(*[F.lit(a) for a in ("flat", "naive_rag", "raptor", "graphrag")])
    runs = F.sequence(F.lit(0), F.lit(RUNS - 1))
    return questions.select(F.explode(archs).alias("arch"), "paper_id", "question_id").select("arch", "paper_id", "question_id", F.explode(runs).alias("run_index"))


def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expected(spark, sf_dir).join(present(spark, sf_dir), CELL, "left_anti")


def missing_by_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_cells(spark, sf_dir).groupBy("arch", "run_index").agg(F.count(F.lit(1)).alias("n_missing"))


def pending_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells whose architecture never failed to build their paper."""
    failed = table(spark, sf_dir, "predictions", "arch", "paper_id", "build_failed").where("build_failed").select("arch", "paper_id").distinct()
    return missing_cells(spark, sf_dir).join(failed, ["arch", "paper_id"], "left_anti")


def surplus_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are there but not expected."""
    return present(spark, sf_dir).exceptAll(expected(spark, sf_dir).select(*CELL)).distinct()


def eligible_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with two questions or more, and their questions."""
    rows = table(spark, sf_dir, "scored_cells", "cluster", "qid").distinct()
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_questions")).where("n_questions >= 2")


def leaked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that more than one paper has."""
    return table(spark, sf_dir, "scored_cells", "cluster", "qid").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n_papers")).where("n_papers > 1")


def uncited_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers without any document."""
    return table(spark, sf_dir, "papers", "paper_id", "dataset").join(table(spark, sf_dir, "documents", "paper_id").distinct(), "paper_id", "left_anti")


def seeded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five questions of each paper, drawn by a seeded hash (a sampling operator: the limit is its purpose)."""
    rows = table(spark, sf_dir, "scored_cells", "cluster", "qid").distinct()
    draw = Window.partitionBy("cluster").orderBy(F.sha2(F.concat(F.lit(SEED), "cluster", "qid"), 256))
    return rows.withColumn("n", F.row_number().over(draw)).where("n <= 5").select("cluster", "qid", "n")


def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scored_cells", "dataset", "cluster", "qid").groupBy("dataset", "cluster").agg(F.min("qid").alias("qid"))


def common_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that all four architectures have in all runs."""
    rows = present(spark, sf_dir).groupBy("paper_id", "question_id").agg(F.count_distinct("arch", "run_index").alias("n"))
    return rows.where(F.col("n") == 4 * RUNS).select("paper_id", "question_id")


def shared_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that ledger, predictions and documents all have."""
    names = ["ledger", "predictions", "documents"]
    parts = [table(spark, sf_dir, n, "paper_id").where(F.col("paper_id").isNotNull()) for n in names]
    return parts[0].intersect(parts[1]).intersect(parts[2])


def conflicting_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose rows disagree about the answer."""
    rows = table(spark, sf_dir, "predictions", *CELL, "predicted_answer").groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.coalesce("predicted_answer", F.lit("\0"))).alias("n_answers"))
    return rows.where("n_answers > 1")


def submission_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of each novel in the order of its questions, for flat in run 0; a question without a letter gets A."""
    questions = table(spark, sf_dir, "scored_cells", "dataset", F.col("cluster").alias("paper_id"), F.col("qid").alias("question_id")).where("dataset = 'novelqa'").drop("dataset").distinct()
    letters = table(spark, sf_dir, "predictions", *CELL, "predicted_letter").where("arch = 'flat' AND run_index = 0").groupBy("paper_id", "question_id").agg(F.min("predicted_letter").alias("letter"))
    valid = F.when(F.col("letter").isin("A", "B", "C", "D"), F.col("letter"))
    rows = questions.join(letters, ["paper_id", "question_id"], "left").withColumn("letter", valid)
    ordered = F.array_sort(F.collect_list(F.struct("question_id", F.coalesce("letter", F.lit("A")).alias("letter"))))
    return rows.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias("letters"), F.count("letter").alias("n_covered"), F.count_if(F.col("letter").isNull()).alias("n_missing"))


def truth_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right answers of each novel and architecture as a string of T and F in the order of questions, its length and Ts."""
    rows = table(spark, sf_dir, "scored_cells", "dataset", "cluster", "qid", "arch", "metric").where("dataset = 'novelqa' AND metric IS NOT NULL").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("qid", F.when(F.col("metric") >= 0.5, "T").otherwise("F").alias("c"))))
    strings = rows.groupBy("cluster", "arch").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), "").alias("letters"))
    return strings.select("cluster", "arch", "letters", F.length("letters").alias("n"), (F.length("letters") - F.length(F.replace("letters", F.lit("T")))).alias("n_true"))


def question_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings of truth_strings taken apart again: right answers by position."""
    letters = truth_strings(spark, sf_dir).select("arch", F.posexplode(F.split("letters", "")).alias("position", "c"))
    return letters.groupBy("arch", "position").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") == "T").alias("n_true"))


def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three first results of each architecture and reason that failed."""
    rows = table(spark, sf_dir, "architecture_results", "result_id", "architecture", "failed", "failure_reason").where("failed").select("result_id", "architecture", F.coalesce("failure_reason", F.lit("unknown")).alias("reason")).distinct()
    rank = Window.partitionBy("architecture", "reason").orderBy("result_id")
    return rows.withColumn("n", F.row_number().over(rank)).where("n <= 3")


def result_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the grid in two disjoint parts, those to submit (built, with an answer) and failures: how many of each
    architecture and data set, and their papers."""
    rows = table(spark, sf_dir, "predictions", *CELL, "dataset", "predicted_answer", "build_failed").distinct()
    sound = ~F.coalesce("build_failed", F.lit(False)) & (F.coalesce(F.trim("predicted_answer"), F.lit("")) != "")
    parts = rows.where(sound).withColumn("part", F.lit("submission")).unionByName(rows.where(~sound).withColumn("part", F.lit("failure")))
    return parts.groupBy("part", "dataset", "arch").agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("paper_id").alias("n_papers"))


def overridden_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter for each question: that of flat's first run, unless people voted, whose most frequent letter then counts."""
    flat = table(spark, sf_dir, "predictions", "arch", "question_id", "run_index", "predicted_letter").where("arch = 'flat' AND run_index = 0 AND predicted_letter IN ('A', 'B', 'C', 'D')").groupBy("question_id").agg(F.min("predicted_letter").alias("letter"))
    votes = table(spark, sf_dir, "letter_votes", "question_id", "annotator", "predicted_letter_rescored").distinct()
    letter = F.upper(F.regexp_extract("predicted_letter_rescored", r"([A-Da-d])", 1))
    counts = votes.select("question_id", letter.alias("letter")).where("letter <> '' AND question_id IS NOT NULL").groupBy("question_id", "letter").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy("question_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "letter")).alias("b")).select("question_id", F.col("b.letter").alias("letter"))
    both = flat.withColumn("origin", F.lit(0)).unionByName(modal.withColumn("origin", F.lit(1)))
    return both.groupBy("question_id").agg(F.max_by("letter", "origin").alias("letter"), (F.max("origin") == 1).alias("voted"))


QUERIES = {
    "missing_cells": missing_cells, "missing_by_arch": missing_by_arch, "pending_cells": pending_cells, "surplus_cells": surplus_cells, "eligible_papers": eligible_papers, "leaked_questions": leaked_questions,
    "uncited_papers": uncited_papers, "seeded_questions": seeded_questions, "first_questions": first_questions, "common_questions": common_questions, "shared_papers": shared_papers,
    "conflicting_cells": conflicting_cells, "submission_lists": submission_lists, "truth_strings": truth_strings, "question_positions": question_positions,
    "failure_examples": failure_examples, "result_parts": result_parts, "overridden_letters": overridden_letters,
}

_PRESENT = "(SELECT DISTINCT arch, paper_id, question_id, run_index FROM predictions)"
_EXPECTED = """(SELECT a.arch, q.paper_id, q.question_id, CAST(r.run_index AS INT) AS run_index FROM (SELECT DISTINCT cluster AS paper_id, qid AS question_id FROM scored_cells) q
    CROSS JOIN (VALUES ('flat'), ('naive_rag'), ('raptor'), ('graphrag')) a(arch) CROSS JOIN range(5) r(run_index))"""
_MISSING = f"(SELECT * FROM {_EXPECTED} e ANTI JOIN {_PRESENT} p USING (arch, paper_id, question_id, run_index))"
_STRINGS = """(SELECT cluster, arch, string_agg(CASE WHEN metric >= 0.5 THEN 'T' ELSE 'F' END, '' ORDER BY qid, metric) AS letters
    FROM (SELECT DISTINCT cluster, qid, arch, metric FROM scored_cells WHERE dataset = 'novelqa' AND metric IS NOT NULL) GROUP BY cluster, arch)"""

SQL = {
    "missing_cells": f"SELECT arch, paper_id, question_id, run_index FROM {_MISSING}",
    "missing_by_arch": f"SELECT arch, run_index, count(*) AS n_missing FROM {_MISSING} GROUP BY ALL",
    "pending_cells": f"SELECT arch, paper_id, question_id, run_index FROM {_MISSING} ANTI JOIN (SELECT arch, paper_id FROM predictions WHERE build_failed) USING (arch, paper_id)",
    "surplus_cells": f"SELECT * FROM {_PRESENT} EXCEPT SELECT arch, paper_id, question_id, run_index FROM {_EXPECTED}",
    "eligible_papers": "SELECT cluster, count(DISTINCT qid) AS n_questions FROM scored_cells GROUP BY cluster HAVING count(DISTINCT qid) >= 2",
    "leaked_questions": "SELECT qid, count(DISTINCT cluster) AS n_papers FROM scored_cells GROUP BY qid HAVING count(DISTINCT cluster) > 1",
    "uncited_papers": "SELECT paper_id, dataset FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM documents WHERE paper_id IS NOT NULL)",
    "seeded_questions": f"""SELECT cluster, qid, CAST(n AS INT) AS n FROM (SELECT cluster, qid, row_number() OVER (PARTITION BY cluster ORDER BY sha256('{SEED}' || cluster || qid)) AS n
        FROM (SELECT DISTINCT cluster, qid FROM scored_cells)) WHERE n <= 5""",
    "first_questions": "SELECT dataset, cluster, min(qid) AS qid FROM scored_cells GROUP BY ALL",
    "common_questions": f"SELECT paper_id, question_id FROM {_PRESENT} WHERE arch IS NOT NULL AND run_index IS NOT NULL GROUP BY paper_id, question_id HAVING count(*) = 20",
    "shared_papers": "SELECT paper_id FROM ledger WHERE paper_id IS NOT NULL INTERSECT SELECT paper_id FROM predictions INTERSECT SELECT paper_id FROM documents",
    "conflicting_cells": "SELECT arch, paper_id, question_id, run_index, count(*) AS n_rows, count(DISTINCT coalesce(predicted_answer, chr(0))) AS n_answers FROM predictions GROUP BY ALL HAVING count(DISTINCT coalesce(predicted_answer, chr(0))) > 1",
    "submission_lists": f"""WITH q AS (SELECT DISTINCT cluster AS paper_id, qid AS question_id FROM scored_cells WHERE dataset = 'novelqa'),
        l AS (SELECT paper_id, question_id, min(predicted_letter) AS letter FROM predictions WHERE arch = 'flat' AND run_index = 0 GROUP BY ALL),
        v AS (SELECT q.paper_id, q.question_id, CASE WHEN letter IN ('A', 'B', 'C', 'D') THEN letter END AS letter FROM q LEFT JOIN l USING (paper_id, question_id))
        SELECT paper_id, string_agg(coalesce(letter, 'A'), '' ORDER BY question_id, letter) AS letters, count(letter) AS n_covered, count(*) FILTER (letter IS NULL) AS n_missing FROM v GROUP BY paper_id""",
    "truth_strings": f"SELECT cluster, arch, letters, CAST(length(letters) AS INT) AS n, CAST(length(letters) - length(replace(letters, 'T', '')) AS INT) AS n_true FROM {_STRINGS}",
    "question_positions": f"""SELECT arch, CAST(p - 1 AS INT) AS position, count(*) AS n, count(*) FILTER (c = 'T') AS n_true FROM (SELECT arch, unnest(string_split(letters, '')) AS c, generate_subscripts(string_split(letters, ''), 1) AS p FROM {_STRINGS}) WHERE c <> '' GROUP BY ALL""",
    "failure_examples": """SELECT result_id, architecture, reason, CAST(row_number() OVER (PARTITION BY architecture, reason ORDER BY result_id) AS INT) AS n
        FROM (SELECT DISTINCT result_id, architecture, coalesce(failure_reason, 'unknown') AS reason FROM architecture_results WHERE failed) QUALIFY n <= 3""",
    "result_parts": """SELECT CASE WHEN NOT coalesce(build_failed, FALSE) AND coalesce(trim(predicted_answer, ' '), '') <> '' THEN 'submission' ELSE 'failure' END AS part, dataset, arch, count(*) AS n_cells, count(DISTINCT paper_id) AS n_papers
        FROM (SELECT DISTINCT arch, paper_id, question_id, run_index, dataset, predicted_answer, build_failed FROM predictions) GROUP BY ALL""",
    "overridden_letters": """WITH f AS (SELECT question_id, min(predicted_letter) AS letter FROM predictions WHERE arch = 'flat' AND run_index = 0 AND predicted_letter IN ('A', 'B', 'C', 'D') GROUP BY question_id),
        v AS (SELECT question_id, upper(regexp_extract(predicted_letter_rescored, '([A-Da-d])', 1)) AS letter FROM (SELECT DISTINCT question_id, annotator, predicted_letter_rescored FROM letter_votes) WHERE question_id IS NOT NULL),
        m AS (SELECT question_id, letter FROM (SELECT question_id, letter, count(*) AS n FROM v WHERE letter <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, letter) = 1)
        SELECT coalesce(m.question_id, f.question_id) AS question_id, coalesce(m.letter, f.letter) AS letter, m.letter IS NOT NULL AS voted FROM f FULL JOIN m ON f.question_id = m.question_id""",
}
