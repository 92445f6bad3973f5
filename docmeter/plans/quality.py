"""Queries over predictions, scored cells and letters: means, repeats, votes, ranks and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docmeter.functions.text import HEDGES, is_hedge
from docmeter.functions.metrics import rounded
from docmeter.session import table

ARCHITECTURES = ["flat", "naive_rag", "raptor", "graphrag"]
LETTERS = ["A", "B", "C", "D"]
CELL = ["arch", "paper_id", "question_id", "run_index"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cells, each (dataset, question, architecture) once."""
    return table(spark, sf_dir, "scored_cells", "dataset", "cluster", "qid", "arch", "metric").distinct()


def predictions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Predictions of the grid, repeated rows once."""
    return table(spark, sf_dir, "predictions", *CELL, *columns).distinct()


def _metric() -> Column:
    return F.when(F.col("dataset") == "qasper", F.col("answer_f1")).otherwise(F.col("accuracy"))


def macro_by_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metric of each dataset and architecture over rows with a metric."""
    rows = predictions(spark, sf_dir, "dataset", "answer_f1", "accuracy").withColumn("m", _metric()).where(F.col("m").isNotNull())
    return rows.groupBy("dataset", "arch").agg(rounded(F.avg("m")).alias("mean_metric"), F.count(F.lit(1)).alias("n_rows"))


def repeat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metric over the runs of each question and architecture."""
    rows = predictions(spark, sf_dir, "dataset", "answer_f1", "accuracy").withColumn("m", _metric()).where(F.col("m").isNotNull())
    return rows.groupBy("dataset", "paper_id", "question_id", "arch").agg(rounded(F.avg("m")).alias("metric"), F.count_distinct("run_index").alias("n_repeats"))


def letter_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir, "dataset", "predicted_letter").where(F.col("dataset") == "novelqa")
    valid = F.col("predicted_letter").isin(LETTERS)
    return rows.groupBy("arch").agg(*[F.count_if(F.col("predicted_letter") == x).alias(f"n_{x.lower()}") for x in LETTERS], F.count_if(~F.coalesce(valid, F.lit(False))).alias("n_other"))


def variance_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the mean metric of runs: mean, sample deviation, standard error and half-width, and over the questions the
    mean, the nearest-rank 95th percentile and the maximum of the deviation between runs."""
    rows = predictions(spark, sf_dir, "dataset", "answer_f1", "accuracy").withColumn("m", _metric()).where(F.col("m").isNotNull())
    runs = rows.groupBy("dataset", "arch", "run_index").agg(F.avg("m").alias("m")).groupBy("dataset", "arch")
    deviation = F.coalesce(F.stddev_samp("m"), F.lit(0.0))
    by_run = runs.agg(F.count(F.lit(1)).alias("n_runs"), rounded(F.avg("m")).alias("mean"), rounded(deviation).alias("sd"), rounded(deviation / F.sqrt(F.count(F.lit(1)))).alias("sem"), rounded(1.96 * deviation / F.sqrt(F.count(F.lit(1)))).alias("half_width"))
    questions = rows.groupBy("dataset", "arch", "question_id").agg(F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd"))
    by_question = questions.groupBy("dataset", "arch").agg(rounded(F.avg("sd")).alias("question_sd_mean"), rounded(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY sd)")).alias("question_sd_p95"), rounded(F.max("sd")).alias("question_sd_max"))
    return by_run.join(by_question, ["dataset", "arch"])


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of the multiple-choice grid; each architecture and run is a voter."""
    rows = predictions(spark, sf_dir, "dataset", "predicted_letter").where((F.col("dataset") == "novelqa") & F.col("predicted_letter").isin(LETTERS))
    return rows.select("question_id", "arch", "run_index", F.col("predicted_letter").alias("letter")).distinct()


def _modal(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent letter of each key, of equally frequent ones the first, with its votes and all votes."""
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "letter")).alias("b"), F.sum("n").alias("n_votes")).select(*keys, F.col("b.letter").alias("letter"), (-F.col("b.n")).alias("support"), "n_votes")


def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _votes(spark, sf_dir).groupBy("question_id", "letter").agg(F.count(F.lit(1)).alias("n"))
    return _modal(counts, ["question_id"])


def consensus_without_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modal letter of each question without the votes of one architecture, for each architecture that voted."""
    counts = _votes(spark, sf_dir).groupBy("question_id", "arch", "letter").agg(F.count(F.lit(1)).alias("n"))
    voters = counts.select("question_id", F.col("arch").alias("left_out")).distinct()
    others = counts.join(voters, "question_id").where(F.col("arch") != F.col("left_out")).groupBy("question_id", "left_out", "letter").agg(F.sum("n").alias("n"))
    return _modal(others, ["question_id", "left_out"])


def consensus_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each architecture with the consensus of the others, over letters that could be read."""
    own, others = _votes(spark, sf_dir), consensus_without_self(spark, sf_dir).select("question_id", F.col("left_out").alias("arch"), F.col("letter").alias("consensus"))
    hit = F.count_if(F.col("letter") == F.col("consensus"))
    return own.join(others, ["question_id", "arch"]).groupBy("arch").agg(F.count(F.lit(1)).alias("n_votes"), hit.alias("n_correct"), rounded(hit / F.count(F.lit(1))).alias("accuracy"))


def support_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by the share of votes that their consensus has."""
    share = F.col("support") / F.col("n_votes")
    bucket = F.when(share >= 0.8, "strong").when(share >= 0.5, "middling").otherwise("weak")
    return consensus_vote(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_questions"))


def letter_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read, unread and failed letters per dataset and architecture, with all subtotals (level 0, 1, 2, 3)."""
    rows = predictions(spark, sf_dir, "dataset", "predicted_letter", "build_failed")
    return rows.cube("dataset", "arch").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("predicted_letter").isin(LETTERS)).alias("n_read"),
        F.count_if(F.col("predicted_letter").isNotNull() & ~F.col("predicted_letter").isin(LETTERS)).alias("n_unread"), F.count_if("build_failed").alias("n_failed"),
    )


def study_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and papers per dataset."""
    return table(spark, sf_dir, "scored_cells", "dataset", "cluster", "qid").groupBy("dataset").agg(F.count_distinct("cluster", "qid").alias("n_questions"), F.count_distinct("cluster").alias("n_papers"))


def rank_architectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the architectures of each paper by mean metric, ties by name."""
    means = cells(spark, sf_dir).where(F.col("metric").isNotNull()).groupBy("cluster", "arch").agg(rounded(F.avg("metric")).alias("score"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "arch")))


def _by_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per question with the metric of each architecture."""
    return cells(spark, sf_dir).groupBy("dataset", "cluster", "qid").pivot("arch", ARCHITECTURES).agg(F.max("metric"))


def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference between flat and each other architecture over questions that both have."""
    wide = _by_arch(spark, sf_dir)
    long = wide.select("dataset", "flat", F.explode(F.create_map(*[x for a in ARCHITECTURES[1:] for x in (F.lit(a), F.col(a))])).alias("other", "metric"))
    return long.where(F.col("flat").isNotNull() & F.col("metric").isNotNull()).groupBy("dataset", "other").agg(F.count(F.lit(1)).alias("n_pairs"), rounded(F.avg(F.col("flat") - F.col("metric"))).alias("mean_difference"))


def losing_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that all architectures have, and those that flat answers and both structured ones miss."""
    good = F.when(F.col("dataset") == "novelqa", F.col("flat") == 1).otherwise(F.col("flat") >= 0.5)
    bad = [F.when(F.col("dataset") == "novelqa", F.col(a) == 0).otherwise(F.col(a) <= 0.15) for a in ("raptor", "graphrag")]
    complete = _by_arch(spark, sf_dir).where(" AND ".join(f"{a} IS NOT NULL" for a in ARCHITECTURES))
    return complete.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(good & bad[0] & bad[1]).alias("n_losing"))


def slice_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metric of each architecture by length of the paper, and the gap between flat and the least of the others."""
    papers = table(spark, sf_dir, "papers", F.col("paper_id").alias("cluster"), "tokenlen")
    size = F.when(F.col("tokenlen").isNull(), "unknown").when(F.col("tokenlen") < 5000, "short").when(F.col("tokenlen") < 50_000, "medium").otherwise("long")
    rows = cells(spark, sf_dir).join(papers.select("cluster", size.alias("size")), "cluster")
    wide = rows.groupBy("dataset", "size").pivot("arch", ARCHITECTURES).agg(F.avg("metric"))
    return wide.select("dataset", "size", *[rounded(a).alias(a) for a in ARCHITECTURES], rounded(F.col("flat") - F.least(*ARCHITECTURES[1:])).alias("gap"))


def hedge_tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hedged answers on questions that flat answers well, per architecture."""
    good = cells(spark, sf_dir).where((F.col("arch") == "flat") & (F.col("metric") >= 0.5)).select(F.col("qid").alias("question_id")).distinct()
    rows = table(spark, sf_dir, "architecture_results", "result_id", "architecture", "question_id", "predicted_answer").distinct().join(good, "question_id", "left_semi")
    return rows.groupBy("architecture").agg(F.count(F.lit(1)).alias("n_answers"), F.count_if(is_hedge(F.col("predicted_answer"))).alias("n_hedged"))


def build_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir, "build_failed", "failure_reason").where("build_failed").groupBy("arch", "failure_reason").agg(F.count(F.lit(1)).alias("n_cells"))


def spread_over_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and population deviation of the papers' mean metrics per architecture."""
    means = cells(spark, sf_dir).where(F.col("metric").isNotNull()).groupBy("dataset", "cluster", "arch").agg(F.avg("metric").alias("m"))
    return means.groupBy("dataset", "arch").agg(rounded(F.avg("m")).alias("mean"), rounded(F.median("m")).alias("median"), rounded(F.stddev_pop("m")).alias("sd"))


def quality_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per paper, the architectures that no other beats in both mean tokens and mean metric."""
    tokens = table(spark, sf_dir, "ledger", "paper_id", "architecture", "uncached_input_tokens", "failed").where(~F.col("failed") & F.col("paper_id").isNotNull())
    use = tokens.groupBy(F.col("paper_id").alias("cluster"), F.col("architecture").alias("arch")).agg(F.round(F.avg("uncached_input_tokens"), 3).alias("tokens"))
    quality = cells(spark, sf_dir).where(F.col("metric").isNotNull()).groupBy("cluster", "arch").agg(rounded(F.avg("metric")).alias("quality"))
    cheaper = Window.partitionBy("cluster").orderBy("tokens", F.desc("quality"), "arch").rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.max("quality").over(cheaper)
    return use.join(quality, ["cluster", "arch"]).where(F.col("tokens").isNotNull()).withColumn("before", best_before).where(F.col("before").isNull() | (F.col("quality") > F.col("before"))).drop("before")


def closed_book_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metric of each architecture over that of the least one of its dataset."""
    means = cells(spark, sf_dir).where(F.col("metric").isNotNull()).groupBy("dataset", "arch").agg(F.avg("metric").alias("m"))
    floors = means.groupBy("dataset").agg(F.min("m").alias("floor"))
    return means.join(floors, "dataset").select("dataset", "arch", rounded("floor").alias("floor"), rounded(F.col("m") - F.col("floor")).alias("lift"))


def run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the metric of a cell moves from the first to the last run: cells in both, mean, median and how many moved."""
    rows = predictions(spark, sf_dir, "dataset", "answer_f1", "accuracy").withColumn("m", _metric()).where(F.col("m").isNotNull())
    cell = rows.groupBy("dataset", "arch", "paper_id", "question_id").agg(F.max(F.when(F.col("run_index") == 0, F.col("m"))).alias("a"), F.max(F.when(F.col("run_index") == 4, F.col("m"))).alias("b"))
    both = cell.where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("d", F.col("b") - F.col("a"))
    return both.groupBy("dataset", "arch").agg(F.count(F.lit(1)).alias("n_cells"), rounded(F.avg("d")).alias("mean_delta"), rounded(F.median("d")).alias("median_delta"), F.count_if(F.abs("d") > 0.05).alias("n_moved"))


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metric by architecture and run, a column for each run."""
    rows = predictions(spark, sf_dir, "dataset", "answer_f1", "accuracy").withColumn("m", _metric())
    wide = rows.groupBy("dataset", "arch").pivot("run_index", [0, 1, 2, 3, 4]).agg(F.avg("m"))
    return wide.select("dataset", "arch", *[rounded(F.col(str(i))).alias(f"run_{i}") for i in range(5)])


QUERIES = {
    "run_deltas": run_deltas, "run_table": run_table,
    "macro_by_arch": macro_by_arch, "repeat_collapse": repeat_collapse, "letter_distribution": letter_distribution, "variance_across_runs": variance_across_runs, "consensus_vote": consensus_vote,
    "consensus_without_self": consensus_without_self, "consensus_accuracy": consensus_accuracy, "support_buckets": support_buckets, "letter_counters": letter_counters, "study_size": study_size,
    "rank_architectures": rank_architectures, "paired_differences": paired_differences, "losing_slice": losing_slice, "slice_means": slice_means, "hedge_tells": hedge_tells, "build_failures": build_failures,
    "spread_over_papers": spread_over_papers, "quality_frontier": quality_frontier, "closed_book_lift": closed_book_lift,
}

_M = "(SELECT DISTINCT arch, paper_id, question_id, run_index, dataset, answer_f1, accuracy, CASE WHEN dataset = 'qasper' THEN answer_f1 ELSE accuracy END AS m FROM predictions)"
_CELLS = "(SELECT DISTINCT dataset, cluster, qid, arch, metric FROM scored_cells)"
_VOTES = "(SELECT DISTINCT question_id, arch, run_index, predicted_letter AS letter FROM predictions WHERE dataset = 'novelqa' AND predicted_letter IN ('A', 'B', 'C', 'D'))"
_WIDE = f"""(SELECT dataset, cluster, qid, max(metric) FILTER (arch = 'flat') AS flat, max(metric) FILTER (arch = 'naive_rag') AS naive_rag,
    max(metric) FILTER (arch = 'raptor') AS raptor, max(metric) FILTER (arch = 'graphrag') AS graphrag FROM {_CELLS} GROUP BY ALL)"""
_HEDGES = "[" + ", ".join(f"'{h}'" for h in HEDGES) + "]"
_CONSENSUS = f"""(SELECT question_id, letter, n AS support, CAST(sum(n) OVER (PARTITION BY question_id) AS BIGINT) AS n_votes FROM (SELECT question_id, letter, count(*) AS n FROM {_VOTES} GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, letter) = 1)"""
_OTHERS = f"""(SELECT question_id, left_out, letter, n AS support, CAST(sum(n) OVER (PARTITION BY question_id, left_out) AS BIGINT) AS n_votes FROM (
    SELECT v.question_id, o.left_out, v.letter, count(*) AS n FROM {_VOTES} v JOIN (SELECT DISTINCT question_id, arch AS left_out FROM {_VOTES}) o ON v.question_id = o.question_id AND v.arch <> o.left_out GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY question_id, left_out ORDER BY n DESC, letter) = 1)"""

SQL = {
    "run_deltas": f"""WITH c AS (SELECT dataset, arch, paper_id, question_id, max(m) FILTER (run_index = 0) AS a, max(m) FILTER (run_index = 4) AS b FROM {_M} WHERE m IS NOT NULL GROUP BY ALL)
        SELECT dataset, arch, count(*) AS n_cells, round(avg(b - a) + 1e-9, 6) AS mean_delta, round(median(b - a) + 1e-9, 6) AS median_delta, count(*) FILTER (abs(b - a) > 0.05::DOUBLE) AS n_moved FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY dataset, arch""",
    "run_table": f"SELECT dataset, arch, {', '.join(f'round(avg(m) FILTER (run_index = {i}) + 1e-9, 6) AS run_{i}' for i in range(5))} FROM {_M} GROUP BY dataset, arch",
    "macro_by_arch": f"SELECT dataset, arch, round(avg(m) + 1e-9, 6) AS mean_metric, count(*) AS n_rows FROM {_M} WHERE m IS NOT NULL GROUP BY dataset, arch",
    "repeat_collapse": f"SELECT dataset, paper_id, question_id, arch, round(avg(m) + 1e-9, 6) AS metric, count(DISTINCT run_index) AS n_repeats FROM {_M} WHERE m IS NOT NULL GROUP BY ALL",
    "letter_distribution": """SELECT arch, count(*) FILTER (l = 'A') AS n_a, count(*) FILTER (l = 'B') AS n_b, count(*) FILTER (l = 'C') AS n_c, count(*) FILTER (l = 'D') AS n_d, count(*) FILTER (l IS NULL OR l NOT IN ('A', 'B', 'C', 'D')) AS n_other
        FROM (SELECT DISTINCT arch, paper_id, question_id, run_index, predicted_letter AS l FROM predictions WHERE dataset = 'novelqa') GROUP BY arch""",
    "variance_across_runs": f"""WITH m AS (SELECT * FROM {_M} WHERE m IS NOT NULL),
        r AS (SELECT dataset, arch, count(*) AS n, avg(m) AS mean, coalesce(stddev_samp(m), 0) AS sd FROM (SELECT dataset, arch, run_index, avg(m) AS m FROM m GROUP BY ALL) GROUP BY dataset, arch),
        q AS (SELECT dataset, arch, avg(sd) AS a, quantile_disc(sd, 0.95) AS p, max(sd) AS x FROM (SELECT dataset, arch, question_id, coalesce(stddev_samp(m), 0) AS sd FROM m GROUP BY ALL) GROUP BY dataset, arch)
        SELECT dataset, arch, n AS n_runs, round(mean + 1e-9, 6) AS mean, round(sd + 1e-9, 6) AS sd, round(sd / sqrt(n) + 1e-9, 6) AS sem, round(1.96 * sd / sqrt(n) + 1e-9, 6) AS half_width, round(a + 1e-9, 6) AS question_sd_mean, round(p + 1e-9, 6) AS question_sd_p95, round(x + 1e-9, 6) AS question_sd_max
        FROM r JOIN q USING (dataset, arch)""",
    "consensus_vote": f"SELECT * FROM {_CONSENSUS}",
    "consensus_without_self": f"SELECT * FROM {_OTHERS}",
    "consensus_accuracy": f"""SELECT v.arch, count(*) AS n_votes, count(*) FILTER (v.letter = o.letter) AS n_correct, round(count(*) FILTER (v.letter = o.letter) / count(*) + 1e-9, 6) AS accuracy
        FROM {_VOTES} v JOIN {_OTHERS} o ON v.question_id = o.question_id AND v.arch = o.left_out GROUP BY v.arch""",
    "support_buckets": f"SELECT CASE WHEN support / n_votes >= 0.8 THEN 'strong' WHEN support / n_votes >= 0.5 THEN 'middling' ELSE 'weak' END AS bucket, count(*) AS n_questions FROM {_CONSENSUS} GROUP BY bucket",
    "letter_counters": """SELECT dataset, arch, CAST(GROUPING(dataset, arch) AS INT) AS level, count(*) AS n_rows, count(*) FILTER (predicted_letter IN ('A', 'B', 'C', 'D')) AS n_read,
        count(*) FILTER (predicted_letter NOT IN ('A', 'B', 'C', 'D')) AS n_unread, count(*) FILTER (build_failed) AS n_failed
        FROM (SELECT DISTINCT arch, paper_id, question_id, run_index, dataset, predicted_letter, build_failed FROM predictions) GROUP BY CUBE (dataset, arch)""",
    "study_size": "SELECT dataset, count(DISTINCT (cluster, qid)) AS n_questions, count(DISTINCT cluster) AS n_papers FROM scored_cells GROUP BY dataset",
    "rank_architectures": f"SELECT cluster, arch, score, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, arch) AS INT) AS rank FROM (SELECT cluster, arch, round(avg(metric) + 1e-9, 6) AS score FROM {_CELLS} WHERE metric IS NOT NULL GROUP BY ALL)",
    "paired_differences": f"""SELECT dataset, other, count(*) AS n_pairs, round(avg(flat - metric) + 1e-9, 6) AS mean_difference FROM (
        SELECT dataset, flat, 'naive_rag' AS other, naive_rag AS metric FROM {_WIDE} UNION ALL SELECT dataset, flat, 'raptor', raptor FROM {_WIDE} UNION ALL SELECT dataset, flat, 'graphrag', graphrag FROM {_WIDE})
        WHERE flat IS NOT NULL AND metric IS NOT NULL GROUP BY dataset, other""",
    "losing_slice": f"""SELECT dataset, count(*) AS n_questions, count(*) FILTER (CASE WHEN dataset = 'novelqa' THEN flat = 1 AND raptor = 0 AND graphrag = 0 ELSE flat >= 0.5 AND raptor <= 0.15 AND graphrag <= 0.15 END) AS n_losing
        FROM {_WIDE} WHERE flat IS NOT NULL AND naive_rag IS NOT NULL AND raptor IS NOT NULL AND graphrag IS NOT NULL GROUP BY dataset""",
    "slice_means": f"""WITH s AS (SELECT c.*, CASE WHEN tokenlen IS NULL THEN 'unknown' WHEN tokenlen < 5000 THEN 'short' WHEN tokenlen < 50000 THEN 'medium' ELSE 'long' END AS size FROM {_CELLS} c JOIN papers ON cluster = paper_id),
        w AS (SELECT dataset, size, avg(metric) FILTER (arch = 'flat') AS flat, avg(metric) FILTER (arch = 'naive_rag') AS naive_rag, avg(metric) FILTER (arch = 'raptor') AS raptor, avg(metric) FILTER (arch = 'graphrag') AS graphrag FROM s GROUP BY ALL)
        SELECT dataset, size, round(flat + 1e-9, 6) AS flat, round(naive_rag + 1e-9, 6) AS naive_rag, round(raptor + 1e-9, 6) AS raptor, round(graphrag + 1e-9, 6) AS graphrag, round(flat - least(naive_rag, raptor, graphrag) + 1e-9, 6) AS gap FROM w""",
    "hedge_tells": f"""WITH g AS (SELECT DISTINCT qid FROM {_CELLS} WHERE arch = 'flat' AND metric >= 0.5)
        SELECT architecture, count(*) AS n_answers, count(*) FILTER (len(list_filter({_HEDGES},
            lambda h: contains(lower(coalesce(predicted_answer, '')), h))) > 0) AS n_hedged
        FROM (SELECT DISTINCT result_id, architecture, question_id, predicted_answer FROM architecture_results) WHERE question_id IN (SELECT qid FROM g) GROUP BY architecture""",
    "build_failures": "SELECT arch, failure_reason, count(*) AS n_cells FROM (SELECT DISTINCT arch, paper_id, question_id, run_index, build_failed, failure_reason FROM predictions) WHERE build_failed GROUP BY ALL",
    "spread_over_papers": f"SELECT dataset, arch, round(avg(m) + 1e-9, 6) AS mean, round(median(m) + 1e-9, 6) AS median, round(stddev_pop(m) + 1e-9, 6) AS sd FROM (SELECT dataset, cluster, arch, avg(metric) AS m FROM {_CELLS} WHERE metric IS NOT NULL GROUP BY ALL) GROUP BY dataset, arch",
    "quality_frontier": f"""WITH u AS (SELECT paper_id AS cluster, architecture AS arch, round(avg(uncached_input_tokens), 3) AS tokens FROM ledger WHERE NOT failed AND paper_id IS NOT NULL GROUP BY ALL),
        q AS (SELECT cluster, arch, round(avg(metric) + 1e-9, 6) AS quality FROM {_CELLS} WHERE metric IS NOT NULL GROUP BY ALL),
        j AS (SELECT cluster, arch, tokens, quality, max(quality) OVER (PARTITION BY cluster ORDER BY tokens, quality DESC, arch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM u JOIN q USING (cluster, arch) WHERE tokens IS NOT NULL)
        SELECT cluster, arch, tokens, quality FROM j WHERE b IS NULL OR quality > b""",
    "closed_book_lift": f"WITH m AS (SELECT dataset, arch, avg(metric) AS m FROM {_CELLS} WHERE metric IS NOT NULL GROUP BY ALL), f AS (SELECT dataset, min(m) AS floor FROM m GROUP BY dataset) SELECT dataset, arch, round(floor + 1e-9, 6) AS floor, round(m - floor + 1e-9, 6) AS lift FROM m JOIN f USING (dataset)",
}
