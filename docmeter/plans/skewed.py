"""Problem 3: results per key of tables in which a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmeter.operators.skew import heavy_keys, tree_aggregate
from docmeter.session import table

LEAST_SHARE = 0.03


def ledger_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncached input tokens and rows per paper and stage; rows as stored, null papers and stages are groups."""
    ledger = table(spark, sf_dir, "ledger", "paper_id", "stage", "uncached_input_tokens")
    return tree_aggregate(
        ledger,
        ["paper_id", "stage"],
        {"uncached_input_tokens": ("sum", "uncached_input_tokens"), "n_rows": ("count_rows", "")},
    )


def prediction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of predictions per paper; rows as stored, a null paper is a group."""
    return tree_aggregate(table(spark, sf_dir, "predictions", "paper_id"), ["paper_id"], {"n_rows": ("count_rows", "")})


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, paper_id: the papers that hold at least 3 of every 100 rows of ledger or predictions."""
    per_paper = ledger_sums(spark, sf_dir).groupBy("paper_id").agg(F.sum("n_rows").alias("n")).select(F.lit("ledger").alias("table_name"), "paper_id", "n")
    counts = per_paper.unionByName(prediction_counts(spark, sf_dir).select(F.lit("predictions").alias("table_name"), "paper_id", F.col("n_rows").alias("n")))
    return heavy_keys(counts, "paper_id", LEAST_SHARE, ["table_name"])


QUERIES = {"p3_found": found, "p3_ledger_sums": ledger_sums, "p3_prediction_counts": prediction_counts}

SQL = {
    "p3_found": """
        WITH n AS (
            SELECT 'ledger' AS table_name, paper_id, count(*) AS n FROM ledger WHERE paper_id IS NOT NULL GROUP BY paper_id
            UNION ALL
            SELECT 'predictions', paper_id, count(*) FROM predictions WHERE paper_id IS NOT NULL GROUP BY paper_id)
        SELECT table_name, paper_id FROM n
        QUALIFY n >= 0.03 * sum(n) OVER (PARTITION BY table_name)""",
    "p3_ledger_sums": """
        SELECT paper_id, stage, CAST(sum(uncached_input_tokens) AS BIGINT) AS uncached_input_tokens, count(*) AS n_rows
        FROM ledger GROUP BY paper_id, stage""",
    "p3_prediction_counts": "SELECT paper_id, count(*) AS n_rows FROM predictions GROUP BY paper_id",
}
