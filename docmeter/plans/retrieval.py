"""Queries of chunking, vector search and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docmeter.operators.retrieval import chunked, context, hashed_vectors, nearest, retrieved
from docmeter.functions.metrics import rounded
from docmeter.session import stored, table

K = 10


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 20 against all vectors but themselves."""
    corpus = _vectors(spark, sf_dir)
    queries = corpus.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vector")
    found = nearest(queries, corpus, K + 1).where(F.col("query_id") != F.col("id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= K)


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("query_id", "id", "rank", rounded("score").alias("score"))


def label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first 5 and 10 neighbours that have the label of their query, on average."""
    labels = table(spark, sf_dir, "embeddings", "vec_id", "label")
    rows = _nearest(spark, sf_dir).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    hit = (F.col("asked") == F.col("label")).cast("double")
    each = rows.groupBy("query_id", "asked").agg(F.avg(F.when(F.col("rank") <= 5, hit)).alias("at_5"), F.avg(hit).alias("at_10"))
    return each.groupBy(F.col("asked").alias("label")).agg(F.count(F.lit(1)).alias("n_queries"), rounded(F.avg("at_5")).alias("at_5"), rounded(F.avg("at_10")).alias("at_10"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 100 tokens of every document: how many, and a digest of the document put together again."""
    chunks = chunked(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", 100)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "chunk")))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["chunk"]), ""), 256).alias("digest"))


def question_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question of architecture_results, the eight chunks of its paper's documents most like it by their words, as a
    context of 2,000 tokens: the digest and the number of chunks. Documents of all sources, unknown ones too, are read; a
    question without a paper, or whose paper has no text, has no digest and 0 chunks."""
    documents = table(spark, sf_dir, "documents", "paper_id", "doc_id", "text").where(F.col("paper_id").isNotNull())
    pieces = chunked(documents, "doc_id", "text", 384).join(documents.select("doc_id", "paper_id"), "doc_id")
    chunks = stored(hashed_vectors(pieces.select(F.col("paper_id").alias("doc_id"), F.concat_ws("-", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("chunk_id").cast("string"), 6, "0")).alias("chunk_id"), "chunk"), "chunk"), "chunks")
    questions = table(spark, sf_dir, "architecture_results", "question_id", "paper_id", "question").groupBy("question_id", "paper_id").agg(F.min("question").alias("question"))
    asked = stored(hashed_vectors(questions.select("question_id", F.col("paper_id").alias("doc_id"), "question"), "question"), "asked")
    found = retrieved(asked, chunks, 8).withColumn("key", F.to_json(F.struct("question_id", "doc_id")))
    texts = context(found, "key", 2000).select("key", F.sha2("text", 256).alias("digest"), "n_chunks")
    keyed = asked.select("question_id", F.col("doc_id").alias("paper_id"), F.to_json(F.struct("question_id", "doc_id")).alias("key"))
    return keyed.join(texts, "key", "left").select("question_id", "paper_id", "digest", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


QUERIES = {"nearest_vectors": nearest_vectors, "label_recall": label_recall, "document_chunks": document_chunks, "question_contexts": question_contexts}

_NEAREST = """(SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, q.label AS asked, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, c.vec_id) AS INT) AS rank
    FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10)"""

SQL = {
    "nearest_vectors": f"SELECT query_id, id, rank, round(s + 1e-9, 6) AS score FROM {_NEAREST}",
    "label_recall": f"""WITH e AS (SELECT query_id, asked, avg(CASE WHEN asked = label THEN 1.0 ELSE 0.0 END) FILTER (rank <= 5) AS at_5, avg(CASE WHEN asked = label THEN 1.0 ELSE 0.0 END) AS at_10 FROM {_NEAREST} GROUP BY ALL)
        SELECT asked AS label, count(*) AS n_queries, round(avg(at_5) + 1e-9, 6) AS at_5, round(avg(at_10) + 1e-9, 6) AS at_10 FROM e GROUP BY asked""",
}
