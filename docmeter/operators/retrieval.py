"""Chunks, embeddings and retrieval."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docmeter.functions.text import approx_tokens
from docmeter.functions.vectors import dot, unit

# Places to cut a text, the best first.
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", ""]


def split_text(text: str, size: int, overlap: int = 0) -> list[tuple[int, str]]:
    """(index, chunk) of a text: pieces between the best separators that are no longer than size (in tokens of four
    characters), merged from the left while they fit, with an overlap of whole pieces. Blank chunks are left out, but keep
    their index."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap from 0 to below size")
    if not text or not text.strip():
        return []
    limit, keep = size * 4, overlap * 4

    def pieces(part: str, level: int) -> list[str]:
        if len(part) <= limit:
            return [part]
        mark = SEPARATORS[level]
        if not mark:
            return [part[i : i + limit] for i in range(0, len(part), limit)]
        split = part.split(mark)
        marked = [p + mark for p in split[:-1]] + ([split[-1]] if split[-1] else [])
        return [x for p in marked for x in pieces(p, level + 1)]

    chunks: list[str] = []
    window: list[str] = []
    length = 0
    for piece in pieces(text, 0):
        if window and length + len(piece) > limit:
            chunks.append("".join(window))
            while window and (length > keep or length + len(piece) > limit):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    if window:
        chunks.append("".join(window))
    return [(i, c) for i, c in enumerate(chunks) if c.strip()]


def chunked(documents: DataFrame, key: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """key, chunk_id and chunk of every document; null and blank texts have no chunks."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch["key"], batch["text"]) for i, c in split_text(t or "", size, overlap)]
            yield pd.DataFrame(rows, columns=["key", "chunk_id", "chunk"])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    return rows.mapInPandas(run, f"key {kind}, chunk_id int, chunk string").withColumnRenamed("key", key)


def hashed_vectors(texts: DataFrame, text: str, name: str = "vector", dimension: int = 64) -> DataFrame:
    """texts with a vector of unit length: words fall into signed buckets by their hash, so that the cosine of two vectors is
    about that of their bags of words; a text without words has the zero vector."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vector(values: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for value in values:
            hashes = np.array([known.setdefault(w, zlib.crc32(w.encode())) for w in re.findall(r"[^\W_]+", (value or "").lower())], np.int64)
            v = np.bincount(hashes % dimension, np.where(hashes >> 31 & 1, -1.0, 1.0), dimension) if len(hashes) else np.zeros(dimension)
            out.append(v / (np.linalg.norm(v) or 1.0))
        return pd.Series(out)

    return texts.withColumn(name, vector(F.col(text)))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, within: str | None = None, queries_at_once: int = 2_000, vectors_at_once: int = 50_000) -> DataFrame:
    """query_id, id, score and rank of the k vectors of corpus (id, vector) most like each query (query_id, vector); with
    within, a column of both, those of the query's own group, and none for a null one.

    Exact: the stated queries meet all vectors, in blocks of both; the numbers of blocks follow the numbers of rows of the
    group, so that a task holds one block of each and a hot group is many tasks. A block keeps its own k best per query
    before they are merged, so what is shuffled last is k rows per query and block. Vectors are arrays of doubles; ties go
    to the smaller id.
    """
    group = F.lit("") if within is None else F.col(within)
    asked = queries.select("query_id", unit(F.col("vector")).alias("q"), group.alias("group")).where(F.col("group").isNotNull())
    held = corpus.select("id", unit(F.col("vector")).alias("v"), group.alias("group")).where(F.col("group").isNotNull())

    def counted(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / most).alias(name))

    sizes = counted(asked, queries_at_once, "rows").join(counted(held, vectors_at_once, "columns"), "group")
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = asked.join(sizes, "group").select("group", "query_id", "q", F.pmod(F.xxhash64("query_id"), F.col("rows")).alias("row"), blocks("columns").alias("column"))
    right = held.join(sizes, "group").select("group", "id", "v", F.pmod(F.xxhash64("id"), F.col("columns")).alias("column"), blocks("rows").alias("row"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": left["query_id"][:0], "id": right["id"][:0], "score": np.zeros(0)})]
        if len(left) and len(right):
            ids, vectors, names = np.array(right["id"].tolist()), np.stack(right["v"].to_numpy()), left["query_id"].to_numpy()
            for start in range(0, len(left), 64):
                scores = np.round(np.stack(left["q"].to_numpy()[start : start + 64]) @ vectors.T, 9)
                for score, name in zip(scores, names[start : start + 64]):
                    near = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
                    top = near[np.lexsort((ids[near], -score[near]))[:k]]
                    out.append(pd.DataFrame({"query_id": name, "id": ids[top], "score": score[top]}))
        return pd.concat(out)

    kinds = queries.schema["query_id"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()
    keys = ["group", "row", "column"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def packed(ranked: DataFrame, by: str, order: str, cost: Column, budget: int) -> DataFrame:
    """The rows of each group, in order, up to the first that no longer fits the budget (cost is at least 1)."""
    spent = F.sum(cost).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("spent", spent).where(F.col("spent") <= budget)


def retrieved(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """question_id, doc_id, chunk_id, chunk, score and rank of the k chunks of the question's own document most like it;
    questions has question_id, doc_id and vector, chunks has doc_id, chunk_id, chunk and vector. A question is one of a
    document: question_id and doc_id together name it."""
    asked = questions.select(F.struct("question_id", "doc_id").alias("query"), "doc_id", "vector")
    named = asked.select(F.to_json("query").alias("query_id"), "query", "doc_id", "vector")
    top = nearest(named, chunks.select(F.col("chunk_id").alias("id"), "doc_id", "vector"), k, "doc_id")
    found = top.join(named.select("query_id", "query"), "query_id").select("query.question_id", "query.doc_id", F.col("id").alias("chunk_id"), "score", "rank")
    return found.join(chunks.select("doc_id", "chunk_id", "chunk"), ["doc_id", "chunk_id"]).select("question_id", "doc_id", "chunk_id", "chunk", "score", "rank")


def context(rows: DataFrame, by: str, budget: int) -> DataFrame:
    """by, text and n_chunks: the chunks of each group in the order of rank, as many as fit the budget of tokens."""
    fits = packed(rows, by, "rank", approx_tokens(F.col("chunk")), budget)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk")))
    return fits.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["chunk"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("n_chunks"))
