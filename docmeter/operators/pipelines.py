"""Calls over documents: the interface of a provider, the operator that calls it, and the contexts it is given.

Model calls sit behind a small interface. The one implementation here is deterministic and offline; an online one needs only
the same call() and an entry in PROVIDERS. Calls run inside mapInPandas, one provider per task, and every call yields its row
for the ledger.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docmeter.operators.retrieval import chunked, context, hashed_vectors, retrieved

CALL = "answer string, input_tokens bigint, output_tokens bigint, wallclock_s double, failed boolean, failure_reason string"


@dataclass
class Reply:
    text: str
    input_tokens: int
    output_tokens: int


class Provider(Protocol):
    def call(self, prompt: str, max_tokens: int) -> Reply: ...


class Extractive:
    """Answers with the sentence of the context that shares most words with the question; cut at max_tokens words."""

    def call(self, prompt: str, max_tokens: int) -> Reply:
        text, _, question = prompt.rpartition("\n\nQuestion: ")
        asked = set(re.findall(r"\w+", question.lower()))
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
        best = max(sentences, key=lambda s: (len(asked & set(re.findall(r"\w+", s.lower()))), -len(s)), default="Unanswerable")
        words = best.split()[:max_tokens]
        return Reply(" ".join(words), max(1, len(prompt) // 4), len(words))


PROVIDERS: dict[str, Callable[[], Provider]] = {"extractive": Extractive}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"no such provider: {name}")
    return PROVIDERS[name]()


def called(prompts: DataFrame, name: str, max_tokens: int = 256) -> DataFrame:
    """prompts with the columns of CALL: the reply to the column prompt, its tokens and time. A null prompt fails, and a call
    that raises gives a failed row with the reason instead of a failed job."""
    provider(name)
    columns = [c for c in prompts.columns if c != "prompt"]
    schema = ", ".join(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in columns) + f", {CALL}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answerer = provider(name)
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                start = time.perf_counter()
                try:
                    if prompt is None:
                        raise ValueError("no prompt")
                    reply = answerer.call(prompt, max_tokens)
                    rows.append((reply.text, reply.input_tokens, reply.output_tokens, time.perf_counter() - start, False, None))
                except Exception as error:  # the row says so
                    rows.append((None, 0, 0, time.perf_counter() - start, True, f"{type(error).__name__}: {error}"[:200]))
            out = batch[columns].reset_index(drop=True)
            out[["answer", "input_tokens", "output_tokens", "wallclock_s", "failed", "failure_reason"]] = rows
            yield out

    return prompts.mapInPandas(run, schema)


def ledger_rows(calls: DataFrame, architecture: str, stage: str, model: str) -> DataFrame:
    """The rows that calls add to the ledger."""
    return calls.select(
        "paper_id", F.lit(architecture).alias("architecture"), F.lit(stage).alias("stage"), F.lit(model).alias("model"), F.col("input_tokens").alias("uncached_input_tokens"),
        F.lit(0).cast("bigint").alias("cached_input_tokens"), "output_tokens", "wallclock_s", "failed", "failure_reason",
    )


def _prompt(text, question):
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n\nQuestion: "), question)


def flat(questions: DataFrame, documents: DataFrame, name: str = "extractive") -> DataFrame:
    """Each question (question_id, paper_id, question) over the whole document (paper_id, text) of its paper."""
    rows = questions.select("question_id", "paper_id", "question").join(documents.select("paper_id", "text"), "paper_id", "left")
    return called(rows.select("question_id", "paper_id", _prompt(F.col("text"), F.col("question")).alias("prompt")), name)


def closed_book(questions: DataFrame, name: str = "extractive") -> DataFrame:
    """The same questions without any document."""
    return called(questions.select("question_id", "paper_id", _prompt(F.lit(""), F.col("question")).alias("prompt")), name)


def _asked(questions: DataFrame) -> DataFrame:
    return hashed_vectors(questions.select("question_id", F.col("paper_id").alias("doc_id"), "question"), "question")


def _answered(questions: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    rows = questions.select("question_id", "paper_id", "question").join(texts, "question_id", "left")
    return called(rows.select("question_id", "paper_id", _prompt(F.col("text"), F.col("question")).alias("prompt")), name)


def naive(questions: DataFrame, documents: DataFrame, k: int = 8, size: int = 384, name: str = "extractive") -> DataFrame:
    """Chunks of the paper's document, the k most like the question in order of likeness, then the answer."""
    chunks = hashed_vectors(chunked(documents, "paper_id", "text", size).withColumnRenamed("paper_id", "doc_id"), "chunk")
    return _answered(questions, context(retrieved(_asked(questions), chunks, k), "question_id", 1 << 30), name)


ARCHITECTURES = {"flat": flat, "naive_rag": naive}


def run_architecture(name: str, questions: DataFrame, documents: DataFrame) -> DataFrame:
    """The answers of one architecture; an unknown name is an error."""
    if name not in ARCHITECTURES:
        raise ValueError(f"no such architecture: {name}")
    return ARCHITECTURES[name](questions, documents)
