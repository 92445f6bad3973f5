"""Declared schemas; readers never infer."""

from __future__ import annotations

LEDGER = (
    "call_id BIGINT, paper_id STRING, timestamp STRING, architecture STRING, stage STRING, model STRING, run_index INT, uncached_input_tokens BIGINT, cached_input_tokens BIGINT, "
    "output_tokens BIGINT, wallclock_s DOUBLE, gpu_s_estimate DOUBLE, provider_request_id STRING, prompt_hash STRING, response_hash STRING, seed BIGINT, temperature DOUBLE, "
    "top_p DOUBLE, max_tokens INT, provider_region STRING, failed BOOLEAN, failure_reason STRING, received_at TIMESTAMP"
)
PREDICTIONS = (
    "arch STRING, dataset STRING, paper_id STRING, question_id STRING, run_index INT, question STRING, predicted_answer STRING, retrieved_chunks_count INT, answer_f1 DOUBLE, "
    "evidence_f1 DOUBLE, accuracy DOUBLE, predicted_letter STRING, build_failed BOOLEAN, failure_reason STRING"
)
PAPERS = (
    "paper_id STRING, title STRING, abstract STRING, full_text ARRAY<STRUCT<section_name: STRING, paragraphs: ARRAY<STRING>>>, "
    "qas ARRAY<STRUCT<question_id: STRING, question: STRING, answers: ARRAY<STRUCT<answer: STRUCT<free_form_answer: STRING, extractive_spans: ARRAY<STRING>, yes_no: BOOLEAN, "
    "unanswerable: BOOLEAN, evidence: ARRAY<STRING>, highlighted_evidence: ARRAY<STRING>>>>>>"
)
NOVEL_QUESTIONS = "novel_id STRING, question_id STRING, Question STRING, Options MAP<STRING, STRING>, Aspect STRING, Complexity STRING"
