"""Columns over nested records: papers, questions, options, model outputs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Control tags that a broken model output shows.
CONTROL_TAGS = ["<thinking>", "</thinking>", "<reasoning>", "</reasoning>", "<scratchpad>"]

# How an option begins, or what it holds, that says that something is not there.
ABSENT_BEGINNING, ABSENT = "no", ["never", "does not appear"]


def filled(text: Column) -> Column:
    """Whether a text is neither null nor blank."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


def linear_document(title: Column, abstract: Column, full_text: Column) -> Column:
    """Title, abstract, section names and paragraphs of a nested paper, joined by blank lines; empty parts are left out."""
    sections = F.flatten(F.transform(F.coalesce(full_text, F.array()), lambda s: F.concat(F.array(s["section_name"]), F.coalesce(s["paragraphs"], F.array()))))
    return F.array_join(F.filter(F.concat(F.array(title, abstract), sections), filled), "\n\n")


def gold_answer(answer: Column) -> Column:
    """The text of one annotator's answer: free form, else spans, else Yes or No, else empty if unanswerable, else null."""
    spans = F.array_join(F.filter(F.coalesce(answer["extractive_spans"], F.array()), filled), " ")
    return (
        F.when(filled(answer["free_form_answer"]), F.trim(answer["free_form_answer"])).when(spans != "", spans)
        .when(answer["yes_no"].isNotNull(), F.when(answer["yes_no"], "Yes").otherwise("No")).when(answer["unanswerable"], "")
    )


def gold_answers(answers: Column) -> Column:
    """The texts of all annotators that gave one; repeated texts stay."""
    return F.filter(F.transform(F.coalesce(answers, F.array()), lambda a: gold_answer(a["answer"])), lambda t: t.isNotNull())


def answer_type(answer: Column) -> Column:
    """unanswerable, yes_no, extractive, abstractive or other, the first that fits."""
    return (
        F.when(F.coalesce(answer["unanswerable"], F.lit(False)), "unanswerable").when(answer["yes_no"].isNotNull(), "yes_no")
        .when(F.size(F.filter(F.coalesce(answer["extractive_spans"], F.array()), filled)) > 0, "extractive").when(filled(answer["free_form_answer"]), "abstractive").otherwise("other")
    )


def gold_evidence(answers: Column) -> Column:
    """Highlighted evidence of each annotator, else their paragraphs, in order, each sentence once."""
    one = lambda a: F.when(F.size(F.coalesce(a["answer"]["highlighted_evidence"], F.array())) > 0, a["answer"]["highlighted_evidence"]).otherwise(F.coalesce(a["answer"]["evidence"], F.array()))
    return F.array_distinct(F.filter(F.flatten(F.transform(F.coalesce(answers, F.array()), one)), filled))


def has_evidence(answers: Column) -> Column:
    return F.size(gold_evidence(answers)) > 0


def rendered_options(options: Column) -> Column:
    """A map of letters to texts as lines "A. text" in the order of letters."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def absent_letters(options: Column) -> Column:
    """Letters of options that say that something is not there."""
    low = lambda v: F.lower(F.trim(v))
    return F.array_sort(F.map_keys(F.map_filter(options, lambda k, v: low(v).startswith(ABSENT_BEGINNING) | F.exists(F.array(*[F.lit(x) for x in ABSENT]), lambda x: F.contains(low(v), x)))))


def options_literal(text: Column) -> Column:
    """Options that came as text, in JSON or with single quotation marks; an empty map if they cannot be read."""
    kind = "map<string,string>"
    double = F.regexp_replace(text, r"(?<=[{,:])\s*'|'\s*(?=[,:}])", '"')
    return F.coalesce(F.from_json(text, kind), F.from_json(double, kind), F.create_map().cast(kind))


def malformed(output: Column) -> Column:
    """Why a model output is broken: no text, or the first control tag that it shows; null if it is not."""
    tags = F.filter(F.array(*[F.lit(t) for t in CONTROL_TAGS]), lambda t: F.contains(F.lower(output), t))
    return F.when(~filled(output), "empty_response").when(F.size(tags) > 0, F.concat(F.lit("leaked_control_tag:"), F.get(tags, F.lit(0))))


def json_block(output: Column, schema: str) -> Column:
    """The object that an output is, or else the longest block in braces (nested twice at most) that can be read; null if
    there is none."""
    inner = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
    blocks = F.reverse(F.array_sort(F.transform(F.regexp_extract_all(output, F.lit(f"({inner})"), F.lit(1)), lambda b: F.struct(F.length(b).alias("n"), b.alias("b")))))
    read = F.filter(F.transform(blocks, lambda x: F.from_json(x["b"], schema)), lambda x: x.isNotNull())
    return F.coalesce(F.when(F.trim(output).startswith("{"), F.from_json(F.trim(output), schema)), F.get(read, F.lit(0)))


def clamped_strength(*values: Column) -> Column:
    """The first value that is there as a whole number from 1 to 10 (halves go to even); null if it is no number."""
    number = F.rint(F.coalesce(*values).try_cast("double")).cast("int")
    return F.when(number.isNotNull(), F.least(F.lit(10), F.greatest(F.lit(1), number)))


def evidence_parts(text: Column) -> Column:
    """The paragraphs of a text, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.trim(p)), lambda p: p != "")


def config_key(inputs: Column, length: int = 16) -> Column:
    """A digest of a map of settings that does not depend on the order of its keys."""
    lines = F.transform(F.array_sort(F.map_entries(inputs)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.substring(F.sha2(F.array_join(lines, "\x1f"), 256), 1, length)


def shortened(text: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis if some are cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)
