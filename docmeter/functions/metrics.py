"""Answer metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docmeter.functions.text import normalize_text, tokens


def token_f1(prediction: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall over the bags of tokens of two token arrays; 1 if both are empty, 0 if one is."""
    common = F.aggregate(
        F.array_distinct(prediction),
        F.lit(0),
        lambda n, w: n + F.least(F.size(F.filter(prediction, lambda x: x == w)), F.size(F.filter(gold, lambda x: x == w))),
    )
    both = F.size(prediction) + F.size(gold)
    return F.when(both == 0, 1.0).otherwise(2.0 * common / both)


def best_f1(prediction: Column, references: Column) -> Column:
    """The best token F1 of a token array against an array of them; none give 0. Both should be columns of a projection of
    their own (tokens() and reference_tokens()), as every word of one meets the other."""
    return F.coalesce(F.array_max(F.transform(references, lambda r: token_f1(prediction, r))), F.lit(0.0))


def reference_tokens(references: Column) -> Column:
    """The token arrays of an array of texts without its nulls."""
    return F.transform(F.filter(references, lambda r: r.isNotNull()), tokens)


def evidence_f1(retrieved: Column, gold: Column) -> Column:
    """F1 over the sets of normalised, non-empty sentences; 0 if both are empty."""
    sets = [F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), normalize_text), lambda s: s != "")) for a in (retrieved, gold)]
    both = F.size(sets[0]) + F.size(sets[1])
    return F.when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(*sets)) / both)


def evidence_hit(evidence: Column, chunk: Column) -> Column:
    """Whether a sentence lies in a chunk (both normalised), or has six distinct tokens or more of which 85 % do."""
    words = F.array_distinct(tokens(evidence))
    share = F.size(F.array_intersect(words, tokens(chunk))) / F.size(words)
    return F.contains(normalize_text(chunk), normalize_text(evidence)) | ((F.size(words) >= 6) & (share >= 0.85))


def accuracy(prediction: Column, gold: Column) -> Column:
    """1 if the labels agree, case and outer spaces aside, else 0; a null label is wrong."""
    return F.coalesce((F.upper(F.trim(prediction)) == F.upper(F.trim(gold))).cast("double"), F.lit(0.0))


def rounded(value: Column | str, digits: int = 6) -> Column:
    """value at so many digits. A billionth is added first, so that halves of the last digit, which sums of floats miss by
    their order of addition, go the same way everywhere."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-9, digits)
