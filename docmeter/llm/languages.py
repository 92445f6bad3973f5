"""The language of short texts, by two witnesses: frequent function words, and naive Bayes over hashed character n-grams and
words, fitted to documents whose language is stated. Quotations and names (words with a capital) do not count; a text in Han
or Cyrillic letters is told by them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmeter.llm.abuse import AT_A_TIME, features
from docmeter.llm.rules import FUNCTION_WORDS, OWN_LETTERS

#: About so many documents of each stated language are what the model is fitted to, drawn by hash among those no longer than
#: so many characters (all documents of a language that has fewer), and the least number that a language must have.
SAMPLE, SHORT, LEAST = 800, 5_000, 5
BITS = 16
#: Texts whose language a task remembers; bounds memory only.
KEPT = 50_000
#: How much more likely (in logarithms) than the next the best language of the model must be to count where the function
#: words tell nothing, and to count against them.
FILLS, OVERRULES = 6.0, 30.0
#: Words without a capital that the model needs.
WORDS = 3
#: The part of a language's own shares in the mixture with those of all.
OWN = 0.8

_QUOTED = re.compile(r'"[^"]*"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」')
_LOWER = re.compile(r"(?<![\w-])[^\W\d_A-ZÀ-ÖØ-Þ][^\W\d_]*(?![\w-])")


_OTHER_SCRIPT = re.compile("[一-鿿Ѐ-ӿ]")
_SMALL_LATIN = re.compile(r"(?<![A-Za-zÀ-ÿ])[a-zß-ÿ][A-Za-zÀ-ÿ]*")


def script_of(text: str) -> str | None:
    """zh or ru if the letters of a text, those of Latin names apart, are Han or Cyrillic ones for the most part."""
    if not _OTHER_SCRIPT.search(text):
        return None
    han, cyrillic = sum("一" <= c <= "鿿" for c in text), sum("Ѐ" <= c <= "ӿ" for c in text)
    if han < 2 and cyrillic < 4:
        return None
    latin = sum(map(len, _SMALL_LATIN.findall(text)))
    return "zh" if han >= 2 and han * 2 >= latin else "ru" if cyrillic >= 4 and cyrillic >= latin else None


def plain(text: str) -> str:
    """The words without a capital, in a row."""
    return " ".join(_LOWER.findall(text))


def _weights() -> dict[str, dict[str, float]]:
    """Weight of each function word by language: one that several languages share counts for each in part."""
    owners: dict[str, list[str]] = {}
    for language, known in FUNCTION_WORDS.items():
        for word in set(known):
            owners.setdefault(word, []).append(language)
    return {word: {x: 1 / len(found) for x in found} for word, found in owners.items()}


_WEIGHTS = _weights()
_WORD = re.compile(r"[^\W\d_]+")


_OWN = re.compile(f"[{''.join(OWN_LETTERS.values())}]")


def by_function_words(text: str) -> str | None:
    """The language whose function words and letters a text has most of, None if too few or another has nearly as many."""
    score: dict[str, float] = {}
    words = _WORD.findall(text)
    for word in map(str.lower, words):
        if word in _WEIGHTS:
            for language, weight in _WEIGHTS[word].items():
                score[language] = score.get(language, 0) + weight
    if _OWN.search(text):
        for word in words:
            if word[0].islower() and _OWN.search(word):
                for language, own in OWN_LETTERS.items():
                    if any(c in own for c in word):
                        score[language] = score.get(language, 0) + 0.5
    best = sorted(score.items(), key=lambda x: -x[1])[:2]
    if not best or best[0][1] < 1 or (len(best) > 1 and best[0][1] < 1.3 * best[1][1]):
        return None
    return best[0][0]


def no_model() -> "LanguageModel":
    """Function words and scripts alone."""
    return LanguageModel([], np.zeros((0, 1 << BITS), np.float32))


@dataclass
class LanguageModel:
    """languages, and the log probability of each bucket (columns) in each of them (rows)."""

    languages: list[str]
    log_p: np.ndarray

    def of(self, texts: list[str | None]) -> list[str | None]:
        """The language of each text, None if too little of it tells."""
        bare = [_QUOTED.sub(" ", t) if t else "" for t in texts]
        script = [script_of(t) for t in bare]
        out = [x or by_function_words(t) for t, x in zip(bare, script)]
        words = [plain(t) if x is None else "" for t, x in zip(bare, script)]
        ask = [i for i, w in enumerate(words) if w.count(" ") >= WORDS - 1]
        if len(self.languages) < 2:
            return out
        for low in range(0, len(ask), AT_A_TIME):
            some = ask[low : low + AT_A_TIME]
            buckets, begins = features([words[i] for i in some], BITS)
            scores = np.add.reduceat(self.log_p[:, buckets], begins[:-1], axis=1)  # each has words, so buckets
            order = np.argsort(scores, axis=0)
            columns = np.arange(len(some))
            clear = scores[order[-1], columns] - scores[order[-2], columns]
            for i, best, by in zip(some, order[-1], clear):
                if by >= (FILLS if out[i] is None else OVERRULES):
                    out[i] = self.languages[best]
        return out


def learn(texts: list[str], languages: list[str]) -> LanguageModel:
    """A model of texts whose languages are stated. Texts in Han or Cyrillic letters, and languages of fewer than LEAST
    others, are left out.

    A bucket has its share of the language's own n-grams, mixed with its mean share in all languages: what a language lacks
    says little if all lack it, however few texts the language has."""
    kept = [(t, x) for t, x in zip((_QUOTED.sub(" ", t) for t in texts), languages) if script_of(t) is None]
    counts = pd.Series([x for _, x in kept], dtype=object).value_counts()
    known = sorted(counts[counts >= LEAST].index)
    shares = np.zeros((len(known), 1 << BITS))
    for row, language in zip(shares, known):
        buckets, _ = features([plain(t) for t, x in kept if x == language], BITS)
        row += np.bincount(buckets, minlength=1 << BITS) / max(1, len(buckets))
    mixed = OWN * shares + (1 - OWN) * shares.mean(axis=0, keepdims=True) if known else shares
    return LanguageModel(known, np.log(mixed + 1e-7).astype(np.float32))


def fit(documents: DataFrame, each: int = SAMPLE) -> LanguageModel:
    """A model of about `each` documents (doc_id, text, lang) of every language, so that frequent languages do not know more
    words than others; null, blank and undetermined languages are left out."""
    stated = documents.select("doc_id", "text", F.lower(F.trim("lang")).alias("lang")).where(F.col("lang").rlike("^[a-z]{2}$"))
    sizes = stated.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    drawn = stated.join(F.broadcast(sizes), "lang").where(place < each / F.col("n"))  # two letters: 676 rows at most
    rows = drawn.where((F.length("text") > 0) & (F.length("text") <= SHORT)).orderBy("doc_id").select("text", "lang").toPandas()
    return learn(rows["text"].tolist(), rows["lang"].tolist())


def language(model: LanguageModel, text: Column) -> Column:
    """The language of a text column; a task tells each text once, as long as it has no more than KEPT at hand."""

    @F.pandas_udf(T.StringType())
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str | None] = {}
        for texts in batches:
            if len(known) > KEPT:
                known.clear()
            new = [t for t in texts.dropna().unique() if t not in known]
            known.update(zip(new, model.of(new)))
            yield pd.Series([known.get(t) for t in texts], dtype=object)

    return told(text)
