"""Problem 8: abusive, hateful and sexually explicit texts.

A sentence is the mean of the embeddings of its subwords (character n-grams of its words, the words, and pairs of words),
followed by a linear softmax; both are trained together in numpy, so that misspellings never seen share n-gram vectors with
words that were. A document is as abusive as its worst sentence: reviewers label documents, so in training the worst
sentences of a document with the label 1 carry it, and every sentence of a document with the label 0 is sound.

As the mean and the scores are linear, a trained model is one number per bucket of subwords. That array (4 bytes times
2^BITS, whatever the corpus) goes to the tasks, which score all sentences of all documents. The threshold comes from
labelled documents that were held out: each part of them is scored by a model of the other parts. The models are trained in
tasks of their own, at the same time; only they and the held-out scores come back.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docmeter.session import stored, table

BITS = 18
DIMENSION = 12
GRAMS = (3, 4, 5)
#: Labelled documents, and characters of them, used at most for training, drawn by hash; all documents are scored.
LABELLED, CHARACTERS = 10_000, 20_000_000
EPOCHS, ROUNDS, BATCH, RATE = 4, 3, 256, 0.15
#: Sentences of more words than LONG are read in stretches of STRETCH words, half of which overlap.
LONG, STRETCH = 18, 14
#: A document labelled 1 weighs so many times a sound sentence.
POSITIVE = 3.0
#: Empty subwords (zero vectors) that every sentence has besides its own: a fragment of a word or two says little.
PAD = 24
#: Parts of the labelled documents, each scored by a model of the others, from which the threshold is chosen.
FOLDS = 3
SEED = 20_260_616
#: Sentences whose subwords are worked out together; bounds memory only.
AT_A_TIME = 2_000

# Letters of other scripts and digits that stand for Latin letters inside a word.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝɡαοѵ", "aeopcyxijshdqwgaov")
LEET = str.maketrans("013457@$", "oieastas")

_SENTENCE = re.compile(r"""(?<=[.!?。！？…])["”»'’)\]]*\s+|(?<=[。！？])|\n+""")
_HIDDEN = re.compile("[​‌‍⁠﻿­̀-ͯ]")
_LETTERS = re.compile(r"[^\W_]+(?:['’*@$]+[^\W_]+)*[*@$]*", re.UNICODE)
_LATIN = re.compile(r"[a-z]")
_CYRILLIC = re.compile(r"[Ѐ-ӿͰ-Ͽ]")
_SPACED = re.compile(r"\b(?:\w[ .\-_*]){3,}\w\b")
_REPEAT = re.compile(r"(.)\1{2,}")


def plain(sentence: str) -> str:
    """Lower case with hidden characters, accents, look-alike letters and stretched or spaced-out spellings undone, digits
    inside words read as letters, other digits as 0, and one space between words."""
    text = _HIDDEN.sub("", unicodedata.normalize("NFKD", sentence.lower()))
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), text)
    out = []
    for word in _LETTERS.findall(text):
        if _LATIN.search(word):
            if _CYRILLIC.search(word):
                word = word.translate(LOOKALIKES)
            if not word.isalpha():
                word = re.sub(r"\d", "0", word) if word[0].isdigit() or word[-1].isdigit() else word.translate(LEET)
            word = _REPEAT.sub(r"\1\1", word)
        elif word.isdigit():
            word = "0"
        out.append(word)
    return " ".join(out)


def sentences(text: str | None) -> list[str]:
    """The sentences of a text in plain form; blank ones are left out. A long one, which may be several without a mark
    between them, comes as overlapping stretches of words. All of the text is used, however long it is."""
    out: list[str] = []
    for piece in _SENTENCE.split(text) if text else ():
        words = plain(piece).split()
        if len(words) <= LONG:
            if words:
                out.append(" ".join(words))
        else:
            out += [" ".join(words[i : i + STRETCH]) for i in range(0, len(words) - STRETCH // 2, STRETCH // 2)]
    return out


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all texts in a row, and where each text's begin (one more entry than texts).

    The characters of all texts lie in one array, with a space before and after each text; n-grams that contain a space
    inside are left out, those with one at an end mark the beginning or the end of a word.
    """
    joined = " " + "  ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 2)])
    space = codes == 32
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    where, hashes = [], []
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n), np.uint64)
        for i in range(n):
            h = (h ^ mixed[i : i + m]) * np.uint64(0x100000001B3)
        inside = np.zeros(m, bool)
        for i in range(1, n - 1):
            inside |= space[i : i + m]
        inside |= space[:m] & space[n - 1 : n - 1 + m]
        at = np.flatnonzero(~inside)
        where.append(at)
        hashes.append(h[at])
    # words: a sum of the characters' codes, each multiplied by a power that depends on its place in the word
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(starts):
        index = np.cumsum(np.isin(np.arange(len(codes)), starts, assume_unique=True)) - 1
        letters = np.flatnonzero(~space)
        place = (letters - starts[index[letters]]).astype(np.uint64)
        spread = mixed[letters] * (place * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F))
        words = np.add.reduceat(spread, np.searchsorted(letters, starts))
        where.append(starts)
        hashes.append(words * np.uint64(0xE7037ED1A0B428DB))
        text_of = np.searchsorted(begins, starts, "right")
        follows = np.flatnonzero(text_of[:-1] == text_of[1:])
        where.append(starts[follows])
        hashes.append(words[follows] * np.uint64(0x8EBC6AF09C88C6E3) ^ (words[follows + 1] * np.uint64(0x589965CC75374CC3)))
    if not where:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    at, hash_ = np.concatenate(where), np.concatenate(hashes)
    hash_ ^= hash_ >> np.uint64(31)
    buckets = ((hash_ * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return buckets[order], np.searchsorted(at[order], begins)


def features_of_many(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """features(), some texts at a time, so that the arrays beside the result stay small."""
    parts = [features(texts[i : i + AT_A_TIME], bits) for i in range(0, len(texts), AT_A_TIME)] or [features([], bits)]
    offsets = np.cumsum([0, *(len(b) for b, _ in parts)])
    begins = [at[:-1] + o for (_, at), o in zip(parts, offsets)]
    return np.concatenate([b.astype(np.int32) for b, _ in parts]), np.concatenate([*begins, offsets[-1:]])


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive begins; empty stretches give 0."""
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[begins[1:]] - total[begins[:-1]]


@dataclass
class Model:
    """weights: a number per bucket; bias and threshold. The score of a sentence is the logistic function of the mean
    weight of its subwords and PAD empty ones, plus bias."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.5

    def of_buckets(self, buckets: np.ndarray, begins: np.ndarray) -> np.ndarray:
        mean = _sums(self.weights[buckets], begins) / (PAD + np.diff(begins))
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        parts = [self.of_buckets(*features(texts[i : i + AT_A_TIME])) for i in range(0, len(texts), AT_A_TIME)]
        return np.concatenate(parts) if parts else np.zeros(0)


class _Trainer:
    """Embeddings of buckets and a linear softmax over their mean, trained together by stochastic gradient descent with
    step sizes that shrink by what each bucket has seen (Adagrad)."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (1 << BITS, DIMENSION)).astype(np.float32)
        self.output, self.bias = rng.normal(0, 0.1, (DIMENSION, 2)), np.zeros(2)
        self.seen, self.seen_output, self.seen_bias = np.full(1 << BITS, 1e-6, np.float32), np.full((DIMENSION, 2), 1e-6), np.full(2, 1e-6)

    def epoch(self, buckets: np.ndarray, begins: np.ndarray, targets: np.ndarray, weights: np.ndarray, rate: float) -> None:
        """One pass over the samples; buckets of sample i lie from begins[i] to begins[i + 1]."""
        lengths = np.diff(begins)
        for chunk in np.array_split(self.rng.permutation(len(targets)), max(1, len(targets) // BATCH)):
            n = lengths[chunk]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(begins[chunk] - (ends - n), n)
            own = buckets[at]
            owner = np.repeat(np.arange(len(chunk)), n)
            mean = np.add.reduceat(self.vectors[own], ends - n, axis=0) / (PAD + n)[:, None]
            logits = mean @ self.output + self.bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = e / e.sum(axis=1, keepdims=True)
            error[np.arange(len(chunk)), targets[chunk]] -= 1
            error *= weights[chunk, None]
            back = ((error @ self.output.T) / (PAD + n)[:, None]).astype(np.float32)
            step = mean.T @ error
            self.seen_output += step**2
            self.output -= rate * step / np.sqrt(self.seen_output)
            step = error.sum(axis=0)
            self.seen_bias += step**2
            self.bias -= rate * step / np.sqrt(self.seen_bias)
            order = np.argsort(own, kind="stable")
            sorted_ = own[order]
            firsts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            gradient = np.add.reduceat(back[owner[order]], firsts, axis=0)
            touched = sorted_[firsts]
            self.seen[touched] += (gradient**2).mean(axis=1)
            self.vectors[touched] -= rate * gradient / np.sqrt(self.seen[touched])[:, None]

    def model(self) -> "Model":
        return Model((self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


def learn(documents: list[list[str]], labels: list[int], seed: int = SEED) -> Model:
    """A model of labelled documents (1: abusive), given by their sentences. In each round the sentences of the documents
    labelled 1 are weighed by how much of their document's score they carry under the model of the round before; at first
    all of them are, the less the more sentences there are."""
    rng = np.random.default_rng(seed)
    counted = Counter(s for d, y in zip(documents, labels) if y == 0 for s in d)
    sound, times = list(counted), np.array(list(counted.values()), float)
    positive = [(i, s) for i, (d, y) in enumerate(zip(documents, labels)) if y == 1 for s in d]
    owners = np.array([i for i, _ in positive], np.int64)
    bad = [s for _, s in positive]
    if not bad or not len(sound):
        return Model(np.zeros(1 << BITS, np.float32), -20.0 if not bad else 0.0)
    counts = np.bincount(owners, minlength=len(documents))
    share = 1.0 / counts[owners]
    samples = sound + bad
    buckets, begins = features_of_many(samples)
    targets = np.concatenate([np.zeros(len(sound), int), np.ones(len(bad), int)])
    for _ in range(ROUNDS):
        # a sound sentence weighs as much as it occurs, so that sentences of sound documents stay sound where a document
        # with a wrong label repeats them
        weights = np.concatenate([times, share * (POSITIVE * len(set(owners.tolist())) / share.sum())])
        trainer = _Trainer(rng)
        for epoch in range(EPOCHS):
            trainer.epoch(buckets, begins, targets, weights, RATE * (1 - epoch / EPOCHS))
        model = trainer.model()
        score = model.of_buckets(buckets, begins)[len(sound) :]
        # the worst sentence of each document carries its label, and others nearly as bad; documents without any bad
        # sentence (wrong labels) count little
        top = np.zeros(len(documents))
        np.maximum.at(top, owners, score)
        share = np.where(score >= 0.93 * top[owners], score, 0.01 * score) + 1e-4
    return model


def worst(model: Model, documents: list[list[str]]) -> np.ndarray:
    """The score of the worst sentence of each document, 0 without sentences."""
    top = np.zeros(len(documents))
    np.maximum.at(top, np.repeat(np.arange(len(documents)), [len(d) for d in documents]), model.score([s for d in documents for s in d]))
    return top


def best_threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The threshold of document scores with the best F1; of several about as good, the middle one."""
    grid = np.linspace(0.3, 0.97, 68)
    f1 = np.array([2 * ((scores >= t) & (truth == 1)).sum() / max(1, (scores >= t).sum() + (truth == 1).sum()) for t in grid])
    near = grid[f1 >= f1.max() - 1e-3]
    return float(near[len(near) // 2])


def fold(text: str) -> int:
    """The part that a labelled text belongs to; copies belong to the same."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS


def held_out(texts: list[str], labels: list[int], part: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """A model of the texts outside a part (-1: of all), and the scores and labels of the texts inside."""
    inside = np.array([fold(t) == part for t in texts], bool)
    documents = [sentences(t) for t in texts]
    model = learn([d for d, i in zip(documents, inside) if not i], [y for y, i in zip(labels, inside) if not i])
    return model, worst(model, [d for d, i in zip(documents, inside) if i]), np.array(labels, int)[inside]


def train(texts: list[str], labels: list[int]) -> Model:
    """A model of all texts with the threshold from held-out parts, here and now (fit() does this in Spark tasks)."""
    parts = [held_out(texts, labels, k) for k in range(FOLDS)]
    model = held_out(texts, labels, -1)[0]
    model.threshold = best_threshold(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
    return model


def labelled(documents: DataFrame, labels: DataFrame, most: int = LABELLED, characters: int = CHARACTERS) -> DataFrame:
    """text and toxic of at most `most` labelled documents, drawn by hash, and no more than so many characters. Null labels
    are left out; a document with two that disagree too."""
    one = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where(F.col("toxic") == F.col("high")).drop("high")
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    drawn = one.orderBy(*order).limit(most)
    texts = stored(documents.select("doc_id", "text").join(drawn, "doc_id").where(F.col("text").isNotNull()), "labelled")
    upto = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over lengths of the drawn ones only
    kept = texts.select("doc_id", F.length("text").alias("n")).withColumn("upto", upto).where(F.col("upto") <= characters).select("doc_id")
    return texts.join(kept.distinct(), "doc_id").orderBy("doc_id").select("text", "toxic")


def fit(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """A model of the labelled documents, at most `most` of them: a task for each held-out part and one for the model."""
    rows = labelled(documents, labels, most).withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(-1, FOLDS)])))

    def run(key: tuple[int], group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["text", "toxic"])
        model, scores, truth = held_out(group["text"].tolist(), group["toxic"].astype(int).tolist(), key[0])
        weights = model.weights.tobytes() if key[0] < 0 else b""
        return pd.DataFrame({"part": [key[0]], "weights": [weights], "bias": [model.bias], "scores": [scores.tolist()], "truth": [truth.tolist()]})

    # as many partitions as models, and one in each, as a range has no collisions
    models = rows.repartitionByRange(FOLDS + 1, "part").groupBy("part").applyInPandas(run, "part int, weights binary, bias double, scores array<double>, truth array<int>").collect()
    whole = next((m for m in models if m["part"] < 0), None)
    if whole is None:
        return learn([], [])
    parts = [m for m in models if m["part"] >= 0]
    threshold = best_threshold(np.concatenate([m["scores"] for m in parts]), np.concatenate([m["truth"] for m in parts]))
    return Model(np.frombuffer(whole["weights"], np.float32), whole["bias"], threshold)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (of the worst sentence, 0 to 1) and abusive of every document. Null, empty and blank texts score 0; repeated
    rows come out as often as they are there, an empty table gives no rows, other columns are not read."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            split = [sentences(t) for t in batch["text"]]
            # sentences recur: each distinct one is scored once
            places: dict[str, int] = {}
            which = np.array([places.setdefault(s, len(places)) for d in split for s in d], np.int64)
            by_sentence = known.score(list(places))
            top = np.zeros(len(batch))
            np.maximum.at(top, np.repeat(np.arange(len(batch)), [len(d) for d in split]), by_sentence[which] if len(which) else np.zeros(0))
            yield pd.DataFrame({"key": batch["key"], "score": np.round(top, 6), "abusive": top >= known.threshold})

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    return rows.mapInPandas(run, f"key {kind}, score double, abusive boolean").withColumnRenamed("key", key)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", "source")


_fitted: dict[tuple[str, ...], Model] = {}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all documents; the queries of one application train one model per set of label files."""
    documents, labels = _documents(spark, sf_dir), table(spark, sf_dir, "content_labels", "doc_id", "toxic")
    known = (spark.sparkContext.applicationId, *sorted(labels.inputFiles()))
    if known not in _fitted:
        _fitted[known] = fit(documents, labels)
    return score(documents, _fitted[known])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of each abusive document."""
    return _scored(spark, sf_dir).where("abusive").select("doc_id").distinct()


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score and abusive of every document."""
    return _scored(spark, sf_dir)


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, abusive ones and their rate, per source; a null source is one."""
    sources = _documents(spark, sf_dir).select("doc_id", "source")
    flags: Column = F.count_if("abusive")
    return sources.join(_scored(spark, sf_dir), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), flags.alias("n_abusive"), (flags / F.count(F.lit(1))).alias("rate"))


QUERIES = {"p8_found": found, "p8_scores": scores, "p8_rates": rates}
