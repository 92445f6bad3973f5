"""Problem 4: consensus labels, agreement and the reliability of annotators.

A mixture of competence and spamming: with probability competence an annotator gives the true label of an item, otherwise
a label drawn from a guess distribution of their own. Expectation-maximisation finds the labels, the competences and the
guess distributions together, from several starts, until the competences stay the same. Every step is a join or an
aggregation over the votes; only the parameters, one row per annotator and label, go from one round to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docmeter.functions.text import normalize_text
from docmeter.operators.skew import tree_aggregate
from docmeter.session import cut, stored, table

#: First competences: all equal, by agreement with the majority, or by a hash of the annotator. After WARM rounds the start
#: under which the votes are most likely goes on, for each kind of items.
STARTS, WARM = ("equal", "majority", "hash"), 4
#: Rounds end when no competence moves by more than this.
TOLERANCE = 0.001
#: Votes of an annotator for one label that meet its parameters in one place at most; more are spread.
TOGETHER = 10_000
#: Beta prior of competence: as many truthful and guessed votes are added to those of each annotator.
PRIOR_TRUE, PRIOR_GUESS = 2.0, 1.0
#: As many guesses by the common distribution are added to those of each annotator.
SMOOTHING = 5.0


def letter_votes(votes: DataFrame) -> DataFrame:
    """item_id, annotator and label (A to D) of each vote with a usable letter, however it is written."""
    letter = F.upper(F.regexp_extract("predicted_letter_rescored", r"^\W*([A-Da-d])\W*$", 1))
    return votes.select(F.col("question_id").alias("item_id"), "annotator", letter.alias("label")).where(F.col("label") != "")


def answer_votes(cells: DataFrame) -> DataFrame:
    """item_id, annotator and label of each gold answer, normalised; an empty answer is a label, a null one no vote. The
    rows of a question repeat its answers: each annotator's answer counts once."""
    pairs = cells.select(F.col("qid").alias("item_id"), F.explode(F.arrays_zip("gold_answers", "gold_annotators")).alias("v"))
    return pairs.where(F.col("v.gold_answers").isNotNull()).select("item_id", F.col("v.gold_annotators").alias("annotator"), normalize_text(F.col("v.gold_answers")).alias("label"))


def once(votes: DataFrame) -> DataFrame:
    """One vote per item and annotator; rows without item or annotator are left out. Where an annotator gave several
    labels to an item, the most frequent counts, of equally frequent ones the smallest."""
    counts = votes.where(F.col("item_id").isNotNull() & F.col("annotator").isNotNull()).groupBy("item_id", "annotator", "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")
    return counts.groupBy("item_id", "annotator").agg(best).select("item_id", "annotator", F.col("best.label").alias("label"))


def _odds(competence: Column, guess: Column) -> Column:
    """Log of how much more likely a vote is if its label is the true one than if it is not."""
    return F.log((competence + (1 - competence) * guess) / ((1 - competence) * guess))


def _judged(votes: DataFrame, parameters: DataFrame) -> DataFrame:
    """votes (times starts) with competence, guess, the probability of their label being the true one of the item, and their
    part of the log likelihood. The labels of an item meet in windows over it: an item has at most as many votes as there are
    annotators. Votes meet the parameters spread by salts, so that a busy annotator holds nothing up."""
    keys = ["start", "kind", "item_id"]
    item, label = Window.partitionBy(*keys), Window.partitionBy(*keys, "label")
    spread = parameters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    scored = votes.join(spread, ["kind", "annotator", "label", "salt"]).withColumn("odds", _odds(F.col("competence"), F.col("guess"))).repartition(*keys)
    scored = scored.withColumns({"score": F.sum("odds").over(label), "n": F.count(F.lit(1)).over(label)})
    e, top = F.exp(F.col("score") - F.max("score").over(item)), F.max("score").over(item)
    scored = scored.withColumns({"e": e, "top": top}).withColumn("all_e", F.sum(F.col("e") / F.col("n")).over(item))
    likely = F.log((1 - F.col("competence")) * F.col("guess")) + (F.col("top") + F.log("all_e")) / F.count(F.lit(1)).over(item)
    return scored.withColumns({"probability": F.col("e") / F.col("all_e"), "likely": likely})


def _first_parameters(votes: DataFrame, starts: Sequence[str]) -> DataFrame:
    """start, kind, annotator, label, competence, guess, and what does not change: n_pair and n_votes (of the annotator for
    the label and in all), common (the share of the label among all votes of the kind, what everyone guesses) and salts."""
    pairs = votes.groupBy("kind", "annotator", "label").agg(F.count(F.lit(1)).alias("n_pair"))
    shares = pairs.groupBy("kind", "label").agg(F.sum("n_pair").alias("n_label"))
    sizes = shares.groupBy("kind").agg(F.sum("n_label").alias("n_all"))
    common = shares.join(sizes, "kind").select("kind", "label", (F.col("n_label") / F.col("n_all")).alias("common"))
    labels = votes.groupBy("kind", "item_id", "label").agg(F.count(F.lit(1)).alias("n"))
    modal = labels.groupBy("kind", "item_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("kind", "item_id", F.col("b.label").alias("modal"))
    own = votes.join(modal, ["kind", "item_id"]).groupBy("kind", "annotator").agg(F.count(F.lit(1)).alias("n_votes"), F.avg((F.col("label") == F.col("modal")).cast("double")).alias("agreeing"))
    first = {"equal": F.lit(0.7), "majority": F.least(F.lit(0.95), F.greatest(F.lit(0.2), F.col("agreeing"))), "hash": 0.4 + F.pmod(F.xxhash64("annotator"), F.lit(1000)) / 2000}
    begun = F.explode(F.array(*[F.struct(F.lit(x).alias("start"), first[x].alias("competence")) for x in starts]))
    return pairs.join(common, ["kind", "label"]).join(own, ["kind", "annotator"]).withColumn("s", begun).select(
        "s.start", "kind", "annotator", "label", "s.competence", F.col("common").alias("guess"), "n_pair", "n_votes", "common", F.ceil(F.col("n_pair") / TOGETHER).alias("salts")
    )


def _round(votes: DataFrame, parameters: DataFrame) -> DataFrame:
    """The parameters after one round, with was (the competence before) and likely (the votes' log likelihood before)."""
    truth = F.col("probability") * F.col("competence") / (F.col("competence") + (1 - F.col("competence")) * F.col("guess"))
    kept = [F.first(c).alias(c) for c in ("n_pair", "n_votes", "common", "salts")]
    told = _judged(votes, parameters).groupBy("start", "kind", "annotator", "label").agg(F.sum(truth).alias("true"), F.sum("likely").alias("likely"), F.first("competence").alias("was"), *kept)
    sums = told.groupBy("start", "kind", "annotator").agg(F.sum("true").alias("all_true"))
    guessed = F.col("n_votes") - F.col("all_true")
    return cut(
        told.join(sums, ["start", "kind", "annotator"]).select(
            "start", "kind", "annotator", "label",
            ((F.col("all_true") + PRIOR_TRUE) / (F.col("n_votes") + PRIOR_TRUE + PRIOR_GUESS)).alias("competence"),
            ((F.col("n_pair") - F.col("true") + SMOOTHING * F.col("common")) / (guessed + SMOOTHING)).alias("guess"),
            "n_pair", "n_votes", "common", "salts", "was", "likely",
        )
    )


def fit(votes: DataFrame, starts: Sequence[str] = STARTS, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels (kind, item_id, label, n, probability) and parameters (kind, annotator, label, competence, guess, n_votes).

    votes has kind, item_id, annotator and label, one row per item and annotator (see once()); each kind of items has its
    own competences and guesses. rounds is for tests: without it, rounds go on until no competence moves by more than
    TOLERANCE. A null label is a label of its own. An item with one vote keeps its label. Ties go to the label with more
    votes, then to the smaller one (best()). No votes give no rows.
    """
    votes = stored(votes.withColumn("label", F.coalesce("label", F.lit("\0"))), "votes")
    parameters = stored(_first_parameters(votes, starts), "parameters")
    votes = votes.join(parameters.select("kind", "annotator", "label", "salts").distinct(), ["kind", "annotator", "label"])
    votes = stored(votes.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.col("salts"))).select("kind", "item_id", "annotator", "label", "salt"), "votes")
    done = 0
    while rounds is None or done < rounds:
        parameters, done = _round(votes, parameters), done + 1
        if done == WARM and len(starts) > 1:
            likely = parameters.groupBy("kind", "start").agg(F.sum("likely").alias("likely"))
            parameters = cut(parameters.join(likely.groupBy("kind").agg(F.max_by("start", F.struct("likely", "start")).alias("start")), ["kind", "start"]))
        elif rounds is None and (done > WARM or len(starts) == 1) and (parameters.agg(F.max(F.abs(F.col("competence") - F.col("was")))).first()[0] or 0.0) <= TOLERANCE:
            break
    labels = _judged(votes, parameters).groupBy("kind", "item_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("probability").alias("probability"))
    return labels, parameters.drop("start", "n_pair", "common", "salts", "was", "likely")


def best(labels: DataFrame) -> DataFrame:
    """kind, item_id, label and probability of the most likely label of each item."""
    order = F.struct(F.round(-F.col("probability"), 9).alias("p"), (-F.col("n")).alias("n"), "label")
    return labels.groupBy("kind", "item_id").agg(F.min(order).alias("b")).select("kind", "item_id", F.when(F.col("b.label") != "\0", F.col("b.label")).alias("label"), (-F.col("b.p")).alias("probability"))


def agreement(votes: DataFrame, keys: Sequence[str] = ("item_id",)) -> DataFrame:
    """keys, n_votes and agreement: the share of pairs of votes of the item with equal labels (null for one vote)."""
    n = votes.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    items = n.groupBy(*keys).agg(F.sum("n").alias("n_votes"), F.sum(F.col("n") * (F.col("n") - 1)).alias("equal"))
    return items.select(*keys, "n_votes", F.when(F.col("n_votes") > 1, F.col("equal") / (F.col("n_votes") * (F.col("n_votes") - 1))).alias("agreement"))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(letter_votes(table(spark, sf_dir, "letter_votes", "question_id", "annotator", "predicted_letter_rescored")))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(answer_votes(table(spark, sf_dir, "scored_cells", "qid", "gold_answers", "gold_annotators")))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).withColumn("kind", F.lit("letter")).unionByName(_answers(spark, sf_dir).withColumn("kind", F.lit("answer")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, label: the consensus label of each item of letter_votes and scored_cells."""
    return best(fit(_votes(spark, sf_dir))[0]).select("item_id", "label")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind (letter or answer), consensus, its probability, the number of votes and their agreement for each item."""
    votes = _votes(spark, sf_dir)
    return best(fit(votes)[0]).join(agreement(votes, ("kind", "item_id")), ["kind", "item_id"])


def annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competence of each annotator (the share of their votes that tell the truth rather than a guess) and their votes, by
    kind of item."""
    return tree_aggregate(fit(_votes(spark, sf_dir))[1], ["kind", "annotator"], {"competence": ("max", "competence"), "n_votes": ("max", "n_votes")})


def agreement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise agreement of the letters of each question."""
    return agreement(_letters(spark, sf_dir))


QUERIES = {"p4_found": found, "p4_items": items, "p4_annotators": annotators, "p4_letter_agreement": agreement_rows}

SQL = {
    "p4_letter_agreement": r"""
        WITH v AS (
            SELECT question_id AS item_id, annotator, upper(regexp_extract(predicted_letter_rescored, '^\W*([A-Da-d])\W*$', 1)) AS label
            FROM letter_votes WHERE question_id IS NOT NULL AND annotator IS NOT NULL),
        c AS (SELECT item_id, annotator, label, count(*) AS n FROM v WHERE label <> '' GROUP BY ALL),
        o AS (SELECT item_id, label FROM c QUALIFY row_number() OVER (PARTITION BY item_id, annotator ORDER BY n DESC, label) = 1),
        n AS (SELECT item_id, label, count(*) AS n FROM o GROUP BY ALL)
        SELECT item_id, CAST(sum(n) AS BIGINT) AS n_votes,
               CASE WHEN sum(n) > 1 THEN sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) END AS agreement
        FROM n GROUP BY item_id""",
}
