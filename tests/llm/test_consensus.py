import random

import pytest
from pyspark.sql import functions as F

from docmeter.llm import consensus as C


def simulated(spark, seed=3):
    rng = random.Random(seed)
    quality = {f"good{i}": 0.9 for i in range(4)} | {f"poor{i}": 0.4 for i in range(3)} | {"spam": 0.0}
    rows, truth = [], {}
    for item in range(150):
        truth[f"i{item}"] = rng.choice("ABCD")
        for name in rng.sample(sorted(quality), 4):
            label = truth[f"i{item}"] if rng.random() < quality[name] else ("A" if name == "spam" else rng.choice("ABCD"))
            rows.append(("letter", f"i{item}", name, label))
    return spark.createDataFrame(rows, "kind string, item_id string, annotator string, label string"), truth


def test_recovers_truth_and_competence(spark):
    votes, truth = simulated(spark)
    labels, parameters = C.fit(votes)
    best = {r["item_id"]: r["label"] for r in C.best(labels).collect()}
    right = sum(best[k] == v for k, v in truth.items()) / len(truth)
    majority = votes.groupBy("item_id", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("item_id").agg(F.min(F.struct(-F.col("n"), "label")).alias("b")).select("item_id", "b.label")
    plain = sum(truth[r["item_id"]] == r["label"] for r in majority.collect()) / len(truth)
    assert right >= plain and right > 0.85
    skill = {r["annotator"]: r["competence"] for r in parameters.collect()}
    assert min(skill[f"good{i}"] for i in range(4)) > max(skill[f"poor{i}"] for i in range(3)) and skill["spam"] < 0.3


def test_same_labels_as_plain_em(spark):
    """The Spark steps against the same mixture written in a loop."""
    import math
    from collections import Counter, defaultdict

    votes, _ = simulated(spark, 5)
    rows = [(r["item_id"], r["annotator"], r["label"]) for r in votes.collect()]
    common = {k: v / len(rows) for k, v in Counter(l for *_, l in rows).items()}
    pair, n = Counter((a, l) for _, a, l in rows), Counter(a for _, a, _ in rows)
    comp, guess = {a: 0.7 for a in n}, {(a, l): common[l] for a, l in pair}
    def posterior():
        score = defaultdict(lambda: defaultdict(float))
        for i, a, l in rows:
            g = (1 - comp[a]) * guess[a, l]
            score[i][l] += math.log((comp[a] + g) / g)
        return {i: {l: math.exp(s) / sum(math.exp(x) for x in d.values()) for l, s in d.items()} for i, d in score.items()}
    for _ in range(5):
        p, true = posterior(), defaultdict(float)
        for i, a, l in rows:
            true[a, l] += p[i][l] * comp[a] / (comp[a] + (1 - comp[a]) * guess[a, l])
        total = {a: sum(t for (b, _), t in true.items() if b == a) for a in n}
        comp = {a: (total[a] + C.PRIOR_TRUE) / (n[a] + C.PRIOR_TRUE + C.PRIOR_GUESS) for a in n}
        guess = {(a, l): (pair[a, l] - true[a, l] + C.SMOOTHING * common[l]) / (n[a] - total[a] + C.SMOOTHING) for a, l in pair}
    labels, parameters = C.fit(votes, ["equal"], 5)
    for r in parameters.collect():
        assert r["competence"] == pytest.approx(comp[r["annotator"]], abs=1e-9) and r["guess"] == pytest.approx(guess[r["annotator"], r["label"]], abs=1e-9)
    p = posterior()
    for r in labels.collect():
        assert r["probability"] == pytest.approx(p[r["item_id"]][r["label"]], abs=1e-9)


def test_rounds_end_where_nothing_moves(spark):
    votes, _ = simulated(spark, 7)
    votes = votes.limit(300)
    _, parameters = C.fit(votes)
    again = C._round(C.stored(votes.withColumn("salt", F.lit(0).cast("bigint")), "votes"), C._first_parameters(votes, ["equal"]).drop("competence", "guess").join(parameters.drop("n_votes"), ["kind", "annotator", "label"]))
    assert again.agg(F.max(F.abs(F.col("competence") - F.col("was")))).first()[0] <= 2 * C.TOLERANCE


def test_busy_annotators_are_spread(spark, monkeypatch):
    votes, _ = simulated(spark, 9)
    plain = {(r["item_id"], r["label"]): r["probability"] for r in C.fit(votes, ["equal"], 3)[0].collect()}
    monkeypatch.setattr(C, "TOGETHER", 10)
    assert C._first_parameters(votes, ["equal"]).agg(F.max("salts")).first()[0] > 3
    for r in C.fit(votes, ["equal"], 3)[0].collect():
        assert r["probability"] == pytest.approx(plain[r["item_id"], r["label"]], abs=1e-9)


def test_an_id_of_both_kinds(spark):
    votes = spark.createDataFrame([("letter", "q", "a", "A"), ("answer", "q", "b", "x"), ("answer", "q", "c", "x")], "kind string, item_id string, annotator string, label string")
    assert sorted((r["kind"], r["n_votes"]) for r in C.agreement(votes, ("kind", "item_id")).collect()) == [("answer", 2), ("letter", 1)]


def test_votes_are_read(spark):
    rows = [("q", "a", x) for x in ["A", "(b)", " C ", "D.", "E", "?", "", None]] + [(None, "a", "A"), ("q", None, "A")]
    letters = C.letter_votes(spark.createDataFrame([(*r, "extra") for r in rows], "question_id string, annotator string, predicted_letter_rescored string, label string"))
    assert sorted(r["label"] for r in letters.where("annotator = 'a' AND item_id = 'q'").collect()) == ["A", "B", "C", "D"]
    cells = spark.createDataFrame([("q", ["The Cat!", "", None], ["a", "b", "c"])] * 3 + [("n", [], [])], "qid string, gold_answers array<string>, gold_annotators array<string>")
    assert sorted(tuple(r) for r in C.once(C.answer_votes(cells)).collect()) == [("q", "a", "cat"), ("q", "b", "")]


def test_ties_repeats_and_nulls(spark):
    once = C.once(spark.createDataFrame([("q", "a", "B"), ("q", "a", "A"), ("q", "b", "B"), ("q", "b", "B"), ("q", "b", "A"), (None, "a", "A"), ("q", None, "A")], "item_id string, annotator string, label string"))
    assert sorted(tuple(r) for r in once.collect()) == [("q", "a", "A"), ("q", "b", "B")]
    tie = spark.createDataFrame([("k", "q", "a", "B"), ("k", "q", "b", "A"), ("k", "r", "c", None)], "kind string, item_id string, annotator string, label string")
    assert {r["item_id"]: r["label"] for r in C.best(C.fit(tie, rounds=3)[0]).collect()} == {"q": "A", "r": None}
    assert C.best(C.fit(tie.limit(0))[0]).count() == 0


def test_agreement(spark):
    votes = spark.createDataFrame([("q", "a", "A"), ("q", "b", "A"), ("q", "c", "B"), ("r", "a", "A")], "item_id string, annotator string, label string")
    got = {r["item_id"]: r["agreement"] for r in C.agreement(votes).collect()}
    assert got["q"] == pytest.approx(1 / 3) and got["r"] is None
