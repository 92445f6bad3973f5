import numpy as np
import pytest

from docmeter.llm import abuse as A

GOOD = ["The strongest tie concerns the letter number {}.", "Years later the people of town {} still spoke of the fire.", "This is garbage science, table {} contradicts the text.", "Shut up and take my money, when is volume {} out?", "I think section {} is too short.", "The killer result of chapter {} is fine."]
BAD = ["You are a worthless idiot and nobody wants you, number {}.", "Go to hell, you pathetic little loser {}.", "All those people are vermin and should be driven out of town {}.", "Send pics of your tits, you dirty slut {}."]


def corpus(n=240, seed=1):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        parts = [str(rng.choice(GOOD)).format(rng.integers(1000)) for _ in range(rng.integers(1, 5))]
        bad = i % 4 == 0
        if bad:
            parts.insert(int(rng.integers(0, len(parts) + 1)), str(rng.choice(BAD)).format(rng.integers(1000)))
        texts.append(" ".join(parts))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return A.train(*corpus())


def scores(model, *texts):
    return [float(max(model.score(A.sentences(t)), default=0)) for t in texts]


def test_held_out(model):
    texts, labels = corpus(200, 9)
    said = np.array(scores(model, *texts)) >= model.threshold
    assert (said == np.array(labels)).mean() > 0.95


def test_misspellings(model):
    assert min(scores(model, "you are a w0rthless idi​ot and nobody wants you.", "GO TO HEEEELL, you p a t h e t i c little l0ser.", "Go to hell, you pathetic little lоsеr.")) >= model.threshold


def test_model_is_linear():
    text = ["one two three"]
    buckets, begins = A.features(text)
    weights = np.zeros(1 << A.BITS, np.float32)
    weights[buckets[0]] = 5
    assert A.Model(weights, 0.0).score(text)[0] == pytest.approx(1 / (1 + np.exp(-5 * (buckets == buckets[0]).sum() / (A.PAD + len(buckets)))), rel=1e-5)
    alone = [A.features([t])[0].tolist() for t in ("a bc", "def")]
    both, at = A.features(["a bc", "def"])
    assert [sorted(both[at[i] : at[i + 1]].tolist()) for i in range(2)] == [sorted(x) for x in alone]


def test_spark_scores(spark, model):
    rows = [(1, "Go to hell, you pathetic little loser 5."), (2, None), (3, ""), (4, " \n"), (5, GOOD[0].format(3) + " " + BAD[0].format(3)), (6, GOOD[1].format(3) * 2000), (1, "Go to hell, you pathetic little loser 5.")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, score double")
    got = sorted((r["doc_id"], r["abusive"]) for r in A.score(df, model).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, True), (6, False)]
    assert A.score(df.limit(0), model).count() == 0


def test_fit_in_tasks_is_train(spark):
    texts, labels = corpus(90, 4)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id bigint, toxic int")
    model, again = A.fit(docs, marks), A.train(*zip(*sorted(zip(texts, labels))))
    assert model.threshold == again.threshold and model.bias == pytest.approx(again.bias) and np.allclose(model.weights, again.weights)


def test_bounds_of_training(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    assert A.labelled(docs, labels, 20).count() == 20 and A.labelled(docs, labels, 20, 1000).count() == 10


def test_threshold_is_the_middle_of_the_best():
    assert 0.45 < A.best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) < 0.65


def test_fit_leaves_out_nulls_and_conflicts(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 1), (4, None)], "doc_id bigint, toxic int")
    assert [tuple(r) for r in A.labelled(docs, labels).collect()] == [("x", 1)]
    assert A.fit(docs, labels.limit(0)).score(["x"])[0] < 0.5
