import random
import re

import duckdb
import pytest

from __spark_entry__ import oracle_sql
from docmeter.operators import overlap
from docmeter.plans import answers
from docmeter.plans.answers import evidence_hits

RESULTS = "result_id long, architecture string, dataset string, paper_id string, question_id string, run_index int, question string, predicted_answer string, retrieved_evidence_sentences array<string>"


def tables(spark, folder, results, documents):
    """Tables of (architecture, paper_id, sentences) and (paper_id, text)."""
    rows = [(i, a, "qasper", p, "q", 0, "", "", s) for i, (a, p, s) in enumerate(results)]
    spark.createDataFrame(rows, RESULTS).write.parquet(f"{folder}/architecture_results.parquet")
    spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(documents)], "doc_id long, paper_id string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def by_sql(folder):
    with duckdb.connect() as con:
        for name in ("architecture_results", "documents"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
        return sorted(con.sql(oracle_sql()["evidence_hits"]).fetchall(), key=str)


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def corpus(draw, papers, n_results, n_documents, words):
    text = lambda least, most: " ".join(draw.choices(words, k=draw.randint(least, most)))
    documents = [(draw.choice(papers), text(0, 60)) for _ in range(n_documents)]
    cut = lambda t: " ".join(t.split()[draw.randint(0, 20) :][: draw.randint(1, 25)])
    said = lambda: draw.choice([text(1, 24), cut(draw.choice(documents)[1]), cut(draw.choice(documents)[1]) + " " + draw.choice(words)])
    results = [(draw.choice(["flat", "raptor", None]), draw.choice(papers), [said() for _ in range(draw.randint(0, 3))]) for _ in range(n_results)]
    return results, documents


def test_pairs_of_sentences_and_documents_are_not_rows(spark, tmp_path):
    """500 sentences and 500 documents of one paper have nearly all words in common: 250,000 pairs."""
    draw = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    documents = [("p", " ".join(draw.choices(words, k=60))) for _ in range(500)]
    results = [("flat", "p", [" ".join(draw.sample(words, 20))]) for _ in range(500)]
    folder = tables(spark, tmp_path, results, documents)
    before, known = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        rows = sorted(map(tuple, evidence_hits(spark, folder).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    characters = sum(len(t) for _, t in documents) + sum(len(s) for r in results for s in r[2])
    assert shuffled(spark) - before < 3 * characters
    assert rows == by_sql(folder)


@pytest.mark.parametrize("block, cells, counted", [(overlap.BLOCK, overlap.CELLS, overlap.COUNTED), (1500, 1, 1)])
def test_evidence_hits_against_sql(spark, tmp_path, monkeypatch, block, cells, counted):
    """Whole and in many small parts, with papers of one side only, nulls, blanks and copies."""
    draw = random.Random(2)
    results, documents = corpus(draw, ["p", "p", "p", "q", "r"], 150, 120, [*"bcdfghijklmnopqrstuvwxyz", "Straße", "it's", "A", "the"])
    results += [("flat", "alone", ["b c d e f g h"]), ("flat", None, ["b c"]), ("flat", "p", None), ("flat", "p", [None, "", " - ", "the", "b c"]), *results[:20]]
    documents += [("unasked", "b c d e f g h"), (None, "b c d"), ("p", None), ("p", ""), ("p", " \n "), ("p", "a the"), *documents[:20]]
    folder = tables(spark, tmp_path, results, documents)
    monkeypatch.setattr(overlap, "CELLS", cells)
    monkeypatch.setattr(overlap, "COUNTED", counted)
    monkeypatch.setattr(answers, "sentence_hits", lambda *x: overlap.sentence_hits(*x, block=block))
    assert sorted(map(tuple, evidence_hits(spark, folder).collect()), key=str) == by_sql(folder)


def test_evidence_hits_without_rows(spark, tmp_path):
    assert evidence_hits(spark, tables(spark, tmp_path / "a", [], [("p", "b c")])).collect() == []
    assert [tuple(r) for r in evidence_hits(spark, tables(spark, tmp_path / "b", [("flat", "p", ["b c"])], [])).collect()] == [("flat", 1, 0, 0)]


@pytest.mark.parametrize("misses", [overlap.MISSES, 1])
def test_matches_against_plain_loops(monkeypatch, misses):
    import pyarrow as pa

    monkeypatch.setattr(overlap, "MISSES", misses)
    draw = random.Random(3)
    for trial in range(20):
        _, documents = corpus(draw, ["p", "q", "z"], 0, 70, [*"bcdfghijk"[: 3 + trial % 7], "xx", "yy", "zz"])
        documents = [(p, re.sub(" +", " ", t)) for p, t in documents]
        said = sorted({(p, " ".join(t.split()[draw.randint(0, 5) :][: draw.randint(1, 12)]) or "b") for p, t in documents} | {("q", "xx b c yy"), ("s", "b")})
        column = lambda rows, i: pa.chunked_array([[r[i] for r in rows[:9]], [r[i] for r in rows[9:]]], pa.string())
        held, hit = overlap.matches(column(said, 0), column(said, 1), column(documents, 0), column(documents, 1), 3, 0.6)
        for (p, s), x, y in zip(said, held, hit):
            own, d = [t for q, t in documents if q == p], set(s.split())
            assert x == any(f" {s} " in f" {t} " for t in own)
            assert y == (x or len(d) >= 3 and any(len(d & set(t.split())) / len(d) >= 0.6 for t in own))
