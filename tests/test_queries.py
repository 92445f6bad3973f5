import glob
import importlib.util
import math
import os
from pathlib import Path

import duckdb
import pytest

SPEC = importlib.util.spec_from_file_location("spark_entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
ENTRY = importlib.util.module_from_spec(SPEC)
SPEC.loader.exec_module(ENTRY)
CORE = {name for module in ENTRY.MODULES if not module.__name__.startswith("docmeter.llm") for name in module.QUERIES}
SQL = ENTRY.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return v


@pytest.mark.parametrize("name", sorted(CORE & SQL.keys()))
def test_same_as_sql(spark, sf_dir, con, name):
    df = ENTRY.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=str) == ours


def test_no_other_query_is_without_sql():
    assert CORE - SQL.keys() == {"document_chunks", "power", "question_contexts"}


def test_chunks_put_together_are_the_documents(spark, sf_dir):
    import hashlib

    rows = {r["doc_id"]: r for r in ENTRY.queries()["document_chunks"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(rows) == {k for k, t in texts.items() if t and t.strip()}
    for k, r in rows.items():
        assert r["n_chunks"] >= -(-len(texts[k].strip()) // 400) and (hashlib.sha256(texts[k].encode()).hexdigest() == r["digest"] or not all(texts[k].splitlines()))


def test_power_of_the_tables(spark, sf_dir):
    row = ENTRY.queries()["power"](spark, sf_dir).first()
    assert row["n_sims"] in (0, 500) and (row["n_sims"] == 0 or 0 <= row["power"] <= 1 and 0.2 < row["mean_tau"] < 0.8)


def test_contexts_of_all_questions(spark, sf_dir):
    rows = ENTRY.queries()["question_contexts"](spark, sf_dir).collect()
    asked = {(r["question_id"], r["paper_id"]) for r in spark.read.parquet(f"{sf_dir}/architecture_results.parquet").collect()}
    papers = {r["paper_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["text"] and r["text"].strip()}
    assert {(r["question_id"], r["paper_id"]) for r in rows} == asked and len(rows) == len(asked)
    assert all((r["n_chunks"] > 0) == (r["paper_id"] in papers and r["paper_id"] is not None) == (r["digest"] is not None) for r in rows)


def test_entry(spark):
    assert ENTRY.entry(spark).count() > 0
