import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docmeter.sources import readers as R, writers as W
from docmeter.streaming.ledger import hourly_tokens, land, ledger_stream

SCHEMA = "a INT, b STRING"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_strict_and_tolerant(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", '{"a": 1, "b": "x"}', "", '{"a": 2}')
    assert sorted(r["a"] for r in R.json_lines(spark, path, SCHEMA).collect()) == [1, 2]
    bad = write(tmp_path / "y.jsonl", '{"a": 1}', "{oops", '{"a": 2}')
    with pytest.raises(Exception):
        R.json_lines(spark, bad, SCHEMA).collect()
    assert R.json_lines_tolerant(spark, bad, SCHEMA).count() == 2


def test_torn_last_line_only(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", '{"a": 1}', '{"a": 2, "b": "to')
    assert [r["a"] for r in R.json_lines_resumable(spark, path, SCHEMA).collect()] == [1]
    with pytest.raises(Exception):
        R.json_lines_resumable(spark, write(tmp_path / "y.jsonl", '{"a": 1', '{"a": 2}'), SCHEMA).collect()


def test_glued(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", '{"a": 1, "b": "x"}{"a": 2, "b": "y"} {"a": 3', '{"a": 4}')
    rows = R.glued_json(spark, path, SCHEMA).collect()
    assert sorted(r["a"] for r in rows if not r["malformed"]) == [1, 2, 4] and sum(r["malformed"] for r in rows) == 1


def test_glued_with_braces_in_strings(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", '{"a": 1, "b": "x}{\\"y"}{"a": 2, "b": "{"}  {"a": 3}')
    assert sorted((r["a"], r["b"], r["malformed"]) for r in R.glued_json(spark, path, SCHEMA).collect()) == [(1, 'x}{"y', False), (2, "{", False), (3, None, False)]


def test_appended_files_are_read_once(spark, tmp_path):
    source, saved = tmp_path / "in", str(tmp_path / "saved")
    source.mkdir()
    write(source / "a.json", '{"a": 1}')
    assert [r["a"] for r in R.appended(spark, str(source), SCHEMA, saved).collect()] == [1]
    write(source / "b.json", '{"a": 2}')
    assert [r["a"] for r in R.appended(spark, str(source), SCHEMA, saved).collect()] == [2]
    assert R.appended(spark, str(source), SCHEMA, saved).count() == 0


def test_date_floor(spark):
    rows = spark.createDataFrame([("2026-01-01",), ("2026-02-01",), (None,)], "t string")
    assert R.since(rows, F.to_timestamp("t"), "2026-01-15").count() == 1


def test_replace_is_all_or_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert W.current(spark, path) is None
    W.replace(spark.createDataFrame([(1, "old")], "k int, v string"), path)
    new = spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    with monkeypatch.context() as m:  # a crash between the write and the switch
        m.setattr(W, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            W.replace(new, path)
    assert [r["v"] for r in W.current(spark, path).collect()] == ["old"]
    W.replace(new, path)
    assert W.current(spark, path).count() == 2
    W.upsert(spark.createDataFrame([(2, "newer"), (3, "x")], "k int, v string"), path, ["k"])
    assert sorted(tuple(r) for r in W.current(spark, path).collect()) == [(1, "new"), (2, "newer"), (3, "x")]


def test_calls_are_stored_and_found(spark, tmp_path):
    path, parts = str(tmp_path / "calls"), ["model", "prompt"]
    wanted = spark.createDataFrame([("m", "p"), ("m", None), ("n", "p")], "model string, prompt string")
    assert W.get_calls(wanted, path, parts).where("response IS NULL").count() == 3
    answered = spark.createDataFrame([("m", "p", "one"), ("m", "p", "one"), ("n", "p", None)], "model string, prompt string, response string")
    assert W.put_calls(answered, path, parts) == 1 and W.put_calls(answered, path, parts) == 0
    assert {(r["model"], r["prompt"]): r["response"] for r in W.get_calls(wanted, path, parts).collect()} == {("m", "p"): "one", ("m", None): None, ("n", "p"): None}


def test_states_count_only_when_whole(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "states"), "architecture string, paper_id string, key_hash string, chunk string"
    wanted = spark.createDataFrame([("flat", "1", "h"), ("flat", "2", "h")], "architecture string, paper_id string, key_hash string")
    assert W.get_states(wanted, path) is None
    W.put_states(spark.createDataFrame([("flat", "1", "h", "a"), ("flat", "1", "h", "b")], schema), path)
    assert sorted(r["chunk"] for r in W.get_states(wanted, path).collect()) == ["a", "b"]
    with monkeypatch.context() as m:
        m.setattr(W, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            W.put_states(spark.createDataFrame([("flat", "2", "h", "c")], schema), path)
    assert W.get_states(wanted, path).count() == 2
    W.put_states(spark.createDataFrame([("flat", "2", "h", "c")], schema), path)
    assert W.get_states(wanted, path).count() == 3


def test_logs_files_maps(spark, tmp_path):
    write(tmp_path / "one.log", "run=aa", "noise", "run=bb")
    logs = str(tmp_path / "*.log")
    assert [tuple(r) for r in R.log_ids(spark, logs, r"run=(\w+)").collect()] == [("one", "bb")]
    assert [tuple(r) for r in R.log_ids(spark, logs, r"run=(\w+)", True).collect()] == [("one", "aa")]
    assert R.whole_files(spark, logs).first()["name"] == "one"
    text = 'x "abc": "TFT" y "ABC": "TT" "q": "maybe" "de": "F"'
    got = spark.createDataFrame([(text,)], "t string").select(R.truth_maps(F.col("t")).alias("m")).first()["m"]
    assert [(m["key"], m["letters"]) for m in got] == [("abc", "TFT"), ("de", "F")]


def test_config_and_latest(spark):
    leaves = R.flat_config({"a": {"value": 1, "source": "paper: x"}, "b": {"c": 2}})
    assert leaves == [("a", "1", "paper: x"), ("b.c", "2", None)]
    config = spark.createDataFrame(leaves, "path string, value string, source string")
    assert [r["path"] for r in R.without_source(config, ["paper:"]).collect()] == ["b.c"]
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, t int, v string")
    assert R.latest(rows, ["k"], [F.col("t")]).first()["v"] == "new"
    assert R.tail(rows, "t", 1).count() == 1


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    path = str(tmp_path / "t")
    assert W.append_new(rows, path, ["k"]) == 2
    assert W.append_new(rows, path, ["k"]) == 0
    assert W.append_new(spark.createDataFrame([(3, "z")], "k int, v string"), path, ["k"]) == 1
    assert spark.read.parquet(path).count() == 3


def test_fixed_width_and_zip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), (None, 100)], "name string, n int")
    assert sorted(tuple(r) for r in W.fixed_width(rows).collect()) == [("    ", "100"), ("a   ", "1  ")]
    lists = spark.createDataFrame([("n1", "ABA")], "paper_id string, letters string")
    assert W.submission_zip(lists, str(tmp_path / "s.zip")) == 1
    assert json.loads(zipfile.ZipFile(tmp_path / "s.zip").read("res_mc.json")) == {"n1": ["A", "B", "A"]}


def test_stream_lands_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = {"call_id": 1, "architecture": "flat", "stage": "generate", "failed": False, "uncached_input_tokens": 5, "output_tokens": 2, "received_at": "2026-01-01T00:00:00Z"}
    write(source / "a.json", json.dumps(row), json.dumps(row | {"received_at": "2026-01-01T05:00:00Z"}))
    for _ in range(2):
        land(ledger_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    write(source / "b.json", json.dumps(row | {"call_id": 2}))
    land(ledger_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    landed = spark.read.parquet(str(tmp_path / "out" / "calls"))
    assert sorted(r["call_id"] for r in landed.collect()) == [1, 2]
    assert sum(r["n_calls"] for r in hourly_tokens(landed).collect()) == 2


def test_late_calls_land_beside(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = {"call_id": 1, "architecture": "flat", "stage": "generate", "failed": False, "received_at": "2026-01-10T00:00:00Z"}
    write(source / "a.json", json.dumps(row))
    land(ledger_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    write(source / "b.json", json.dumps(row | {"call_id": 2, "received_at": "2026-01-07T00:00:00Z"}), json.dumps(row | {"received_at": "2026-01-15T00:00:00Z"}), json.dumps(row | {"call_id": 3}))
    land(ledger_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["call_id"] for r in spark.read.parquet(str(tmp_path / "out" / "calls")).collect()) == [1, 3]
    assert [r["call_id"] for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect()] == [2]
