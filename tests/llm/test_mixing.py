import numpy as np
import pytest
from pyspark.sql import functions as F

from docmeter.llm import mixing as M

TARGETS = [("m", "big", 0.6, 2, 0.5), ("m", "small", 0.4, 3, 0.5), ("other", "gone", 1.0, 2, 0.5), ("other", "big", 0.0, 2, 0.5)]


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, "big", 10 + i % 7, "x") for i in range(1500)] + [(5000 + i, "small", 20, "x") for i in range(50)] + [(9000, None, 50, "x"), (9001, "small", 0, "x"), (9002, "unused", 100, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, block string"), spark.createDataFrame(TARGETS, "mix string, source string, target_share double, max_repeats int, size_ratio double")


def test_quotas_repeats_and_shards(data):
    sizes, targets = data
    rows = M.mixed(sizes, targets, block_tokens=300, shard_tokens=2000).toPandas()
    assert set(rows["mix"]) == {"m"}
    total = sizes.agg(F.sum("tokens")).first()[0]
    tokens = rows.groupby("source")["tokens"].sum()
    assert abs(tokens["big"] - 0.6 * 0.5 * total) <= 10
    assert tokens["small"] == 3 * 50 * 20  # held back by max_repeats
    assert rows["repeat"].max() == 2 and not rows.duplicated(["doc_id", "repeat"]).any()
    shards = rows.groupby("shard")["tokens"].sum()
    assert len(shards) > 2 and shards.max() < 2 * shards.min()
    assert all(sorted(g["position"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert rows["tokens"].min() > 0 and 9000 not in set(rows["doc_id"])


def test_same_again(data):
    once = [sorted(map(tuple, M.mixed(*data, block_tokens=300, shard_tokens=2000).collect())) for _ in range(2)]
    assert once[0] == once[1]


def test_report(data):
    rows = {(r["mix"], r["source"]): r for r in M.report(*data, M.mixed(*data, block_tokens=300, shard_tokens=2000)).collect()}
    assert len(rows) == len(TARGETS)
    assert rows["m", "small"]["held_back"] and not rows["m", "big"]["held_back"]
    assert rows["m", "big"]["share"] + rows["m", "small"]["share"] == pytest.approx(1)
    assert rows["other", "gone"]["tokens"] == 0 and rows["other", "gone"]["share"] is None


def test_tree_adds_up():
    quotas = np.array([1000, 37, 1, 0])
    for n in (1, 2, 7):
        leaves = M.split("m", 0, n, np.zeros(4, np.int64), quotas, 60, 1)
        counts, starts = np.array([x[3] for x in leaves]), np.array([x[2] for x in leaves])
        assert [x[:2] for x in leaves] == [(i, i + 1) for i in range(n)]
        assert (counts.sum(axis=0) == quotas).all() and (counts >= 0).all() and (starts == counts.cumsum(axis=0) - counts).all()
        assert counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 4


def test_rounds_over_nodes_are_the_tree(spark):
    rows = [("m", "a", 900, 300), ("m", "b", 70, 300), ("other", "a", 5, 1)]
    counts = spark.createDataFrame(rows, "mix string, source string, n_blocks bigint, n_shards bigint")
    got = {(r["mix"], r["source"], r["shard"]): (r["first"], r["last"]) for r in M.shards(counts, 3, levels=2).collect()}
    leaves = M.split("m", 0, 300, np.zeros(2, np.int64), np.array([900, 70]), 60, 3)
    want = {("m", "ab"[s], low): (int(starts[s]), int(starts[s] + n[s] - 1)) for low, _, starts, n in leaves for s in range(2) if n[s]}
    assert got == want | {("other", "a", 0): (0, 4)}


def test_many_shards(spark):
    counts = spark.createDataFrame([("m", "a", 9_000_000, 100_000), ("m", "b", 1_000_003, 100_000), ("m", "c", 17, 100_000)], "mix string, source string, n_blocks bigint, n_shards bigint")
    rows = M.shards(counts).persist()
    blocks = F.col("last") - F.col("first") + 1
    assert {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum(blocks)).collect()} == {"a": 9_000_000, "b": 1_000_003, "c": 17}
    per = rows.groupBy("shard").agg(F.sum(blocks).alias("n")).agg(F.count("n"), F.min("n"), F.max("n")).first()
    assert per[0] == 100_000 and per[2] - per[1] <= 20


def test_draws_from_more_items_than_the_generator_takes():
    items = np.array([3 * 10**9, 10**6, 0, 2 * 10**9])
    drawn = M.draw(np.random.default_rng(1), items, 10**9)
    assert drawn.sum() == 10**9 and (drawn >= 0).all() and (drawn <= items).all() and abs(drawn[0] / 10**9 - 3 / 5.001) < 1e-3


def test_sizes_and_empty(spark, data):
    texts = spark.createDataFrame([(1, "a", "Hello world"), (2, "a", ""), (3, None, None)], "doc_id bigint, source string, text string")
    assert {r["doc_id"]: r["tokens"] for r in M.token_sizes(texts).collect()} == {1: 2, 2: 0, 3: 0}
    assert M.mixed(data[0].limit(0), data[1]).count() == 0
