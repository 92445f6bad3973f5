import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docmeter.operators.skew import chunk_count, heavy_keys, tree_aggregate
from docmeter.plans import skewed

KINDS = {"s": ("sum", "v"), "c": ("count", "v"), "n": ("count_rows", ""), "lo": ("min", "v"), "hi": ("max", "v"), "m": ("avg", "v")}


def plain(df, keys):
    return df.groupBy(*keys).agg(F.sum("v").alias("s"), F.count("v").alias("c"), F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), max_size=40), st.integers(2, 4))
def test_equals_group_by(spark, data, fan_in):
    df = spark.createDataFrame(data, "k string, v bigint").repartition(7)
    assert rows(tree_aggregate(df, ["k"], KINDS, fan_in)) == rows(plain(df, ["k"]))


def test_hot_key_many_chunks(spark):
    df = spark.range(0, 20_000, 1, 40).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") % 7).alias("v"))
    assert chunk_count(df) == 40
    assert rows(tree_aggregate(df, ["k"], KINDS, 3)) == rows(plain(df, ["k"]))


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([("a", 1, 9, "x"), ("a", 2, 9, "y")], "k string, v bigint, node__ int, n string")
    assert rows(tree_aggregate(df, ["k"], {"n": ("count_rows", ""), "node__": ("sum", "v")})) == [("a", 2, 3)]


def test_empty_and_errors(spark):
    df = spark.createDataFrame([], "k string, v bigint")
    assert rows(tree_aggregate(df, ["k"], KINDS)) == []
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {"x": ("median", "v")})
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], KINDS, 1)


def test_heavy_keys_leaves_nulls_out(spark):
    counts = spark.createDataFrame([("t", "a", 3), ("t", "b", 97), ("t", None, 1000), ("u", "a", 2), ("u", "b", 98)], "table_name string, paper_id string, n bigint")
    assert rows(heavy_keys(counts, "paper_id", 0.03, ["table_name"])) == [("t", "a"), ("t", "b"), ("u", "b")]


def test_queries_run(spark, sf_dir):
    found = skewed.found(spark, sf_dir)
    assert found.columns == ["table_name", "paper_id"] and found.count() > 0
