import random

from pyspark.sql import functions as F

from docmeter.operators.ordered import next_known, numbered, running_total


def make(spark, n=300, parts=6):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, None, i]), rng.randint(0, 3)) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, i int, v int, w int").repartition(parts)


def test_running_total_over_many_parts(spark):
    data, df = make(spark)
    expected, sums = {}, {}
    for k, i, _, w in data:
        sums[k] = sums.get(k, 0) + w
        expected[i] = sums[k]
    got = {r["i"]: r["t"] for r in running_total(df, ["k"], ["i"], F.col("w"), "t").collect()}
    assert got == expected


def test_numbered(spark):
    data, df = make(spark)
    seen, expected = {}, {}
    for k, i, *_ in data:
        seen[k] = seen.get(k, 0) + 1
        expected[i] = seen[k]
    assert {r["i"]: r["n"] for r in numbered(df, ["k"], ["i"]).collect()} == expected


def test_next_known(spark):
    data, df = make(spark)
    expected, following = {}, {}
    for k, i, v, _ in reversed(data):
        if v is not None:
            following[k] = v
        expected[i] = following.get(k)
    assert {r["i"]: r["x"] for r in next_known(df, ["k"], ["i"], F.col("v"), "x").collect()} == expected


def test_empty(spark):
    df = spark.createDataFrame([], "k string, i int, v int")
    assert running_total(df, ["k"], ["i"], F.lit(1), "t").count() == 0
    assert next_known(df, ["k"], ["i"], F.col("v"), "x").count() == 0
