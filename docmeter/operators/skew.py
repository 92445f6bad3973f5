"""Per-key aggregation that stays balanced when a few keys hold most rows.

A plain groupBy sends all partial states of a key to one reducer: with P input splits that is P states for a hot key.
Here the input splits are the fixed-size chunks (spark.sql.files.maxPartitionBytes). Each is combined where it lies, and
the states are merged in rounds: in every round FAN_IN neighbouring chunks become one, so that no task ever receives
more than FAN_IN states of a key, and log(P) / log(FAN_IN) rounds remain instead of one reducer that gets everything.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

FAN_IN = 16

#: How two states of each kind merge. avg is kept as a sum and a count.
MERGE = {"sum": F.sum, "count": F.sum, "count_rows": F.sum, "min": F.min, "max": F.max}


def _first(kind: str, value: Column) -> Column:
    if kind == "count_rows":
        return F.count(F.lit(1))
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](value)


def chunk_count(df: DataFrame) -> int:
    """The number of input chunks (splits) of df; one row comes back to the driver, no column is read."""
    last = df.select(F.spark_partition_id().alias("c")).agg(F.max("c")).first()[0]
    return 1 if last is None else last + 1


def tree_aggregate(df: DataFrame, keys: Sequence[str], aggregates: dict[str, tuple[str, str]], fan_in: int = FAN_IN) -> DataFrame:
    """Aggregate df by keys through a tree of merges.

    aggregates maps an output name to (kind, column): kind is sum, count, count_rows, min, max or avg. Null keys form
    a group of their own, null values are left out as in SQL, an empty table gives no rows, repeated rows count each
    time, and other columns of df, whatever their names, are not read. The result equals
    df.groupBy(keys).agg(...); sums of doubles may differ in the last bit, as the order of addition is another.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    states: dict[str, tuple[str, str]] = {}
    for name, (kind, column) in aggregates.items():
        if kind == "avg":
            states |= {f"{name}__sum": ("sum", column), f"{name}__count": ("count", column)}
        elif kind in MERGE:
            states[name] = (kind, column)
        else:
            raise ValueError(f"no such kind of aggregate: {kind}")
    chunks = chunk_count(df)
    inputs = {n: f"v__{i}" for i, n in enumerate(states)}
    level = df.select(
        *[F.col(k).alias(f"k__{i}") for i, k in enumerate(keys)],
        *[(F.lit(1) if kind == "count_rows" else F.col(c)).alias(inputs[n]) for n, (kind, c) in states.items()],
        F.spark_partition_id().alias("node__"),
    )
    group = [f"k__{i}" for i in range(len(keys))]
    level = level.groupBy(*group, "node__").agg(*[_first(kind, F.col(inputs[n])).alias(inputs[n]) for n, (kind, _) in states.items()])
    for _ in range(max(0, math.ceil(math.log(chunks, fan_in)) - 1)):
        level = level.groupBy(*group, F.floor(F.col("node__") / fan_in).alias("node__")).agg(
            *[MERGE[kind](inputs[n]).alias(inputs[n]) for n, (kind, _) in states.items()]
        )
    merged = level.groupBy(*group).agg(*[MERGE[kind](inputs[n]).alias(n) for n, (kind, _) in states.items()])
    out = [F.col(f"k__{i}").alias(k) for i, k in enumerate(keys)]
    for name, (kind, _) in aggregates.items():
        out.append((F.col(f"{name}__sum") / F.col(f"{name}__count")).alias(name) if kind == "avg" else F.col(name))
    return merged.select(*out)


def heavy_keys(counts: DataFrame, key: str, least_share: float, by: Sequence[str] = ()) -> DataFrame:
    """Keys that hold at least least_share of the rows of their table, from per-key counts (key, n, and by, which names
    the table). Null keys count neither as keys nor in the total."""
    known = counts.where(F.col(key).isNotNull())
    totals = known.groupBy(*by).agg(F.sum("n").alias("total__"))
    return known.join(totals, list(by)).where(F.col("n") >= F.lit(least_share) * F.col("total__")).select(*by, key)
