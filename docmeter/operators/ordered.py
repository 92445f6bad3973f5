"""Computations along an order that do not put a whole group into one task.

Rows are split by range over (keys, order), so that a hot key spreads over many partitions. Each partition works alone;
what it needs from its neighbours is one row per partition and key, which a small window brings into order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmeter.session import stored


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df in range partitions, with the number of each row's partition; stored, so that the numbers stay the same."""
    return stored(df.repartitionByRange(*keys, *order).withColumn("part__", F.spark_partition_id()), "ordered")


def _by_part(df: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df joined with one row per partition and key; null keys match."""
    renamed = parts.select(F.col("part__").alias("p__"), *[F.col(k).alias(f"{k}__") for k in keys], *[c for c in parts.columns if c not in ("part__", *keys)])
    fits = F.col("part__") == F.col("p__")
    for k in keys:
        fits &= F.col(k).eqNullSafe(F.col(f"{k}__"))
    return df.join(renamed, fits, "left").drop("p__", *[f"{k}__" for k in keys])


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """df with a column per entry of values: the sum of its expression over the rows of the same keys up to this one (in the
    given order, which should be unique).

    Values must not be null. Null keys form a group. An empty table gives no rows.
    """
    names = list(values)
    placed = _placed(df.withColumns({f"value__{i}": values[n] for i, n in enumerate(names)}), keys, order)
    upto = Window.partitionBy("part__", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part__", *keys).agg(*[F.sum(f"value__{i}").alias(f"sum__{i}") for i in range(len(names))])
    before = sums.select("part__", *keys, *[F.coalesce(F.sum(f"sum__{i}").over(earlier), F.lit(0)).alias(f"before__{i}") for i in range(len(names))])
    total = _by_part(placed.withColumns({f"within__{i}": F.sum(f"value__{i}").over(upto) for i in range(len(names))}), before, keys)
    found = {n: F.col(f"within__{i}") + F.col(f"before__{i}") for i, n in enumerate(names)}
    return total.withColumns(found).drop("part__", *[f"{c}__{i}" for c in ("value", "within", "before") for i in range(len(names))])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """running_totals() of one value."""
    return running_totals(df, keys, order, {name: value})


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """df with the place of each row among those of the same keys, from 1."""
    return running_total(df, keys, order, F.lit(1), name)


def next_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """df with the first value that is not null at this row or after it, among rows of the same keys; null after the last."""
    placed = _placed(df.withColumn("value__", value), keys, order)
    # backwards, with frames that only grow: a frame that shrinks from the front is evaluated anew for every row
    onward = Window.partitionBy("part__", *keys).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.col("part__").desc()).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)
    firsts = placed.groupBy("part__", *keys).agg(F.min_by("value__", F.when(F.col("value__").isNotNull(), position)).alias("first__"))
    after = firsts.select("part__", *keys, F.last("first__", True).over(later).alias("after__"))
    filled = _by_part(placed.withColumn("within__", F.last("value__", True).over(onward)), after, keys)
    return filled.withColumn(name, F.coalesce("within__", "after__")).drop("part__", "value__", "within__", "after__")
