"""Sentences of texts and their sorted neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmeter.session import stored

SENTENCE_END = r"""(?<=[.!?。！？]["”»'’)\]]{0,2})\s+|(?<=[。！？])(?=[^"”»'’)\]\s])|\n+"""
TERMINATED = r"""(?U)[.!?。！？]["”»'’)\]*_`]*\s*$"""


def sentences(text: Column) -> Column:
    """The sentences and lines of a text, in order; blank ones are left out."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")


def words(text: Column) -> Column:
    """The number of words; a run of Chinese characters counts one word for every two of them."""
    counted = lambda t: F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    han = F.length(F.regexp_replace(text, r"[^一-鿿]", ""))
    return F.when(text.rlike("[一-鿿]"), counted(F.regexp_replace(text, r"[一-鿿]", " ")) + F.floor(han / 2)).otherwise(counted(text))


#: Tasks over which looked_up() spreads the rows of one key.
SALTS = 8


def looked_up(rows: DataFrame, known: DataFrame, on: list[str], by: str) -> DataFrame:
    """rows left joined with known, a small table that has each key once. The rows of a key, null included, are spread over
    SALTS tasks by a hash of their column `by`, so that a key that a large share of them has holds nothing up; the rows of
    known are repeated as often."""
    salted = rows.withColumn("salt__", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    repeated = known.withColumn("salt__", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(repeated, [*on, "salt__"], "left").drop("salt__")


def next_in_order(texts: DataFrame, column: str) -> DataFrame:
    """Distinct texts with the one that follows each in binary order (null after the last).

    The texts are split by range, so that a common beginning, however many texts have it, spreads over many tasks. The
    text after a partition's last is the first of the next one that has any: one row per partition, whatever the input.
    """
    ranges = texts.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column)
    parts = stored(ranges.withColumn("part__", F.spark_partition_id()), "ranges")  # stored, so that the numbers stay the same
    following = parts.withColumn("next", F.lead(column).over(Window.partitionBy("part__").orderBy(column)))
    firsts = parts.groupBy("part__").agg(F.min(column).alias("first__"))
    edges = firsts.select("part__", F.lead("first__").over(Window.orderBy("part__")).alias("edge__"))
    return following.join(edges, "part__").select(column, F.coalesce("next", "edge__").alias("next"))
