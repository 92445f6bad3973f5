"""Problem 7: mixes of sources with target weights.

The documents of a source fall into blocks of about equal size by a hash. Each mix takes whole passes over the blocks of a
source and a part of one more pass, in a permuted order of its own, up to the tokens that its share asks for and that
max_repeats allows. A splitting tree deals the blocks to output shards: every node draws from a multivariate
hypergeometric distribution how many blocks of each source go to its left half, so that the quotas of the shards add up
exactly. The nodes are rows, one per node, and the tree grows in rounds over all of them. Then each shard takes its stretch
of each source's permuted order, which no other shard has, and shuffles its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docmeter.llm.encode import TOKENIZERS, WORDS, vocabulary
from docmeter.operators.ordered import running_totals
from docmeter.session import stored, table

BLOCK_TOKENS, SHARD_TOKENS = 20_000, 2_000_000
#: Levels of the tree that a task splits a node by, before the nodes are dealt to tasks anew.
LEVELS = 8
#: The generator of random numbers draws from fewer items than this.
MOST_ITEMS = 10**9
SEED = 7


def token_sizes(documents: DataFrame, root: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, source and tokens (of a public tokenizer) of each document; a null or empty text has 0."""
    known = vocabulary(name, root)
    ranks = dict(zip(known["bytes"].to_pylist(), known["id"].to_pylist()))
    sent = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=sent.value, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, tokens bigint")


def draw(rng: np.random.Generator, items: np.ndarray, take: int) -> np.ndarray:
    """How many of each kind are among `take` items drawn without replacement. From MOST_ITEMS items on, kind after kind comes
    from a normal law of the same mean and variance, rounded and held within what is possible; the sum is exact too."""
    if items.sum() < MOST_ITEMS:
        return rng.multivariate_hypergeometric(items, take, method="marginals")
    out, rest, need = np.zeros_like(items), int(items.sum()), take
    for i, n in enumerate(items[:-1].tolist()):
        mean = need * n / max(1, rest)
        spread = (mean * (1 - n / max(1, rest)) * (rest - need) / max(1, rest - 1)) ** 0.5
        out[i] = min(max(round(rng.normal(mean, spread)), need - (rest - n), 0), n, need)
        rest, need = rest - n, need - int(out[i])
    out[-1] = need
    return out


def split(mix: str, low: int, high: int, starts: np.ndarray, counts: np.ndarray, levels: int, seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The nodes (low, high, starts, counts) `levels` below a node of the tree, or its leaves where they come before. A node
    stands for the shards from low up to high; counts are its blocks of each source, which begin at starts in the order of
    that source. What a node draws depends on seed, mix, low and high only."""
    if high - low == 1 or levels == 0:
        return [(low, high, starts, counts)]
    middle = (low + high) // 2
    rng = np.random.default_rng([seed, *mix.encode(), low, high])
    left = draw(rng, counts, round(int(counts.sum()) * (middle - low) / (high - low)))
    return split(mix, low, middle, starts, left, levels - 1, seed) + split(mix, middle, high, starts + left, counts - left, levels - 1, seed)


def shards(counts: DataFrame, seed: int = SEED, levels: int = LEVELS) -> DataFrame:
    """mix, source, shard, first and last: the stretch of a source's order that each shard gets; no row where it gets none.

    counts has mix, source, n_blocks and n_shards. The root of a mix is one row (a mix has as many sources as mix_targets
    states); every round replaces each node by those `levels` below it and deals them to tasks anew, so that rounds grow
    with the logarithm of the shards and no task holds a tree.
    """
    sources = F.array_sort(F.collect_list(F.struct("source", "n_blocks")))
    roots = counts.groupBy("mix").agg(F.max("n_shards").cast("bigint").alias("high"), sources.alias("s")).select(
        "mix", F.lit(0).cast("bigint").alias("low"), "high", F.col("s.source").alias("sources"), F.transform("s", lambda x: F.lit(0).cast("bigint")).alias("starts"), F.col("s.n_blocks").alias("counts")
    )
    most = roots.agg(F.max("high")).first()[0] or 1

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                nodes = split(r.mix, r.low, r.high, np.array(r.starts, np.int64), np.array(r.counts, np.int64), levels, seed)
                yield pd.DataFrame([(r.mix, low, high, r.sources, starts, counts_) for low, high, starts, counts_ in nodes], columns=list(batch.columns))

    nodes = roots
    for _ in range(-(-(most - 1).bit_length() // levels)):
        nodes = nodes.repartition("mix", "low").mapInPandas(grow, nodes.schema)
    parts = nodes.select("mix", F.col("low").alias("shard"), F.explode(F.arrays_zip("sources", "starts", "counts")).alias("p")).where("p.counts > 0")
    return parts.select("mix", F.col("p.sources").alias("source"), "shard", F.col("p.starts").alias("first"), (F.col("p.starts") + F.col("p.counts") - 1).alias("last"))


def quotas(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per mix and source: available (tokens of the source), target_tokens, quota (tokens to take, at most max_repeats
    times those available), passes (whole ones) and part (tokens of a further pass). A source without documents has 0."""
    available = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    total = sizes.agg(F.sum("tokens")).scalar()
    asked = targets.select("mix", "source", "target_share", "max_repeats", "size_ratio").join(available, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    wanted = asked.withColumn("target_tokens", F.coalesce(F.col("target_share") * F.col("size_ratio") * total, F.lit(0.0)))
    quota = F.least(F.col("target_tokens"), (F.coalesce("max_repeats", F.lit(0)) * F.col("available")).cast("double"))
    passes = F.when(F.col("available") > 0, F.floor(F.col("quota") / F.col("available"))).otherwise(0)
    return (
        wanted.withColumn("quota", quota).withColumn("passes", passes)
        .withColumn("part", F.col("quota") - F.col("passes") * F.col("available"))
        .select("mix", "source", "target_share", "max_repeats", "size_ratio", "available", "target_tokens", "quota", "passes", "part")
    )


def mixed(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """mix, shard, position, doc_id, source, repeat (0 for the first copy) and tokens of every document of every mix.

    sizes has doc_id, source and tokens; documents without tokens or without source are in no mix. Every source comes as
    near to its quota as half a document. Repeated rows are documents of their own; a mix with no documents has no rows.
    """
    sizes = sizes.select("doc_id", "source", "tokens")
    usable = sizes.where(F.col("source").isNotNull() & (F.col("tokens") > 0))
    plan = stored(quotas(sizes, targets), "quotas")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("available") / block_tokens))
    per_source = plan.groupBy("source").agg(F.max(n_blocks).alias("n_blocks"))
    tagged = stored(usable.join(per_source, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks"))).drop("n_blocks"), "blocks")

    # the passes of each mix over the blocks of each source, in permuted order, and the place of each block among those dealt
    blocks = stored(tagged.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")), "sizes")
    passes = plan.select("mix", "source", "passes", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))).alias("repeat"))
    present = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n_present"))
    turns = passes.join(present, "source").join(blocks, "source").withColumn("turn", F.xxhash64("mix", "repeat", "block", F.lit(seed)))
    ordered = running_totals(turns, ["mix", "source", "repeat"], ["turn", "block"], {"upto": F.col("block_tokens"), "rank": F.lit(1)})
    dealt = ordered.withColumns({"before": F.col("upto") - F.col("block_tokens"), "place": F.col("repeat") * F.col("n_present") + F.col("rank") - 1})
    dealt = stored(dealt.where((F.col("repeat") < F.col("passes")) | (F.col("before") < F.col("part"))).select("mix", "source", "repeat", "passes", "part", "block", "block_tokens", "before", "place"), "dealt")

    # the splitting tree: from blocks per source to stretches per source and shard
    tokens = plan.groupBy("mix").agg(F.greatest(F.lit(1), F.ceil(F.sum("quota") / shard_tokens)).alias("n_shards"))
    counts = dealt.groupBy("mix", "source").agg(F.count(F.lit(1)).alias("n_blocks")).join(tokens, "mix")
    intervals = shards(counts, seed)
    places = intervals.select("mix", "source", "shard", F.explode(F.sequence("first", "last")).alias("place"))
    placed = dealt.join(places, ["mix", "source", "place"]).select("mix", "source", "block", "repeat", "shard", F.when((F.col("repeat") == F.col("passes")) & (F.col("before") + F.col("block_tokens") > F.col("part")), F.col("part") - F.col("before")).alias("room"))

    copies = placed.join(tagged, ["source", "block"])
    # the one block of a mix and source that does not fit: its documents, in permuted order, up to the tokens left
    whole = copies.where(F.col("room").isNull())
    last = Window.partitionBy("mix", "source").orderBy(F.xxhash64("mix", "doc_id", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = copies.where(F.col("room").isNotNull()).withColumn("used", F.coalesce(F.sum("tokens").over(last), F.lit(0))).where(F.col("used") + F.col("tokens") / 2 <= F.col("room")).drop("used")
    shuffled = Window.partitionBy("mix", "shard").orderBy(F.xxhash64("mix", "shard", "doc_id", "repeat", F.lit(seed)), "doc_id", "repeat")
    return whole.unionByName(parts).withColumn("position", F.row_number().over(shuffled) - 1).select("mix", "shard", "position", "doc_id", "source", "repeat", "tokens")


def report(sizes: DataFrame, targets: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per mix and source: the tokens asked for and reached, the share of the mix that they make up, the copies of the
    most repeated document, and whether max_repeats held the source back."""
    reached = rows.groupBy("mix", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_copies"), (F.max("repeat") + 1).alias("most_copies"))
    joined = quotas(sizes, targets).join(reached, ["mix", "source"], "left").na.fill(0, ["tokens", "n_copies", "most_copies"])
    everything: Column = F.sum("tokens").over(Window.partitionBy("mix"))
    return joined.select(
        "mix", "source", "target_share", (F.col("tokens") / F.nullif(everything, F.lit(0))).alias("share"), "target_tokens", "tokens", "available", "n_copies", "most_copies", "max_repeats",
        (F.col("quota") < F.col("target_tokens")).alias("held_back"),
    )


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(token_sizes(table(spark, sf_dir, "documents", "doc_id", "source", "text")), "sizes")


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of every mix, with its shard and position."""
    return mixed(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the sources of each mix reach."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return report(sizes, targets, mixed(sizes, targets))


QUERIES = {"p7_mix": mix, "p7_shares": shares}
