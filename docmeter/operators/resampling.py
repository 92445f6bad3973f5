"""Clustered bootstrap, permutations and rank correlation as joins and aggregations.

Draws are hashes of (resample, slot), so that the same draws come out on any engine and after any retry. Values are summed
per cluster before they meet the draws: a resample then costs one row per cluster, not one per question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docmeter.session import bounded, spread


def hash_draw(*parts: Column) -> Column:
    """An integer from 0 to 2^32 - 1 that depends on the parts only."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def indexed(clusters: DataFrame, by: str, key: str) -> DataFrame:
    """by, key, i (place of the cluster in the order of keys, from 0) and n (clusters of the group)."""
    order, group = Window.partitionBy(by).orderBy(key), Window.partitionBy(by)
    return clusters.select(by, key).distinct().withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(group))


def draws(spark: SparkSession, sizes: DataFrame, by: str, resamples: int) -> DataFrame:
    """by, r and i: the cluster in each of the n slots of each resample. sizes has by and n; clusters are drawn with
    replacement. The resamples are dealt to tasks before their slots are drawn, so that what is summed per resample needs no
    further shuffle of the draws."""
    rounds = spread(sizes.select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r")), by, "r")
    slots = rounds.select(by, "n", "r", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    return slots.select(by, "r", (hash_draw(F.col(by), F.col("r"), F.col("slot")) % F.col("n")).alias("i"))


def resampled_means(sums: DataFrame, drawn: DataFrame, index: DataFrame, by: str, cluster: str, *groups: str) -> DataFrame:
    """by, groups, r and mean of each resample; sums has by, cluster, groups, s (sum) and c (count) per cluster."""
    placed = sums.join(index.select(by, cluster, "i"), [by, cluster]).drop(cluster)
    weighed = drawn.join(bounded(placed), [by, "i"])  # a row per cluster and group: mostly small enough for the draws to stay where they are
    return weighed.groupBy(by, *groups, "r").agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("mean"))


def concordance(ranks: DataFrame, rater: str, item: str, rank: str) -> DataFrame:
    """a, b (raters, a < b), n_concordant, n_discordant and tau over the pairs of items that both ranked."""
    pairs = ranks.alias("x").join(ranks.alias("y"), (F.col(f"x.{rater}") == F.col(f"y.{rater}")) & (F.col(f"x.{item}") < F.col(f"y.{item}")))
    signs = pairs.select(F.col(f"x.{rater}").alias(rater), F.concat_ws("|", f"x.{item}", f"y.{item}").alias("pair"), F.signum(F.col(f"x.{rank}") - F.col(f"y.{rank}")).alias("sign"))
    both = signs.alias("p").join(signs.alias("q"), (F.col("p.pair") == F.col("q.pair")) & (F.col(f"p.{rater}") < F.col(f"q.{rater}")))
    same, other = F.count_if(F.col("p.sign") * F.col("q.sign") > 0), F.count_if(F.col("p.sign") * F.col("q.sign") < 0)
    counts = both.groupBy(F.col(f"p.{rater}").alias("a"), F.col(f"q.{rater}").alias("b")).agg(same.alias("n_concordant"), other.alias("n_discordant"))
    total = F.col("n_concordant") + F.col("n_discordant")
    return counts.withColumn("tau", F.when(total > 0, (F.col("n_concordant") - F.col("n_discordant")) / total).otherwise(0.0))


def pair_signs(scores: Column, n: int) -> Column:
    """Of n scores of items in a fixed order, for each pair of items: -1 if the earlier ranks before the later (a tie does),
    else 1."""
    return F.array(*[F.when(F.get(scores, F.lit(i)) >= F.get(scores, F.lit(j)), -1).otherwise(1) for i in range(n) for j in range(i + 1, n)])


def median_tau(signs: Column) -> Column:
    """The median tau over the pairs of raters, whose pair_signs() an array holds; null for fewer than two raters."""
    tau = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0), lambda s, x: s + x) / F.size(p)
    taus = F.array_sort(F.flatten(F.transform(signs, lambda p, i: F.transform(F.slice(signs, i + 2, F.size(signs)), lambda q: tau(p, q)))))
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    return F.round(middle(taus), 9)


def simulated_tests(sims: DataFrame, n_items: int, tau: float, permutations: int, seed: int) -> DataFrame:
    """sim, tau and p of simulated permutation tests; sims has sim and n_raters.

    Each rater keeps the order of every pair of items with probability (1 + tau) / 2, and ranks the items by the pairs they
    win, ties in the order of items. p is the share of permutations within raters, the observed one counted too, whose median
    tau between raters is at least the observed one. Numbers come from (seed, sim); with fewer than two raters there is no
    row.
    """
    first, second = np.triu_indices(n_items, 1)

    def medians(ranks: np.ndarray) -> np.ndarray:
        """ranks: tests x raters x items."""
        signs = np.where(ranks[:, :, first] < ranks[:, :, second], -1, 1).astype(np.float32)
        a, b = np.triu_indices(ranks.shape[1], 1)
        return np.round(np.median((signs @ signs.transpose(0, 2, 1))[:, a, b] / len(first), axis=1), 9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sim, raters in zip(batch["sim"], batch["n_raters"]):
                if raters < 2:
                    continue
                rng = np.random.default_rng([seed, int(sim)])
                keep = rng.random((raters, len(first))) < (1 + tau) / 2
                wins = np.zeros((raters, n_items))
                for pair, (i, j) in enumerate(zip(first, second)):
                    wins[:, i] += keep[:, pair]
                    wins[:, j] += ~keep[:, pair]
                ranks = np.argsort(np.argsort(-wins, axis=1, kind="stable"), axis=1)
                observed = medians(ranks[None])[0]
                dealt = np.argsort(rng.random((permutations, raters, n_items)), axis=2)
                rows.append((sim, float(observed), float(((medians(dealt) >= observed).sum() + 1) / (permutations + 1))))
            yield pd.DataFrame(rows, columns=["sim", "tau", "p"])

    return spread(sims.select("sim", "n_raters")).mapInPandas(run, "sim bigint, tau double, p double")
