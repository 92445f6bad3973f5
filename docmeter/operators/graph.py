"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docmeter.session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """graph_id, name and component (the smallest name reached) of each node of edges (graph_id, a, b).

    Every round points each node at the smallest label of its neighbours and then at that label's own label, until no label
    changes; labels only get smaller, so that comes to pass. Self loops and repeated edges change nothing; no edges, no rows.
    """
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = cut(links.select("graph_id", "a", "b").union(links.select("graph_id", "b", "a")).distinct())
    labels = cut(both.groupBy("graph_id", F.col("a").alias("name")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    done = False
    while not done:
        heard = both.join(labels.select("graph_id", F.col("name").alias("b"), "component"), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("name")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, ["graph_id", "name"]).select("graph_id", "name", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        shortcut = labels.select("graph_id", F.col("name").alias("component"), F.col("component").alias("further"))
        following = cut(nearer.join(shortcut, ["graph_id", "component"], "left").select("graph_id", "name", "was", F.least("component", F.coalesce("further", "component")).alias("component")))
        done = following.where(F.col("was") != F.col("component")).isEmpty()
        labels = following.drop("was")
    return labels


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """graph_id, name and community after a number of rounds in which each node takes the label of the greatest weight among
    its neighbours (ties: the smallest label); edges has graph_id, a, b and weight."""
    links = edges.where("a <> b")
    both = cut(links.select("graph_id", "a", "b", "weight").union(links.select("graph_id", "b", "a", "weight")))
    labels = both.select("graph_id", F.col("a").alias("name"), F.col("a").alias("community")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.select("graph_id", F.col("name").alias("b"), "community"), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("name"), "community").agg(F.sum("weight").alias("w"))
        best = F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("best")
        labels = cut(votes.groupBy("graph_id", "name").agg(best).select("graph_id", "name", F.col("best.community").alias("community")))
    return labels
