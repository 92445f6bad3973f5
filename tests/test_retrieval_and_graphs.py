import numpy as np
import pytest
from pyspark.sql import functions as F

from docmeter.operators import graph, resampling, retrieval


@pytest.mark.parametrize("size, overlap", [(0, 0), (5, 5), (5, -1)])
def test_bad_sizes(size, overlap):
    with pytest.raises(ValueError):
        retrieval.split_text("x", size, overlap)


def test_chunks_rebuild_the_text():
    text = "One sentence. Another one, longer than the first!\n\nA new paragraph; with parts, and more words. " * 5 + "x" * 200
    chunks = retrieval.split_text(text, 10)
    assert "".join(c for _, c in chunks) == text and max(len(c) for _, c in chunks) <= 40
    assert retrieval.split_text("  \n ", 10) == [] and retrieval.split_text("short", 10) == [(0, "short")]


def test_chunks_overlap():
    chunks = [c for _, c in retrieval.split_text("one two three four five six seven eight nine ten", 5, 2)]
    assert all(set(a.split()) & set(b.split()) for a, b in zip(chunks, chunks[1:]))


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(120, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(500, [0.0] * 8)], "id bigint, vector array<double>")
    queries = corpus.where("id < 7").withColumnRenamed("id", "query_id")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    got = {}
    for r in retrieval.nearest(queries, corpus, 5, queries_at_once=3, vectors_at_once=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in range(7):
        assert got[q] == np.argsort(-np.round(unit @ unit[q], 9), kind="stable")[:5].tolist()


def test_pack_stops_at_the_first_that_does_not_fit(spark):
    rows = spark.createDataFrame([("g", 1, 10), ("g", 2, 20), ("g", 3, 1), ("h", 1, 1000)], "g string, o int, c int")
    assert [tuple(r)[:2] for r in retrieval.packed(rows, "g", "o", F.col("c"), 25).collect()] == [("g", 1)]


def test_components_and_communities(spark):
    chain = [(1, f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [(1, "x", "y"), (2, "n00", "z"), (1, "x", "x"), (1, "x", "y")]
    edges = spark.createDataFrame(chain, "graph_id int, a string, b string")
    parts = {(r["graph_id"], r["name"]): r["component"] for r in graph.connected_components(edges).collect()}
    assert {parts[1, f"n{i:02d}"] for i in range(21)} == {"n00"} and parts[1, "y"] == "x" and parts[2, "z"] == "n00"
    cliques = [(1, f"{c}{i}", f"{c}{j}", 1) for c in "ab" for i in range(5) for j in range(i)] + [(1, "a0", "b0", 1)]
    found = {r["name"]: r["community"] for r in graph.label_propagation(spark.createDataFrame(cliques, "graph_id int, a string, b string, weight int")).collect()}
    assert len({found[f"a{i}"] for i in range(5)}) == 1 and len({found[f"b{i}"] for i in range(5)}) == 1
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_concordance(spark):
    ranks = [("p", x, i) for i, x in enumerate("abcd")] + [("q", x, 3 - i) for i, x in enumerate("abcd")] + [("r", x, i) for i, x in enumerate("bacd")]
    got = {(r["a"], r["b"]): r["tau"] for r in resampling.concordance(spark.createDataFrame(ranks, "rater string, item string, rank int"), "rater", "item", "rank").collect()}
    assert got["p", "q"] == -1 and got["p", "r"] == pytest.approx(4 / 6)


def test_resampled_means_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = [("d", f"c{rng.integers(0, 6)}", float(v)) for v in rng.random(60)]
    df = spark.createDataFrame(data, "dataset string, cluster string, m double")
    index = resampling.indexed(df, "dataset", "cluster")
    drawn = resampling.draws(spark, index.select("dataset", "n").distinct(), "dataset", 10)
    sums = df.groupBy("dataset", "cluster").agg(F.sum("m").alias("s"), F.count(F.lit(1)).alias("c"))
    means = {r["r"]: r["mean"] for r in resampling.resampled_means(sums, drawn, index, "dataset", "cluster").collect()}
    places = {r["i"]: r["cluster"] for r in index.collect()}
    times = {}
    for r in drawn.collect():
        drawn_times = times.setdefault(r["r"], {})
        drawn_times[places[r["i"]]] = drawn_times.get(places[r["i"]], 0) + 1
    for r, t in times.items():
        assert sum(t.values()) == len(places)
        w = np.array([t.get(c, 0) for _, c, _ in data])
        assert means[r] == pytest.approx((w * np.array([m for *_, m in data])).sum() / w.sum())


def test_signs_and_median_tau(spark):
    df = spark.createDataFrame([([[3.0, 2.0, 1.0], [3.0, 2.0, 1.0], [1.0, 2.0, 3.0], [3.0, 1.0, 1.0]],)], "scores array<array<double>>")
    signs = F.transform("scores", lambda s: resampling.pair_signs(s, 3))
    row = df.select(signs.alias("s"), resampling.median_tau(signs).alias("m"), resampling.median_tau(F.slice(signs, 1, 1)).alias("one")).first()
    assert row["s"] == [[-1, -1, -1], [-1, -1, -1], [1, 1, 1], [-1, -1, -1]] and row["m"] == 0.0 and row["one"] is None


def test_simulated_tests_against_plain_loops(spark):
    from itertools import combinations
    from statistics import median

    import numpy as np

    def plain(sim, raters, items, tau, permutations, seed):
        rng, pairs = np.random.default_rng([seed, sim]), list(combinations(range(items), 2))
        kept = rng.random((raters, len(pairs))) < (1 + tau) / 2
        orders = []
        for r in range(raters):
            wins = [0] * items
            for (i, j), k in zip(pairs, kept[r]):
                wins[i if k else j] += 1
            orders.append(sorted(range(items), key=lambda x: (-wins[x], x)))

        def mid(ranks):
            return round(median(sum(1 if (a[i] < a[j]) == (b[i] < b[j]) else -1 for i, j in pairs) / len(pairs) for a, b in combinations(ranks, 2)), 9)

        observed = mid([[o.index(i) for i in range(items)] for o in orders])
        dealt = np.argsort(rng.random((permutations, raters, items)), axis=2)
        return observed, (sum(mid(d.tolist()) >= observed for d in dealt) + 1) / (permutations + 1)

    sims = spark.createDataFrame([(0, 5), (1, 5), (2, 3), (3, 1)], "sim bigint, n_raters bigint")
    got = {r["sim"]: (r["tau"], r["p"]) for r in resampling.simulated_tests(sims, 4, 0.5, 40, 9).collect()}
    assert got == {sim: pytest.approx(plain(sim, n, 4, 0.5, 40, 9)) for sim, n in ((0, 5), (1, 5), (2, 3))}
    sure = resampling.simulated_tests(spark.range(20).select(F.col("id").alias("sim"), F.lit(12).alias("n_raters")), 4, 1.0, 60, 1)
    assert sure.where("p < 0.05 AND tau = 1").count() == 20
