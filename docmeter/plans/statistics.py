"""Queries of significance and of rank stability over the scored cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docmeter.operators.resampling import concordance, draws, hash_draw, indexed, median_tau, pair_signs, resampled_means, simulated_tests
from docmeter.functions.metrics import rounded
from docmeter.session import bounded, spread, table

RESAMPLES = PERMUTATIONS = 10_000
#: Of the power estimate: simulations, permutations in each, the tau that is simulated, and the level of the test.
SIMULATIONS, PERMUTATIONS_EACH, TRUE_TAU, ALPHA = 500, 500, 0.5, 0.05
SEED = 42
#: Papers are the raters of the rank statistics: those with all four architectures, in groups of this many by a hash.
GROUPS = 12
ARCHITECTURES = ["flat", "naive_rag", "raptor", "graphrag"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scored_cells", "dataset", "cluster", "qid", "arch", "metric").where(F.col("metric").isNotNull()).distinct()


def question_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the clusters of each dataset, and the clusters and questions that each dataset has."""
    rows = table(spark, sf_dir, "scored_cells", "dataset", "cluster", "qid").distinct()
    counts = rows.groupBy("dataset", "cluster").agg(F.count(F.lit(1)).alias("n_questions"))
    return indexed(rows, "dataset", "cluster").join(counts, ["dataset", "cluster"]).select("dataset", "cluster", "i", "n", "n_questions")


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    index = indexed(rows, "dataset", "cluster")
    sums = rows.groupBy("dataset", "cluster", "arch").agg(F.sum("metric").alias("s"), F.count(F.lit(1)).alias("c"))
    drawn = draws(spark, index.select("dataset", "n").distinct(), "dataset", RESAMPLES)
    return resampled_means(sums, drawn, index, "dataset", "cluster", "arch")


def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean metric of each architecture in each clustered resample; halves of the last digit round up on any engine."""
    return _means(spark, sf_dir).select("dataset", "arch", "r", rounded("mean").alias("mean"))


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentile interval (95 %) of each architecture's mean over the resamples."""
    low, high = F.percentile("mean", 0.025), F.percentile("mean", 0.975)
    return _means(spark, sf_dir).groupBy("dataset", "arch").agg(rounded(low).alias("low"), rounded(high).alias("high"), rounded(F.avg("mean")).alias("mean"))


def paired_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat against each other architecture, and naive retrieval against the tree, on questions that both have: mean
    difference (against minus arch), interval and two-sided p."""
    rows = cells(spark, sf_dir)
    base = rows.where(F.col("arch").isin("flat", "naive_rag")).select("dataset", "qid", F.col("arch").alias("against"), F.col("metric").alias("theirs"))
    asked = (F.col("against") == "flat") & (F.col("arch") != "flat") | (F.col("against") == "naive_rag") & (F.col("arch") == "raptor")
    pairs = rows.join(base, ["dataset", "qid"]).where(asked).withColumn("d", F.col("theirs") - F.col("metric"))
    index = indexed(rows, "dataset", "cluster")
    sums = pairs.groupBy("dataset", "cluster", "against", "arch").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("c"))
    drawn = draws(spark, index.select("dataset", "n").distinct(), "dataset", RESAMPLES)
    resampled = resampled_means(sums, drawn, index, "dataset", "cluster", "against", "arch").where(F.col("mean").isNotNull())
    share = [F.avg((F.col("mean") > 1e-12).cast("double")), F.avg((F.col("mean") < -1e-12).cast("double"))]
    p = F.least(F.lit(1.0), 2 * F.least(*share))
    return resampled.groupBy("dataset", "against", "arch").agg(rounded(F.avg("mean")).alias("difference"), rounded(F.percentile("mean", 0.025)).alias("low"), rounded(F.percentile("mean", 0.975)).alias("high"), rounded(p).alias("p"), (p < 0.05).alias("significant"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rater, arch and score: the mean metric of each architecture in each group of papers that has all four."""
    group = hash_draw(F.col("cluster")) % GROUPS
    means = cells(spark, sf_dir).groupBy(F.concat_ws("-", "dataset", F.lpad(group.cast("string"), 2, "0")).alias("rater"), "arch").agg(rounded(F.avg("metric")).alias("score"))
    return means.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rater"))).where("n = 4").drop("n")


def _ranks(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "arch")))


def kendall_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concordant and discordant pairs and tau of each pair of groups."""
    return concordance(_ranks(_scores(spark, sf_dir), "rater"), "rater", "arch", "rank").withColumn("tau", rounded("tau"))


def kendall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and mean tau, the share of stable pairs, and the verdict."""
    stable = F.avg((F.col("tau") >= 0.67).cast("double"))
    verdict = F.when(stable >= 0.8, "YES").when(stable <= 0.4, "NO").otherwise("MIXED")
    return kendall_pairs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_pairs"), rounded(F.median("tau")).alias("median_tau"), rounded(F.avg("tau")).alias("mean_tau"), rounded(stable).alias("stable_share"), verdict.alias("verdict"))


def tau_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("tau") >= 0.67, "stable").when(F.col("tau") >= 0.33, "partly").otherwise("unstable")
    return kendall_pairs(spark, sf_dir).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_pairs"))


def median_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of resamples of the taus of all pairs: nearest-rank 2.5th and 97.5th percentile."""
    taus = kendall_pairs(spark, sf_dir).select(F.lit("all").alias("g"), F.concat_ws("|", "a", "b").alias("pair"), "tau")
    index = indexed(taus, "g", "pair")
    drawn = draws(spark, index.select("g", "n").distinct(), "g", RESAMPLES)
    rows = drawn.join(bounded(taus.join(index, ["g", "pair"]).select("g", "i", "tau")), ["g", "i"]).select("r", "tau")
    medians = rows.groupBy("r").agg(F.median("tau").alias("m"))
    ordered = F.array_sort(F.collect_list("m"))
    at = [rounded(F.element_at(ordered, F.lit(1) + F.floor(F.lit(q) * F.size(ordered)).cast("int"))) for q in (0.025, 0.975)]
    return medians.agg(at[0].alias("low"), at[1].alias("high"), rounded(F.avg("m")).alias("mean"))


def _raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rater and scores: the score of each architecture, in the order of names, as structs (arch, score)."""
    return _scores(spark, sf_dir).groupBy("rater").agg(F.array_sort(F.collect_list(F.struct("arch", "score"))).alias("scores"))


def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median tau of the groups against that after each group's scores were dealt anew: (n_ge + 1) / (n + 1)."""
    rounds = spread(_raters(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PERMUTATIONS)))), "k")
    drawn = F.array_sort(F.transform("scores", lambda x: F.struct(hash_draw(F.col("k"), F.col("rater"), x["arch"]).alias("h"), x["arch"].alias("a"), x["score"].alias("score"))))
    dealt = F.when(F.col("k") == 0, F.transform("scores", lambda x: x["score"])).otherwise(F.transform(drawn, lambda x: x["score"]))
    signs = rounds.select("k", "rater", pair_signs(dealt, len(ARCHITECTURES)).alias("signs"))
    medians = signs.groupBy("k").agg(F.collect_list("signs").alias("all")).select("k", median_tau(F.col("all")).alias("m"))  # a list holds the groups of papers
    observed = F.max(F.when(F.col("k") == 0, F.col("m")))
    values = medians.agg(observed.alias("observed"), F.collect_list(F.when(F.col("k") > 0, F.col("m"))).alias("ms"))
    reached = F.size(F.filter("ms", lambda m: m >= F.col("observed")))
    return values.select(rounded("observed").alias("median_tau"), rounded((reached + 1) / (F.size("ms") + 1)).alias("p"))


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the permutation test would find a tau of TRUE_TAU between as many groups of papers as there are."""
    sims = _raters(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_raters")).select("n_raters", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SIMULATIONS - 1).cast("bigint"))).alias("sim"))
    tests = simulated_tests(sims, len(ARCHITECTURES), TRUE_TAU, PERMUTATIONS_EACH, SEED)
    return tests.agg(F.count(F.lit(1)).alias("n_sims"), rounded(F.avg((F.col("p") < ALPHA).cast("double"))).alias("power"), rounded(F.avg("tau")).alias("mean_tau"), rounded(F.median("tau")).alias("median_tau"), rounded(F.avg("p")).alias("mean_p"))


def jackknife_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median tau of the groups when one question is left out: least, median and greatest, and how often it changes its
    band. Only the group of the question changes; its means come from sums."""
    rows = cells(spark, sf_dir).withColumn("rater", F.concat_ws("-", "dataset", F.lpad((hash_draw(F.col("cluster")) % GROUPS).cast("string"), 2, "0")))
    sums = rows.groupBy("rater", "arch").agg(F.sum("metric").alias("s"), F.count(F.lit(1)).alias("c"))
    own = rows.groupBy("rater", "dataset", "qid", "arch").agg(F.sum("metric").alias("qs"), F.count(F.lit(1)).alias("qc"))
    questions = own.select("rater", "dataset", "qid").distinct().join(sums, "rater").join(own, ["rater", "dataset", "qid", "arch"], "left")
    count = F.col("c") - F.coalesce("qc", F.lit(0))
    left = questions.where(count > 0).withColumn("score", rounded((F.col("s") - F.coalesce("qs", F.lit(0.0))) / count))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("arch", "score"))), lambda x: x["score"])
    without = left.groupBy("rater", "dataset", "qid").agg(scores.alias("scores")).where(F.size("scores") == len(ARCHITECTURES)).select("rater", "dataset", "qid", pair_signs(F.col("scores"), len(ARCHITECTURES)).alias("changed"))
    base = _raters(spark, sf_dir).select("rater", pair_signs(F.transform("scores", lambda x: x["score"]), len(ARCHITECTURES)).alias("signs"))
    every = base.agg(F.array_sort(F.collect_list(F.struct("rater", "signs"))).alias("all"))  # a list of the groups of papers
    merged = F.transform("all", lambda x: F.when(x["rater"] == F.col("rater"), F.col("changed")).otherwise(x["signs"]))
    taus = spread(without, "qid").withColumn("all", every.scalar()).select(median_tau(merged).alias("m"), median_tau(F.transform("all", lambda x: x["signs"])).alias("whole"))
    band = lambda t: F.when(t >= 0.67, 2).when(t >= 0.33, 1).otherwise(0)
    return taus.agg(F.count(F.lit(1)).alias("n_questions"), rounded(F.min("m")).alias("least"), rounded(F.median("m")).alias("middle"), rounded(F.max("m")).alias("greatest"), F.count_if(band(F.col("m")) != band(F.col("whole"))).alias("n_flips"))


def agreement_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median tau between the groups of each dataset side by side: the difference, both bands and whether they agree (the
    same band, or medians less than 0.15 apart)."""
    taus = kendall_pairs(spark, sf_dir).where(F.substring_index("a", "-", 1) == F.substring_index("b", "-", 1))
    medians = taus.groupBy(F.substring_index("a", "-", 1).alias("dataset")).agg(rounded(F.median("tau")).alias("median_tau"))
    band = F.when(F.col("median_tau") >= 0.67, "stable").when(F.col("median_tau") >= 0.33, "partly").otherwise("unstable")
    sides = medians.withColumn("band", band)
    x, y = [sides.select(F.col("dataset").alias(f"dataset_{c}"), F.col("median_tau").alias(f"tau_{c}"), F.col("band").alias(f"band_{c}")) for c in "ab"]
    difference = F.col("tau_a") - F.col("tau_b")
    agree = F.when(F.col("band_a") == F.col("band_b"), "same band").when(F.abs(difference) < 0.15, "near").otherwise("divergent")
    return x.join(y, F.col("dataset_a") < F.col("dataset_b")).withColumns({"difference": rounded(difference), "verdict": agree})


def jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the mean of each architecture moves when one paper is left out: least, median and greatest mean. The means
    without a paper come from sums, so that no paper meets the questions of the others."""
    sums = cells(spark, sf_dir).groupBy("dataset", "arch", "cluster").agg(F.sum("metric").alias("s"), F.count(F.lit(1)).alias("c"))
    every = sums.groupBy("dataset", "arch").agg(F.sum("s").alias("all_s"), F.sum("c").alias("all_c"))
    without = sums.join(every, ["dataset", "arch"]).where("all_c > c").withColumn("m", (F.col("all_s") - F.col("s")) / (F.col("all_c") - F.col("c")))
    return without.groupBy("dataset", "arch").agg(rounded(F.min("m")).alias("least"), rounded(F.median("m")).alias("middle"), rounded(F.max("m")).alias("greatest"))


QUERIES = {
    "question_index": question_index, "bootstrap_means": bootstrap_means, "bootstrap_intervals": bootstrap_intervals, "paired_significance": paired_significance, "kendall_pairs": kendall_pairs,
    "kendall_summary": kendall_summary, "tau_bands": tau_bands, "median_bootstrap": median_bootstrap, "permutation_test": permutation_test, "jackknife": jackknife,
    "jackknife_tau": jackknife_tau, "power": power, "agreement_by_dataset": agreement_by_dataset,
}

_CELLS = "(SELECT DISTINCT dataset, cluster, qid, arch, metric FROM scored_cells WHERE metric IS NOT NULL)"


def _hash(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT AS BIGINT)"


_INDEX = f"(SELECT dataset, cluster, row_number() OVER (PARTITION BY dataset ORDER BY cluster) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM (SELECT DISTINCT dataset, cluster FROM {_CELLS}))"
_DRAWS = f"(SELECT dataset, r, {_hash('dataset', 'r', 'slot')} % n AS i, count(*) AS times FROM (SELECT dataset, n, unnest(range(n)) AS slot FROM (SELECT DISTINCT dataset, n FROM {_INDEX})) CROSS JOIN range({RESAMPLES}) t(r) GROUP BY ALL)"


def _resampled(sums: str, by: str = "s.arch") -> str:
    return f"(SELECT s.dataset, {by}, d.r, sum(times * s) / nullif(sum(times * c), 0) AS mean FROM {sums} s JOIN {_INDEX} x USING (dataset, cluster) JOIN {_DRAWS} d ON d.dataset = s.dataset AND d.i = x.i GROUP BY ALL)"


_MEANS = _resampled(f"(SELECT dataset, cluster, arch, sum(metric) AS s, count(*) AS c FROM {_CELLS} GROUP BY ALL)")
_DIFFERENCES = _resampled(f"(SELECT a.dataset, a.cluster, f.arch AS against, a.arch, sum(f.metric - a.metric) AS s, count(*) AS c FROM {_CELLS} a JOIN {_CELLS} f ON a.dataset = f.dataset AND a.qid = f.qid AND (f.arch = 'flat' AND a.arch <> 'flat' OR f.arch = 'naive_rag' AND a.arch = 'raptor') GROUP BY ALL)", "s.against, s.arch")
_SCORES = f"""(SELECT rater, arch, score FROM (SELECT dataset || '-' || lpad(CAST({_hash('cluster')} % {GROUPS} AS VARCHAR), 2, '0') AS rater, arch, round(avg(metric) + 1e-9, 6) AS score FROM {_CELLS} GROUP BY ALL)
    QUALIFY count(*) OVER (PARTITION BY rater) = 4)"""
_RANKS = f"(SELECT rater, arch, row_number() OVER (PARTITION BY rater ORDER BY score DESC, arch) AS rank FROM {_SCORES})"
_SIGNS = f"(SELECT x.rater, x.arch || '|' || y.arch AS pair, sign(x.rank - y.rank) AS sign FROM {_RANKS} x JOIN {_RANKS} y ON x.rater = y.rater AND x.arch < y.arch)"
_TAUS = f"""(SELECT a, b, n_concordant, n_discordant, round(CASE WHEN n_concordant + n_discordant > 0 THEN (n_concordant - n_discordant) / (n_concordant + n_discordant) ELSE 0 END + 1e-9, 6) AS tau FROM (
    SELECT p.rater AS a, q.rater AS b, count(*) FILTER (p.sign * q.sign > 0) AS n_concordant, count(*) FILTER (p.sign * q.sign < 0) AS n_discordant FROM {_SIGNS} p JOIN {_SIGNS} q ON p.pair = q.pair AND p.rater < q.rater GROUP BY ALL))"""

SQL = {
    "question_index": """SELECT dataset, cluster, CAST(row_number() OVER (PARTITION BY dataset ORDER BY cluster) - 1 AS INT) AS i, count(*) OVER (PARTITION BY dataset) AS n, n_questions
        FROM (SELECT dataset, cluster, count(DISTINCT qid) AS n_questions FROM scored_cells GROUP BY ALL)""",
    "bootstrap_means": f"SELECT dataset, arch, CAST(r AS INT) AS r, round(mean + 1e-9, 6) AS mean FROM {_MEANS}",
    "bootstrap_intervals": f"SELECT dataset, arch, round(quantile_cont(mean, 0.025) + 1e-9, 6) AS low, round(quantile_cont(mean, 0.975) + 1e-9, 6) AS high, round(avg(mean) + 1e-9, 6) AS mean FROM {_MEANS} GROUP BY dataset, arch",
    "paired_significance": f"""SELECT dataset, against, arch, round(avg(mean) + 1e-9, 6) AS difference, round(quantile_cont(mean, 0.025) + 1e-9, 6) AS low, round(quantile_cont(mean, 0.975) + 1e-9, 6) AS high,
        round(least(1.0, 2 * least(avg(CASE WHEN mean > 1e-12 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN mean < -1e-12 THEN 1.0 ELSE 0.0 END))) + 1e-9, 6) AS p,
        least(1.0, 2 * least(avg(CASE WHEN mean > 1e-12 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN mean < -1e-12 THEN 1.0 ELSE 0.0 END))) < 0.05 AS significant
        FROM {_DIFFERENCES} WHERE mean IS NOT NULL GROUP BY dataset, against, arch""",
    "kendall_pairs": f"SELECT * FROM {_TAUS}",
    "kendall_summary": f"""SELECT count(*) AS n_pairs, round(median(tau) + 1e-9, 6) AS median_tau, round(avg(tau) + 1e-9, 6) AS mean_tau, round(avg(CASE WHEN tau >= 0.67 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS stable_share,
        CASE WHEN avg(CASE WHEN tau >= 0.67 THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'YES' WHEN avg(CASE WHEN tau >= 0.67 THEN 1.0 ELSE 0.0 END) <= 0.4 THEN 'NO' ELSE 'MIXED' END AS verdict FROM {_TAUS}""",
    "tau_bands": f"SELECT CASE WHEN tau >= 0.67 THEN 'stable' WHEN tau >= 0.33 THEN 'partly' ELSE 'unstable' END AS band, count(*) AS n_pairs FROM {_TAUS} GROUP BY band",
    "median_bootstrap": f"""WITH t AS (SELECT tau, row_number() OVER (ORDER BY a || '|' || b) - 1 AS i, count(*) OVER () AS n FROM {_TAUS}),
        d AS (SELECT r, {_hash("'all'", 'r', 'slot')} % n AS i FROM (SELECT n, unnest(range(n)) AS slot FROM (SELECT DISTINCT n FROM t)) CROSS JOIN range({RESAMPLES}) x(r)),
        m AS (SELECT r, median(tau) AS m FROM d JOIN t USING (i) GROUP BY r), o AS (SELECT list(m ORDER BY m) AS ms, avg(m) AS mean FROM m)
        SELECT round(ms[1 + CAST(floor(0.025 * len(ms)) AS INT)] + 1e-9, 6) AS low, round(ms[1 + CAST(floor(0.975 * len(ms)) AS INT)] + 1e-9, 6) AS high, round(mean + 1e-9, 6) AS mean FROM o""",
    "jackknife": f"""WITH s AS (SELECT dataset, arch, cluster, sum(metric) AS s, count(*) AS c FROM {_CELLS} GROUP BY ALL), e AS (SELECT dataset, arch, sum(s) AS all_s, sum(c) AS all_c FROM s GROUP BY ALL),
        w AS (SELECT dataset, arch, (all_s - s) / (all_c - c) AS m FROM s JOIN e USING (dataset, arch) WHERE all_c > c)
        SELECT dataset, arch, round(min(m) + 1e-9, 6) AS least, round(median(m) + 1e-9, 6) AS middle, round(max(m) + 1e-9, 6) AS greatest FROM w GROUP BY dataset, arch""",
    "permutation_test": f"""WITH s AS (SELECT rater, arch, score, row_number() OVER (PARTITION BY rater ORDER BY arch) AS n FROM {_SCORES}),
        p AS (SELECT k, rater, score, row_number() OVER (PARTITION BY k, rater ORDER BY CASE WHEN k = 0 THEN 0 ELSE {_hash('k', 'rater', 'arch')} END, arch) AS n FROM s CROSS JOIN range({PERMUTATIONS} + 1) t(k)),
        g AS (SELECT x.k, x.rater, x.n * 10 + y.n AS pair, CASE WHEN x.score >= y.score THEN -1 ELSE 1 END AS sign FROM p x JOIN p y ON x.k = y.k AND x.rater = y.rater AND x.n < y.n),
        u AS (SELECT a.k, a.rater, b.rater AS other, sum(a.sign * b.sign) / 6.0 AS tau FROM g a JOIN g b ON a.k = b.k AND a.pair = b.pair AND a.rater < b.rater GROUP BY ALL),
        m AS (SELECT k, round(median(tau), 9) AS m FROM u GROUP BY k), o AS (SELECT m AS observed FROM m WHERE k = 0)
        SELECT round(observed + 1e-9, 6) AS median_tau, round((count(*) FILTER (m >= observed) + 1) / (count(*) + 1) + 1e-9, 6) AS p FROM m, o WHERE k > 0 GROUP BY observed""",
    "jackknife_tau": f"""WITH c AS (SELECT *, dataset || '-' || lpad(CAST({_hash('cluster')} % {GROUPS} AS VARCHAR), 2, '0') AS rater FROM {_CELLS}),
        s AS (SELECT rater, arch, sum(metric) AS s, count(*) AS c FROM c GROUP BY ALL), q AS (SELECT rater, dataset, qid, arch, sum(metric) AS qs, count(*) AS qc FROM c GROUP BY ALL),
        l AS (SELECT d.rater, d.dataset, d.qid, s.arch, round((s.s - coalesce(q.qs, 0)) / (s.c - coalesce(q.qc, 0)) + 1e-9, 6) AS score FROM (SELECT DISTINCT rater, dataset, qid FROM q) d JOIN s USING (rater)
            LEFT JOIN q ON q.rater = d.rater AND q.dataset = d.dataset AND q.qid = d.qid AND q.arch = s.arch WHERE s.c > coalesce(q.qc, 0) QUALIFY count(*) OVER (PARTITION BY d.rater, d.dataset, d.qid) = 4),
        n AS (SELECT x.rater, x.dataset, x.qid, x.arch || '|' || y.arch AS pair, CASE WHEN x.score >= y.score THEN -1 ELSE 1 END AS sign FROM l x JOIN l y ON x.rater = y.rater AND x.dataset = y.dataset AND x.qid = y.qid AND x.arch < y.arch),
        b AS (SELECT x.rater, x.arch || '|' || y.arch AS pair, CASE WHEN x.score >= y.score THEN -1 ELSE 1 END AS sign FROM {_SCORES} x JOIN {_SCORES} y ON x.rater = y.rater AND x.arch < y.arch),
        t AS (SELECT p.rater AS a, o.rater AS b, sum(p.sign * o.sign) / 6.0 AS tau FROM b p JOIN b o ON p.pair = o.pair AND p.rater < o.rater GROUP BY ALL),
        k AS (SELECT DISTINCT rater, dataset, qid FROM n),
        u AS (SELECT k.dataset, k.qid, t.tau FROM k JOIN t ON t.a <> k.rater AND t.b <> k.rater UNION ALL
            SELECT dataset, qid, tau FROM (SELECT n.dataset, n.qid, b.rater, sum(n.sign * b.sign) / 6.0 AS tau FROM n JOIN b ON n.pair = b.pair AND b.rater <> n.rater WHERE n.rater IN (SELECT rater FROM b) GROUP BY ALL)),
        m AS (SELECT dataset, qid, round(median(tau), 9) AS m FROM u GROUP BY ALL), w AS (SELECT round(median(tau), 9) AS whole FROM t)
        SELECT count(*) AS n_questions, round(min(m) + 1e-9, 6) AS least, round(median(m) + 1e-9, 6) AS middle, round(max(m) + 1e-9, 6) AS greatest,
            count(*) FILTER ((m >= 0.67) <> (whole >= 0.67) OR (m >= 0.33) <> (whole >= 0.33)) AS n_flips FROM m, w""",
    "agreement_by_dataset": f"""WITH m AS (SELECT split_part(a, '-', 1) AS dataset, round(median(tau) + 1e-9, 6) AS t FROM {_TAUS} WHERE split_part(a, '-', 1) = split_part(b, '-', 1) GROUP BY 1),
        d AS (SELECT dataset, t, CASE WHEN t >= 0.67 THEN 'stable' WHEN t >= 0.33 THEN 'partly' ELSE 'unstable' END AS band FROM m)
        SELECT x.dataset AS dataset_a, x.t AS tau_a, x.band AS band_a, y.dataset AS dataset_b, y.t AS tau_b, y.band AS band_b, round(x.t - y.t + 1e-9, 6) AS difference,
            CASE WHEN x.band = y.band THEN 'same band' WHEN abs(x.t - y.t) < 0.15 THEN 'near' ELSE 'divergent' END AS verdict FROM d x JOIN d y ON x.dataset < y.dataset""",
}
