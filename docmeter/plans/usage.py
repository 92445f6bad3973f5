"""Queries over the ledger: token sums, failures, times, attribution of calls to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docmeter.operators.ordered import next_known, numbered, running_total
from docmeter.session import table
from docmeter.sources.readers import since

TOKENS = ["uncached_input_tokens", "cached_input_tokens", "output_tokens"]
STAGES = ["preprocess", "retrieval", "generate"]
DATE_FLOOR = "2026-04-01"


def calls(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each call once. Copies agree in all columns but received_at, so a distinct over the columns needed is enough."""
    return table(spark, sf_dir, "ledger", "call_id", *columns).distinct()


def parsed_time(text: Column) -> Column:
    """A time in ISO form (with zone) or in the compact form; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")))


def _deployment(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Calls of run 0; a call without a run belongs to it."""
    return calls(spark, sf_dir, *columns, "run_index", "failed").where(F.coalesce("run_index", F.lit(0)) == 0)


def _sums() -> list[Column]:
    sound = ~F.col("failed")
    return [F.count_if(sound).alias("n_calls"), F.count_if("failed").alias("n_failed"), *[F.coalesce(F.sum(F.when(sound, F.col(c))), F.lit(0)).alias(c) for c in TOKENS]]


def tokens_by_arch_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deployment(spark, sf_dir, "architecture", "stage", *TOKENS).groupBy("architecture", "stage").agg(*_sums())


def tokens_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with subtotals per architecture and in total; level tells them apart (0, 1, 3)."""
    rolled = _deployment(spark, sf_dir, "architecture", "stage", *TOKENS).rollup("architecture", "stage")
    return rolled.agg(F.grouping_id().cast("int").alias("level"), *_sums())


def calls_stage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = _deployment(spark, sf_dir, "architecture", "stage").where(~F.col("failed"))
    return sound.groupBy("architecture").pivot("stage", STAGES).agg(F.count(F.lit(1))).na.fill(0, STAGES)


def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed calls by stage and by the first word of the reason."""
    kind = F.regexp_extract("failure_reason", r"^([A-Za-z_]+)", 1)
    return calls(spark, sf_dir, "stage", "failed", "failure_reason").where("failed").groupBy("stage", F.coalesce(kind, F.lit("")).alias("kind")).agg(F.count(F.lit(1)).alias("n_calls"))


def embedding_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and seconds of the embedding models per architecture."""
    rows = calls(spark, sf_dir, "architecture", "model", "uncached_input_tokens", "wallclock_s").where(F.col("model").startswith("embed"))
    return rows.groupBy("architecture", "model").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("uncached_input_tokens").alias("tokens"), F.round(F.sum("wallclock_s"), 3).alias("seconds"))


def build_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input, output and seconds of the build of each architecture and paper in run 0."""
    rows = _deployment(spark, sf_dir, "architecture", "paper_id", "stage", *TOKENS, "wallclock_s", "gpu_s_estimate").where(F.col("stage") == "preprocess")
    total = F.coalesce("uncached_input_tokens", F.lit(0)) + F.coalesce("cached_input_tokens", F.lit(0))
    return rows.groupBy("architecture", "paper_id").agg(
        F.sum(total).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.round(F.sum("gpu_s_estimate"), 3).alias("gpu_s"), F.round(F.sum("wallclock_s"), 3).alias("wall_s"),
    )


def longest_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most uncached tokens of a flat call per paper."""
    return table(spark, sf_dir, "ledger", "paper_id", "architecture", "uncached_input_tokens").where((F.col("architecture") == "flat") & F.col("paper_id").isNotNull()).groupBy("paper_id").agg(F.max("uncached_input_tokens").alias("most_tokens"))


def calls_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir, "timestamp", "architecture")
    return rows.groupBy(F.date_format(parsed_time(F.col("timestamp")), "yyyy-MM-dd").alias("day"), "architecture").agg(F.count(F.lit(1)).alias("n_calls"))


def late_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows received more than a day after their time, and copies, per architecture."""
    rows = table(spark, sf_dir, "ledger", "call_id", "architecture", "timestamp", "received_at")
    late = F.unix_timestamp("received_at") - F.unix_timestamp(parsed_time(F.col("timestamp"))) > 86_400
    per_call = rows.groupBy("call_id", "architecture").agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"))
    return per_call.groupBy("architecture").agg(F.sum("n").alias("n_rows"), F.sum("late").alias("n_late"), F.sum(F.col("n") - 1).alias("n_copies"))


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time at which each call last arrived, of calls that arrived more than once."""
    rows = table(spark, sf_dir, "ledger", "call_id", "received_at")
    return rows.groupBy("call_id").agg(F.max("received_at").alias("received_at"), F.count(F.lit(1)).alias("n")).where("n > 1").select("call_id", "n", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deployment(spark, sf_dir, "architecture", "paper_id", "stage", "uncached_input_tokens")


def ordinal_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th sound generate call of an architecture in run 0 beside its i-th prediction in run 0, in the order of ids: how
    many of the pairs name the same paper."""
    generated = numbered(_ordered(spark, sf_dir).where((F.col("stage") == "generate") & ~F.col("failed")).select("architecture", "call_id", "paper_id"), ["architecture"], ["call_id"])
    keys = ["question_id", "paper_id"]
    rows = table(spark, sf_dir, "predictions", "arch", "run_index", *keys).where("run_index = 0").select(F.col("arch").alias("architecture"), *keys).distinct()
    predicted = numbered(rows, ["architecture"], keys).select("architecture", "n", F.col("paper_id").alias("predicted_paper"))
    pairs = generated.join(predicted, ["architecture", "n"])
    return pairs.groupBy("architecture").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("paper_id") == F.col("predicted_paper")).alias("n_same"))


def forward_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of preprocess and retrieval calls of run 0, charged to the paper of the architecture's next generate call; calls
    after the last one are left out."""
    charged = next_known(_ordered(spark, sf_dir), ["architecture"], ["call_id"], F.when(F.col("stage") == "generate", F.col("paper_id")), "charged_to")
    rows = charged.where(F.col("stage").isin("preprocess", "retrieval") & ~F.col("failed") & F.col("charged_to").isNotNull())
    return rows.groupBy("architecture", "charged_to", "stage").agg(F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("uncached_input_tokens"), F.lit(0)).alias("tokens"))


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of consecutive failures of each architecture, in the order of calls, by length."""
    rows = calls(spark, sf_dir, "architecture", "failed")
    islands = running_total(rows, ["architecture"], ["call_id"], (~F.col("failed")).cast("int"), "island").where("failed")
    lengths = islands.groupBy("architecture", "island").agg(F.count(F.lit(1)).alias("length"))
    return lengths.groupBy("architecture", "length").agg(F.count(F.lit(1)).alias("n_streaks"))


def replayed_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprocess calls of run 0 of papers that a later run answered without a build of its own, as rows of that run: what
    a replay of the stored build adds."""
    rows = calls(spark, sf_dir, "architecture", "paper_id", "stage", "run_index", "failed").where(F.col("paper_id").isNotNull() & F.col("run_index").isNotNull())
    built = rows.where((F.col("stage") == "preprocess") & (F.col("run_index") == 0) & ~F.col("failed")).select("architecture", "paper_id", "call_id")
    own = rows.where(F.col("stage") == "preprocess").select("architecture", "paper_id", "run_index").distinct()
    later = rows.where((F.col("stage") == "generate") & (F.col("run_index") > 0)).select("architecture", "paper_id", "run_index").distinct()
    missing = later.join(own, ["architecture", "paper_id", "run_index"], "left_anti")
    return built.join(missing, ["architecture", "paper_id"]).groupBy("architecture", "run_index").agg(F.count(F.lit(1)).alias("n_replayed"), F.count_distinct("paper_id").alias("n_papers"))


def prompt_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that repeat the prompt of an earlier call of the same model: how many there are, how many took at most 0.4 of the
    time of the one before, and how many had 0.9 of its input from the cache."""
    rows = calls(spark, sf_dir, "model", "prompt_hash", "uncached_input_tokens", "cached_input_tokens", "wallclock_s").where(F.col("prompt_hash").isNotNull())
    before = Window.partitionBy("model", "prompt_hash").orderBy("call_id")
    pairs = rows.withColumns({"w": F.lag("wallclock_s").over(before), "i": F.lag("uncached_input_tokens").over(before), "n": F.row_number().over(before)}).where("n > 1")
    return pairs.groupBy("model").agg(F.count(F.lit(1)).alias("n_repeats"), F.count_if(F.col("wallclock_s") <= 0.4 * F.col("w")).alias("n_fast"), F.count_if((F.col("i") > 0) & (F.col("cached_input_tokens") >= 0.9 * F.col("i"))).alias("n_cached"))


def speed_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a second of sound calls by model and size of the input (powers of ten)."""
    total = F.coalesce("uncached_input_tokens", F.lit(0)) + F.coalesce("cached_input_tokens", F.lit(0))
    rows = calls(spark, sf_dir, "model", "uncached_input_tokens", "cached_input_tokens", "wallclock_s", "failed").where(~F.col("failed")).select("model", total.alias("tokens"), "wallclock_s").where("tokens > 0 AND wallclock_s > 0")
    return rows.groupBy("model", F.length(F.col("tokens").cast("string")).alias("digits")).agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.sum("tokens") / F.sum("wallclock_s"), 3).alias("tokens_per_s"))


def recent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and output tokens of each architecture from DATE_FLOOR on; calls without a time are left out."""
    rows = calls(spark, sf_dir, "architecture", "timestamp", "output_tokens")
    return since(rows, parsed_time(F.col("timestamp")), DATE_FLOOR).groupBy("architecture").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("output_tokens").alias("output_tokens"))


QUERIES = {
    "recent_calls": recent_calls,
    "prompt_reuse": prompt_reuse, "speed_by_size": speed_by_size,
    "tokens_by_arch_stage": tokens_by_arch_stage, "tokens_rollup": tokens_rollup, "calls_stage_pivot": calls_stage_pivot, "failure_kinds": failure_kinds,
    "embedding_volume": embedding_volume, "build_totals": build_totals, "longest_context": longest_context, "calls_per_day": calls_per_day, "late_calls": late_calls,
    "latest_rows": latest_rows, "ordinal_attribution": ordinal_attribution, "forward_attribution": forward_attribution, "failure_streaks": failure_streaks, "replayed_builds": replayed_builds,
}

_SUMS = """count(*) FILTER (NOT failed) AS n_calls, count(*) FILTER (failed) AS n_failed,
       CAST(coalesce(sum(uncached_input_tokens) FILTER (NOT failed), 0) AS BIGINT) AS uncached_input_tokens,
       CAST(coalesce(sum(cached_input_tokens) FILTER (NOT failed), 0) AS BIGINT) AS cached_input_tokens,
       CAST(coalesce(sum(output_tokens) FILTER (NOT failed), 0) AS BIGINT) AS output_tokens"""
_RUN0 = "(SELECT DISTINCT call_id, architecture, paper_id, stage, model, failed, uncached_input_tokens, cached_input_tokens, output_tokens, wallclock_s, gpu_s_estimate FROM ledger WHERE coalesce(run_index, 0) = 0)"
_TIME = "coalesce(try_cast(CASE WHEN timestamp LIKE '%-%' THEN timestamp END AS TIMESTAMPTZ) AT TIME ZONE 'UTC', try_strptime(timestamp, '%Y%m%dT%H%M%SZ'))"

SQL = {
    "prompt_reuse": """WITH p AS (SELECT *, lag(wallclock_s) OVER w AS lw, lag(uncached_input_tokens) OVER w AS li, row_number() OVER w AS n FROM (
            SELECT DISTINCT call_id, model, prompt_hash, uncached_input_tokens, cached_input_tokens, wallclock_s FROM ledger WHERE prompt_hash IS NOT NULL) WINDOW w AS (PARTITION BY model, prompt_hash ORDER BY call_id))
        SELECT model, count(*) AS n_repeats, count(*) FILTER (wallclock_s <= 0.4::DOUBLE * lw) AS n_fast, count(*) FILTER (li > 0 AND cached_input_tokens >= 0.9::DOUBLE * li) AS n_cached FROM p WHERE n > 1 GROUP BY model""",
    "speed_by_size": """SELECT model, length(CAST(tokens AS VARCHAR)) AS digits, count(*) AS n_calls, round(sum(tokens) / sum(wallclock_s), 3) AS tokens_per_s FROM (
            SELECT model, coalesce(uncached_input_tokens, 0) + coalesce(cached_input_tokens, 0) AS tokens, wallclock_s FROM (SELECT DISTINCT call_id, model, uncached_input_tokens, cached_input_tokens, wallclock_s, failed FROM ledger) WHERE NOT failed)
        WHERE tokens > 0 AND wallclock_s > 0 GROUP BY ALL""",
    "tokens_by_arch_stage": f"SELECT architecture, stage, {_SUMS} FROM {_RUN0} GROUP BY architecture, stage",
    "tokens_rollup": f"SELECT architecture, stage, CAST(GROUPING(architecture, stage) AS INT) AS level, {_SUMS} FROM {_RUN0} GROUP BY ROLLUP (architecture, stage)",
    "calls_stage_pivot": f"""SELECT architecture, count(*) FILTER (stage = 'preprocess') AS preprocess, count(*) FILTER (stage = 'retrieval') AS retrieval, count(*) FILTER (stage = 'generate') AS generate
        FROM {_RUN0} WHERE NOT failed GROUP BY architecture""",
    "failure_kinds": """SELECT stage, coalesce(regexp_extract(failure_reason, '^([A-Za-z_]+)', 1), '') AS kind, count(*) AS n_calls
        FROM (SELECT DISTINCT call_id, stage, failed, failure_reason FROM ledger) WHERE failed GROUP BY ALL""",
    "embedding_volume": """SELECT architecture, model, count(*) AS n_calls, CAST(sum(uncached_input_tokens) AS BIGINT) AS tokens, round(sum(wallclock_s), 3) AS seconds
        FROM (SELECT DISTINCT call_id, architecture, model, uncached_input_tokens, wallclock_s FROM ledger) WHERE model LIKE 'embed%' GROUP BY architecture, model""",
    "build_totals": f"""SELECT architecture, paper_id, CAST(sum(coalesce(uncached_input_tokens, 0) + coalesce(cached_input_tokens, 0)) AS BIGINT) AS input_tokens,
        CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, round(sum(gpu_s_estimate), 3) AS gpu_s, round(sum(wallclock_s), 3) AS wall_s
        FROM {_RUN0} WHERE stage = 'preprocess' GROUP BY architecture, paper_id""",
    "longest_context": "SELECT paper_id, max(uncached_input_tokens) AS most_tokens FROM ledger WHERE architecture = 'flat' AND paper_id IS NOT NULL GROUP BY paper_id",
    "recent_calls": f"SELECT architecture, count(*) AS n_calls, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM (SELECT DISTINCT call_id, timestamp, architecture, output_tokens FROM ledger) WHERE {_TIME} >= TIMESTAMP '{DATE_FLOOR}' GROUP BY architecture",
    "calls_per_day": f"SELECT strftime({_TIME}, '%Y-%m-%d') AS day, architecture, count(*) AS n_calls FROM (SELECT DISTINCT call_id, timestamp, architecture FROM ledger) GROUP BY ALL",
    "late_calls": f"""SELECT architecture, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(late) AS BIGINT) AS n_late, CAST(sum(n - 1) AS BIGINT) AS n_copies FROM (
        SELECT call_id, architecture, count(*) AS n, count(*) FILTER (floor(epoch(received_at)) - floor(epoch({_TIME})) > 86400) AS late FROM ledger GROUP BY ALL) GROUP BY architecture""",
    "latest_rows": "SELECT call_id, count(*) AS n, strftime(max(received_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS received_at FROM ledger GROUP BY call_id HAVING count(*) > 1",
    "ordinal_attribution": f"""WITH g AS (SELECT architecture, paper_id, row_number() OVER (PARTITION BY architecture ORDER BY call_id) AS n FROM {_RUN0} WHERE stage = 'generate' AND NOT failed),
        p AS (SELECT arch AS architecture, paper_id, row_number() OVER (PARTITION BY arch ORDER BY question_id NULLS FIRST, paper_id NULLS FIRST) AS n FROM (SELECT DISTINCT arch, question_id, paper_id FROM predictions WHERE run_index = 0))
        SELECT g.architecture, count(*) AS n_pairs, count(*) FILTER (g.paper_id = p.paper_id) AS n_same FROM g JOIN p USING (architecture, n) GROUP BY g.architecture""",
    "forward_attribution": f"""WITH f AS (SELECT *, first_value(CASE WHEN stage = 'generate' THEN paper_id END IGNORE NULLS) OVER (PARTITION BY architecture ORDER BY call_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS charged_to FROM {_RUN0})
        SELECT architecture, charged_to, stage, count(*) AS n_calls, CAST(coalesce(sum(uncached_input_tokens), 0) AS BIGINT) AS tokens FROM f
        WHERE stage IN ('preprocess', 'retrieval') AND NOT failed AND charged_to IS NOT NULL GROUP BY ALL""",
    "failure_streaks": """WITH i AS (SELECT architecture, failed, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY architecture ORDER BY call_id) AS island FROM (SELECT DISTINCT call_id, architecture, failed FROM ledger)),
        l AS (SELECT architecture, island, count(*) AS length FROM i WHERE failed GROUP BY ALL)
        SELECT architecture, length, count(*) AS n_streaks FROM l GROUP BY ALL""",
    "replayed_builds": """WITH r AS (SELECT DISTINCT call_id, architecture, paper_id, stage, run_index, failed FROM ledger WHERE paper_id IS NOT NULL AND run_index IS NOT NULL),
        later AS (SELECT DISTINCT architecture, paper_id, run_index FROM r WHERE stage = 'generate' AND run_index > 0 EXCEPT SELECT architecture, paper_id, run_index FROM r WHERE stage = 'preprocess')
        SELECT b.architecture, l.run_index, count(*) AS n_replayed, count(DISTINCT b.paper_id) AS n_papers FROM r b JOIN later l USING (architecture, paper_id)
        WHERE b.stage = 'preprocess' AND b.run_index = 0 AND NOT b.failed GROUP BY b.architecture, l.run_index""",
}
