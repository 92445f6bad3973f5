"""The ledger as a stream: new files of JSON lines are read once, repeated calls are dropped, token sums stay current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from docmeter.schemas import LEDGER
from docmeter.sources.writers import append_new

#: A call is late if it arrives so many days behind the newest one that has landed.
LATE_DAYS = 2


def ledger_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Calls that arrive as JSON lines under path, copies and late ones included; land() sees to them."""
    return spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_per_batch).json(path)


def hourly_tokens(calls: DataFrame) -> DataFrame:
    """Sound calls and tokens by hour of arrival, architecture and stage."""
    sound = calls.where(~F.col("failed"))
    return sound.groupBy(F.window("received_at", "1 hour").alias("hour"), "architecture", "stage").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum(F.coalesce("uncached_input_tokens", F.lit(0))).alias("uncached_input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )


def land(calls: DataFrame, path: str, checkpoint: str, late_days: int = LATE_DAYS) -> StreamingQuery:
    """Append each call once to the Parquet table `path`/calls, or to `path`/late if it arrives late_days behind the newest
    call that has landed. No call is dropped for being late, and a copy is dropped however late it is, as the keys of both
    tables are looked up. A batch that is run again after a loss appends nothing twice, a restart goes on where the
    checkpoint stands, and the query ends when all files that are there have been read."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["call_id"]).persist()
        try:
            on_time, late = f"{path}/calls", f"{path}/late"
            known = [spark.read.parquet(p) for p in (on_time, late) if _there(spark, p)]
            fresh = batch
            for table in known:
                fresh = fresh.join(table.select("call_id"), "call_id", "left_anti")
            newest = known[0].agg(F.max("received_at")).first()[0] if _there(spark, on_time) else None
            behind = F.coalesce(F.col("received_at") < F.lit(newest) - F.expr(f"INTERVAL {late_days} DAYS"), F.lit(False)) if newest is not None else F.lit(False)
            append_new(fresh.where(~behind), on_time, ["call_id"])
            append_new(fresh.where(behind), late, ["call_id"])
        finally:
            batch.unpersist()

    return calls.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return False
