"""Writers: idempotent appends, replacements, stored calls, review sheets, fixed-width tables."""

from __future__ import annotations

import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the table at path does not have yet, each key once; the number of rows appended. Running
    it again appends nothing, so a retry after a lost job is safe."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    known = _read(spark, path)
    if known is not None:
        fresh = fresh.join(known.select(*keys), keys, "left_anti")
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n or known is None:
            fresh.write.mode("append").parquet(path)
        return n
    finally:
        fresh.unpersist()


def upsert(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Merge rows into the replaceable table at path (see replace()): a row of the same keys takes the place of the old one."""
    known = current(rows.sparkSession, path)
    fresh = rows.dropDuplicates(keys)
    replace(fresh if known is None else known.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh), path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def replace(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the table at path, of which current() shows the old or the new rows and nothing between.

    Every replacement is a version of its own beside the others; it counts once its name is appended to the list of
    versions. A job that is lost before leaves the old version in place."""
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    writer = rows.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data/{name}")
    _point(spark, path, name)


def _point(spark: SparkSession, path: str, name: str) -> None:
    listed = _read(spark, f"{path}/versions")
    last = 0 if listed is None else listed.agg(F.max("n")).first()[0]
    spark.range(1).select((F.col("id") + last + 1).alias("n"), F.lit(name).alias("name")).write.mode("append").parquet(f"{path}/versions")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that the last replace() of path wrote; None before the first."""
    listed = _read(spark, f"{path}/versions")
    if listed is None:
        return None
    return spark.read.parquet(f"{path}/data/{listed.agg(F.max_by('name', 'n')).first()[0]}")


def stored_call_key(*parts: str):
    """The key of a stored call: a digest of its parts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def put_calls(answered: DataFrame, path: str, parts: list[str], response: str = "response") -> int:
    """Store the responses of calls under the digest of their parts; keys that are stored, and null responses, are left
    out. The number of responses stored; a retry stores none."""
    rows = answered.where(F.col(response).isNotNull()).select(stored_call_key(*parts).alias("key"), F.col(response).alias("response"))
    return append_new(rows, path, ["key"])


def get_calls(wanted: DataFrame, path: str, parts: list[str], response: str = "response") -> DataFrame:
    """wanted with the stored response of each row's call, null for a miss; without a table every row is a miss."""
    known = _read(wanted.sparkSession, path)
    if known is None:
        return wanted.withColumn(response, F.lit(None).cast("string"))
    once = known.groupBy("key").agg(F.min("response").alias(response))
    return wanted.withColumn("key__", stored_call_key(*parts)).join(once.withColumnRenamed("key", "key__"), "key__", "left").drop("key__")


STATE = ["architecture", "paper_id", "key_hash"]


def put_states(rows: DataFrame, path: str) -> None:
    """Store the rows of built states (STATE and further columns), then how many rows each has, which makes it count. A
    state that is stored already is replaced as a whole."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*STATE).parquet(f"{path}/rows")
    counts = rows.groupBy(*STATE).agg(F.count(F.lit(1)).alias("n_rows"))
    known = current(spark, f"{path}/counts")
    replace(counts if known is None else known.join(counts.select(*STATE), STATE, "left_anti").unionByName(counts), f"{path}/counts")


def get_states(wanted: DataFrame, path: str) -> DataFrame | None:
    """The rows of the wanted states (STATE) that are stored whole; one of which a part is missing is a miss. None before
    the first is stored."""
    counts, rows = current(wanted.sparkSession, f"{path}/counts"), _read(wanted.sparkSession, f"{path}/rows")
    if counts is None or rows is None:
        return None
    typed = rows.withColumns({c: F.col(c).cast("string") for c in STATE}).join(wanted.select(*STATE).distinct(), STATE, "left_semi")
    whole = typed.groupBy(*STATE).agg(F.count(F.lit(1)).alias("n_rows")).join(counts, [*STATE, "n_rows"], "left_semi")
    return typed.join(whole.select(*STATE), STATE, "left_semi")


def review_sheet(rows: DataFrame, path: str) -> None:
    """A CSV with a header, in as many files as rows has partitions."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def fixed_width(rows: DataFrame) -> DataFrame:
    """rows with every column as text, padded to the widest value of the column or its name."""
    texts = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    widths = texts.agg(F.struct(*[F.max(F.greatest(F.length(c), F.lit(len(c)))).alias(c) for c in rows.columns])).scalar()
    return texts.withColumn("w__", widths).select(*[F.rpad(F.col(c), F.col("w__")[c], F.lit(" ")).alias(c) for c in rows.columns])


def submission_zip(lists: DataFrame, path: str) -> int:
    """Write the submission (a JSON map of novel to letters) to a zip; lists has paper_id and letters, one row per novel of
    the leaderboard, a fixed set. The number of novels."""
    import json

    rows = {r["paper_id"]: list(r["letters"]) for r in lists.select("paper_id", "letters").toLocalIterator()}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("res_mc.json", json.dumps(rows, sort_keys=True))
    return len(rows)
