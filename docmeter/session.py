"""Session helpers: tables, checkpoints and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "docmeter", cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> str:
    """Send this package to the executors as a zip, for sessions that were started without it on their path; the zip's path."""
    here = os.path.dirname(os.path.abspath(__file__))
    name = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="docmeter-"), "docmeter"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(name)
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table, with only the columns named (all if none are)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It comes from spark.checkpoint.dir; only where that is unset (a local
    session, as in tests) a folder of this machine is made and set."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _set_here.get(spark.sparkContext.applicationId)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(known)
        _set_here[spark.sparkContext.applicationId] = known
    return known


_set_here: dict[str, str] = {}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by hash of keys (by turns without any) to a given number of partitions, for rows that are much work however
    few bytes they are: adaptive execution leaves a stated number as it is."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


#: Rows of a table that bounded() lets be broadcast.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast in a join if it has been counted to have no more than so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as a Parquet table to the shared folder and read back: like cut(), but columnar, so that later
    jobs read only the columns they need."""
    path = os.path.join(shared_dir(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
