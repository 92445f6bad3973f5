"""Readers of JSON lines, logs and whole files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _place() -> Column:
    """The place of a line in its file: the block of the file, then the line within the task that reads the block in order."""
    return F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are left out, any bad line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, but lines that are no objects are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_resumable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same for files whose last line a crash may have torn: that line alone may be bad. A bad line that is not the last
    of its file fails the query. The place of a line is its offset in the file, so no order of rows is relied on."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), _place().alias("at")).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", T._parse_datatype_string(schema).add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    ends = lines.groupBy("file").agg(F.max("at").alias("last"))
    torn = F.col("row._bad").isNotNull()
    checked = parsed.join(ends, "file").where(~torn | F.when(F.col("at") < F.col("last"), F.raise_error(F.concat(F.lit("bad line inside "), F.col("file")))).otherwise(False).cast("boolean"))
    return checked.select("row.*").drop("_bad")


def glued_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that may hold several on one line; pieces that are no object come out with malformed = true.

    Strings are matched as wholes, so that braces in them end nothing: an object ends where as many braces have closed as
    were opened before and another begins, or its line ends."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    marks = F.regexp_extract_all("value", F.lit(r'("(?:[^"\\]|\\.)*"?|[{}]|[^{}"]+)'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(state: Column, mark: Column) -> Column:
        depth = state["depth"] + F.when(mark == "{", 1).when((mark == "}") & (state["depth"] > 0), -1).otherwise(0)
        text = F.concat(state["open"], mark)
        ended = (depth == 0) & (mark == "}")
        return F.struct(depth.alias("depth"), F.when(ended, F.lit("")).otherwise(text).alias("open"), F.when(ended, F.concat(state["done"], F.array(text))).otherwise(state["done"]).alias("done"))

    split = F.aggregate(marks, start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["open"])), lambda x: F.trim(x) != ""))
    pieces = lines.select(F.explode(split).alias("piece"))
    parsed = pieces.withColumn("row", F.from_json("piece", T._parse_datatype_string(schema).add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    return parsed.select("row.*", F.col("row._bad").isNotNull().alias("malformed")).drop("_bad")


def tail(rows: DataFrame, column: str, after: int) -> DataFrame:
    """Rows beyond a mark that was saved."""
    return rows.where(F.col(column) > after)


def appended(spark: SparkSession, path: str, schema: str, saved: str) -> DataFrame:
    """Rows of the files of JSON lines that came under path since the last call with the same folder `saved`, which holds the
    files read so far; a file that a lost job had begun is read again as a whole. Its rows are kept under `saved` too."""
    stream = spark.readStream.schema(schema).json(path)
    target = f"{saved}/batch-{uuid.uuid4().hex}"
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{saved}/offsets").foreachBatch(lambda batch, _: batch.write.mode("append").parquet(target)).start()
    query.awaitTermination()
    try:
        return spark.read.schema(schema).parquet(target)
    except Exception as error:  # nothing new
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def since(rows: DataFrame, time: Column, floor: str) -> DataFrame:
    """Rows whose time is the floor (an ISO date or time) or later; those without a time are left out."""
    return rows.where(time >= F.to_timestamp(F.lit(floor)))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """name (without folder and ending) and text of each file."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("name"), F.col("value").alias("text"))


def log_ids(spark: SparkSession, path: str, pattern: str, first: bool = False) -> DataFrame:
    """name and id: what the first group of pattern says in the last (or first) line of each log that has it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), _place().alias("at"))
    found = lines.withColumn("id", F.regexp_extract("value", pattern, 1)).where(F.col("id") != "")
    pick = F.min_by if first else F.max_by
    return found.groupBy(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name")).agg(pick("id", "at").alias("id"))


def truth_maps(text: Column) -> Column:
    """Pairs of key and T/F string in a log text, as an array of structs: small letters in the key, T and F only."""
    found = F.regexp_extract_all(text, F.lit(r'"([a-z]+)":\s*"([TF]+)"'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r'"([a-z]+)":\s*"([TF]+)"'), F.lit(2))
    return F.arrays_zip(found.alias("key"), values.alias("letters"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last by order (a list of expressions, the most important first)."""
    every = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(every, F.struct(*order)).alias("row")).select("row.*")


def flat_config(tree: dict, prefix: str = "") -> list[tuple[str, str | None, str | None]]:
    """(path, value, source) of the leaves of a configuration; a leaf is a scalar or a block of value and source."""
    out: list[tuple[str, str | None, str | None]] = []
    for key, node in tree.items():
        path = f"{prefix}.{key}" if prefix else str(key)
        if isinstance(node, dict) and "value" in node:
            out.append((path, None if node["value"] is None else str(node["value"]), node.get("source")))
        elif isinstance(node, dict):
            out += flat_config(node, path)
        else:
            out.append((path, None if node is None else str(node), None))
    return out


def without_source(config: DataFrame, prefixes: list[str]) -> DataFrame:
    """Leaves (path, value, source) whose source is missing or begins with none of the prefixes."""
    fine = F.lit(False)
    for p in prefixes:
        fine = fine | F.col("source").startswith(p)
    return config.where(~F.coalesce(fine, F.lit(False)))
