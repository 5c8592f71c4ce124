"""Table storage: Parquet datasets partitioned by season, with a catalog of writes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frames import conform, keep_last
from ..schemas import table

CATALOG = table("dataset:string status:string rows:long seconds:double years:string saved_at:timestamp")
CATALOG_KEY = "_catalog"


def table_path(root: str, key: str) -> str:
    return f"{root.rstrip('/')}/{key}"


def read_table(spark: SparkSession, root: str, key: str, schema: T.StructType | None = None) -> DataFrame | None:
    """Dataset ``key`` below ``root``; absent: an empty frame of ``schema``, or None without one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        out = reader.parquet(table_path(root, key))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None if schema is None else spark.createDataFrame([], schema)
    if schema is not None:
        return out
    if "game_date" in out.columns and not isinstance(out.schema["game_date"].dataType, T.DateType):
        out = out.withColumn("game_date", F.col("game_date").cast("timestamp").cast("date"))
    return out


def write_table(df: DataFrame, root: str, key: str, partition: str | None = "season") -> None:
    """Overwrite the partitions present in ``df``; the commit protocol makes each write all-or-nothing.

    The rebalance hint gathers a partition's rows into few files and splits an oversized
    partition over several tasks.
    """
    parts = [partition] if partition and partition in df.columns else []
    out = df.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(*parts) if parts else out).parquet(table_path(root, key))


def record(spark: SparkSession, root: str, dataset: str, status: str, rows: int, seconds: float, years: Sequence[int], now: Column) -> None:
    """Append one line to the catalog (status: cached, pulled or error)."""
    row = spark.createDataFrame([(dataset, status, rows, seconds, ",".join(map(str, years)))], "dataset string, status string, rows long, seconds double, years string")
    row.withColumn("saved_at", now).write.mode("append").parquet(table_path(root, CATALOG_KEY))


def table_meta(spark: SparkSession, root: str) -> DataFrame:
    """Latest catalog line per dataset."""
    lines = read_table(spark, root, CATALOG_KEY, CATALOG)
    return keep_last(lines, ["dataset"], [F.col("saved_at").desc()])


def load_audit(spark: SparkSession, root: str) -> DataFrame:
    """Loads per dataset and status with rows and time."""
    lines = read_table(spark, root, CATALOG_KEY, CATALOG)
    return lines.groupBy("dataset", "status").agg(
        F.count(F.lit(1)).alias("loads"), F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"),
        F.max("saved_at").alias("last_saved"),
    )


def list_tables(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Datasets below ``root`` with file count, bytes and newest file time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:"))
    inside = F.regexp_replace(F.col("path"), f"^.*?{base}/", "")
    key = F.regexp_replace(F.regexp_replace(inside, r"/[^/]*$", ""), r"/[^/=]+=[^/]*", "")
    return (
        files.select(key.alias("key"), "modificationTime", "length")
        .filter(F.startswith("key", F.lit(prefix)) & ~F.startswith("key", F.lit("_")))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("last_updated"))
    )


def exists(spark: SparkSession, root: str, key: str) -> bool:
    return read_table(spark, root, key) is not None


def load_seasons(df: DataFrame, seasons: Sequence[int], column: str = "season") -> DataFrame:
    """Rows of the given seasons; on a season-partitioned dataset other partitions are not read."""
    return df.filter(F.col(column).isin(list(seasons)))


def newest_date(df: DataFrame, dataset: str, column: str = "game_date") -> DataFrame:
    return df.agg(F.max(column).alias("newest"), F.count(F.lit(1)).alias("n")).select(F.lit(dataset).alias("dataset"), "newest", "n")


def high_water_mark(df: DataFrame, keys: Sequence[str] = (), column: str = "game_date") -> DataFrame:
    """Last loaded date and the first one still to load."""
    return df.groupBy(*keys).agg(F.max(column).alias("last_date")).withColumn("next_start", F.date_add("last_date", 1))


def merge_new(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two loads, one row per key; the newer load wins, and within it the last row by content."""
    both = base.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_load").desc(), F.xxhash64(*[c for c in base.columns if c not in keys]).desc()]
    return keep_last(both, keys, order).drop("_load")


def incremental_append(spark: SparkSession, root: str, key: str, new: DataFrame, keys: Sequence[str], partition: str = "season") -> None:
    """Upsert ``new`` into a dataset, rewriting only the seasons it touches.

    The touched seasons are read back from a written copy, because a dataset cannot be
    overwritten while it is being read.
    """
    from ..session import checkpointed

    base = read_table(spark, root, key)
    if base is None:
        merged = merge_new(new.limit(0), new, keys)
    else:
        touched = [r[0] for r in new.select(partition).distinct().collect()]  # a few seasons
        merged = merge_new(conform(base.filter(F.col(partition).isin(touched)), new.schema), new, keys)
    write_table(checkpointed(merged), root, key, partition)


def materialize(spark: SparkSession, root: str, key: str, build, force: bool = False) -> DataFrame:
    """A stored view: read it when present, else build and write it once."""
    stored = None if force else read_table(spark, root, key)
    if stored is None:
        write_table(build(), root, key, partition=None)
        stored = read_table(spark, root, key)
    return stored


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run id (lexicographic) per model type."""
    return runs.groupBy("model_type").agg(F.max("run_id").alias("run_id"))


def qualified_ids(pitches: DataFrame, min_rows: int = 50) -> DataFrame:
    """Batters with at least ``min_rows`` rows who never pitched (rows are pitches, as counted upstream)."""
    many = pitches.filter(F.col("batter").isNotNull()).groupBy(F.col("batter").alias("player_id")).agg(F.count(F.lit(1)).alias("n"))
    arms = pitches.select(F.col("pitcher").alias("player_id")).distinct()
    return many.filter(F.col("n") >= min_rows).join(arms, "player_id", "left_anti")
