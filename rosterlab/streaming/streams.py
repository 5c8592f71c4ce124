"""Structured Streaming jobs over landed events.

Sources are file streams, sinks are Parquet folders written once per micro-batch id, so a
replayed batch overwrites itself. Each job runs until the available files are consumed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frames import keep_last
from ..session import new_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = "_batch"


def read_stream(spark: SparkSession, path: str, time: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """File stream with the schema of the files present; ``time`` becomes a zoned timestamp, as watermarks need."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    out = reader.parquet(path)
    return out if time is None else out.withColumn(time, F.col(time).cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append", out: str | None = None, each: Callable[[DataFrame, int], None] | None = None, progress: list | None = None) -> str:
    """Run a stream over the available data into a folder with one subfolder per batch; returns the folder. ``progress`` gets Spark's reports."""
    spark = stream.sparkSession
    out = out or new_dir(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        if each is not None:
            each(batch, number)
        batch.write.mode("overwrite").parquet(f"{out}/data/{BATCH}={number}")

    job = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    if progress is not None:
        progress += [p for p in job.recentProgress]
    return out


def read_batches(spark: SparkSession, out: str, schema) -> DataFrame:
    """Everything a drained stream wrote, with its batch number."""
    return spark.read.schema(schema.add(BATCH, "long") if BATCH not in schema.fieldNames() else schema).option("basePath", f"{out}/data").parquet(f"{out}/data")


def latest_state(spark: SparkSession, out: str, schema, keys: Sequence[str]) -> DataFrame:
    """Final value per key of an update-mode stream: the row of the last batch that touched it."""
    rows = read_batches(spark, out, schema)
    return keep_last(rows, keys, [F.col(BATCH).desc()]).drop(BATCH)


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Drop re-deliveries of a key that arrive within ``delay`` of each other."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def latest_per_key(stream: DataFrame, key: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current row per key (update mode); the state is one row per key, kept for ever: for keys that are bounded."""
    best = F.max_by(F.struct(*values), F.struct(*order))
    return stream.groupBy(key).agg(best.alias("_v")).select(key, "_v.*")


def latest_per_live_key(stream: DataFrame, key: str, values: Sequence[str], order: Sequence[str], time: str, keep: timedelta, delay: str = "1 day") -> DataFrame:
    """Current row per key (update mode), whose state goes once the key is unseen for ``keep`` behind the watermark.

    A key that comes back begins anew, with the rows that then arrive. Rows older than the watermark still count. ``order`` values are not null.
    """
    columns, places = [*values, *order], list(order)
    kinds = {f.name: f for f in stream.schema.fields}
    state_schema = T.StructType([kinds[c] for c in dict.fromkeys(columns)])
    out_schema = T.StructType([kinds[key], *[kinds[c] for c in values]])
    names, wait = state_schema.fieldNames(), int(keep.total_seconds() * 1000)
    at = [names.index(c) for c in places]

    def step(found, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        best, last = (tuple(state.get) if state.exists else None), 0
        for rows in batches:
            # a group's rows of one batch, in pieces; only the greatest of each piece is looked at
            top = rows.sort_values(places).iloc[-1]
            row = tuple(None if pd.isna(top[c]) else top[c].item() if hasattr(top[c], "item") else top[c] for c in names)
            last = max(last, int(rows[time].max().timestamp() * 1000))
            if best is None or [row[i] for i in at] > [best[i] for i in at]:
                best = row
        state.update(best)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame([[found[0], *(best[names.index(c)] for c in values)]], columns=[key, *values])

    rows = stream.withWatermark(time, delay).select(key, *dict.fromkeys([*columns, time]))
    return rows.groupBy(key).applyInPandasWithState(step, out_schema, state_schema, "update", "EventTimeTimeout")


def daily_counts(stream: DataFrame, key: str, time: str, counts: dict[str, Column], delay: str = "2 days") -> DataFrame:
    """Event-time counters per key and day; state older than ``delay`` behind the newest event is dropped."""
    day = F.window(F.col(time), "1 day")
    out = stream.withWatermark(time, delay).groupBy(key, day.alias("_w"))
    return out.agg(*[c.alias(n) for n, c in counts.items()]).select(key, F.col("_w.start").cast("date").alias("game_date"), *counts)
