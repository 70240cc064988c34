"""Structured Streaming views (section 2.12): windows over events, step clocks, document ingestion, streams run into tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tarnlake.storage import new_folder


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int | None = 64) -> DataFrame:
    """A folder of Parquet files as a stream, of all that are there at a time with None; ``ts`` becomes a timestamp that watermarks understand."""
    stream = spark.readStream.schema(schema)
    stream = (stream if files_per_batch is None else stream.option("maxFilesPerTrigger", files_per_batch)).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: Column, late: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums per window and event type; state older than the watermark is dropped in append and update mode."""
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def drained(spark: SparkSession, stream: DataFrame, mode: str = "complete", key: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there into a table in the shared folder, and read it.

    ``append`` writes rows once. The others write a folder for each micro-batch, a repeated one over itself: with ``complete`` the
    newest holds the result, with ``update`` of each ``key`` the row of the newest batch that has one.
    """
    path, checkpoint = new_folder(spark, "stream-table"), new_folder(spark, "stream-checkpoint")
    start = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        start.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    last = [-1]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[0] = max(last[0], number)

    start.foreachBatch(write).start().awaitTermination()
    if mode == "complete" or last[0] < 0:
        return spark.read.schema(stream.schema).parquet(f"{path}/batch={last[0]}") if last[0] >= 0 else spark.createDataFrame([], stream.schema)
    every = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)
    rest = [c for c in stream.columns if c not in key]
    return every.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("__row")).select(*key, "__row.*").select(*stream.columns)


def step_clock(steps: DataFrame, forget: bool = True) -> DataFrame:
    """SM-01: per request the time since its first step and since the last one, kept in keyed state.

    A request's steps are put in order within a micro-batch, of which two numbers a step are held; micro-batches bring them in order. With ``forget`` a
    request is forgotten when an hour of event time passes without a step, and steps behind the watermark are left out. Without it
    every step counts and every request is kept, as suits a stream over what is there.
    """

    def clock(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [(b["seq"].to_numpy(np.int64), b["ts"].to_numpy("datetime64[us]")) for b in batches]  # Arrow may cut a request anywhere
        seq, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(seq, kind="stable")
        seq, at = seq[order], at[order]
        first, last = [np.datetime64("NaT" if v is None else v, "us") for v in state.get] if state.exists else (at[0], at[0])
        since = lambda then: np.where(np.isnat(at - then), 0, np.maximum((at - then).astype(np.int64), 0) // 1000)
        state.update(tuple(None if np.isnat(v) else int(v.astype(np.int64)) for v in (first, at[-1])))
        if forget:
            seen = at[~np.isnat(at)]
            state.setTimeoutTimestamp(max(int(seen[-1].astype(np.int64)) // 1000 if len(seen) else 0, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame({"request_id": key[0], "seq": seq, "elapsed_ms": since(first), "stage_elapsed_ms": since(np.concatenate([[last], at[:-1]]))})

    kind = dict(steps.dtypes)["request_id"]
    timed = steps.withWatermark("ts", "10 minutes") if forget else steps
    return timed.groupBy("request_id").applyInPandasWithState(clock, f"request_id {kind}, seq long, elapsed_ms long, stage_elapsed_ms long", "first long, last long", "append", "EventTimeTimeout" if forget else "NoTimeout")


def ingest(documents: DataFrame, chunker: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """SM-05, SM-10: each micro-batch of documents is chunked and appended under its batch number as version; readers take the newest valid version."""

    def write(batch: DataFrame, number: int) -> None:
        # overwriting the batch's own folder makes a repeated batch harmless
        chunker(batch).write.mode("overwrite").parquet(f"{path}/version={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
