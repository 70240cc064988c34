"""Chats, step logs, jobs, caches and rate windows (AG-23, WN-05, WN-06, WN-08, WN-11, SM-02 to SM-04, SM-07, SM-09)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.text import session_title


def session_list(messages: DataFrame) -> DataFrame:
    """AG-23: ``session_id, seq, role, text`` to sessions with their number of messages and a title from the first question."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("seq")))
    one = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("seq").alias("last_seq"), first.alias("asked"))
    return one.select("session_id", "messages", "last_seq", F.when(F.col("asked").isNull(), F.col("session_id").cast("string")).otherwise(session_title(F.col("asked"))).alias("title"))


def last_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    """WN-06: a session's newest messages."""
    by = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    return messages.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= n).drop("__n")


def note_due(messages: DataFrame, n: int = 6, notes: DataFrame | None = None) -> DataFrame:
    """SM-09: sessions whose history exceeds the window, or that have a note (session_id, note) already, blank ones being none."""
    out = messages.groupBy("session_id").agg((F.count("*") > n).alias("due"))
    if notes is None:
        return out
    held = notes.filter(F.coalesce(F.col("note") != "", F.lit(False))).select("session_id").distinct().withColumn("__held", F.lit(True))
    return out.join(held, "session_id", "full").select("session_id", (F.coalesce("due", F.lit(False)) | F.col("__held").isNotNull()).alias("due"))


def step_timing(steps: DataFrame) -> DataFrame:
    """WN-05: ``request_id, seq, ts`` with time since the start and since the step before, never negative, in milliseconds."""
    by = Window.partitionBy("request_id").orderBy("seq")
    ms = lambda a, b: F.greatest(F.floor((F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1000), F.lit(0))
    ts = F.col("ts")
    start, before = F.first("ts").over(by), F.lag("ts").over(by)
    return steps.withColumn("elapsed_ms", ms(ts, start)).withColumn("stage_elapsed_ms", ms(ts, F.coalesce(before, ts)))


def step_groups(steps: DataFrame) -> DataFrame:
    """WN-08: named steps join their group wherever they occur; a run without a name is broken only where a new named group begins."""
    first = F.row_number().over(Window.partitionBy("request_id", "step_group").orderBy("seq"))
    begun = F.sum(F.when(F.col("step_group").isNotNull() & (F.col("__first") == 1), 1).otherwise(0)).over(Window.partitionBy("request_id").orderBy("seq"))
    keyed = steps.withColumn("__first", first).withColumn("group_key", F.coalesce("step_group", F.concat(F.lit("none#"), begun.cast("string"))))
    return keyed.groupBy("request_id", "group_key").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("steps"))


def rate_window(calls: DataFrame, key: str | None = None, seconds: int = 60, requests: int = 60, tokens: float = 1000.0) -> DataFrame:
    """WN-11: calls and tokens of the last ``seconds`` before each call, and whether limits admit it.

    A single call larger than the token limit is admitted into an empty window. Give a ``key`` to window per client;
    without one the order is global. Time is cut into stretches of ``seconds``: a call is looked at in its own and, as an
    earlier call, in the next one, so no task holds more than two stretches of a client.
    """
    micros = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    marked = calls.withColumn("__at", at).withColumn("__cell", F.floor(F.col("__at") / micros))
    both = marked.withColumn("__own", F.lit(True)).unionByName(marked.withColumn("__cell", F.col("__cell") + 1).withColumn("__own", F.lit(False)))
    w = Window.partitionBy(*([key] if key else []), "__cell").orderBy("__at").rangeBetween(-micros, 0)
    out = both.withColumn("window_calls", F.count("*").over(w)).withColumn("window_tokens", F.round(F.sum("tokens").over(w), 6)).filter("__own").drop("__own", "__cell", "__at")
    alone = F.col("window_calls") == 1
    return out.withColumn("admitted", (F.col("window_calls") <= requests) & ((F.col("window_tokens") <= tokens) | alone))


def paced(calls: DataFrame, key: str, seconds: float = 60.0, requests: int = 2000, tokens: float = 500_000.0) -> DataFrame:
    """SM-03: ``start``, when each call may go, and how long it ``waited``, in seconds: a call waits until those that went in the
    last ``seconds`` leave room for it; a limit of 0 is none.

    ``calls``: key, ts, tokens and ``seq`` for ties. Calls of a client go one after the other; a call larger than the
    token limit goes into an empty window. Rows stream by in time order; held is one client's last window.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, window, spent, now = None, deque(), 0.0, float("-inf")
        for frame in frames:
            starts = []
            for who, at, n in zip(frame["k"], frame["at"], frame["tokens"], strict=True):
                if who != client:
                    client, window, spent, now = who, deque(), 0.0, float("-inf")
                now = max(now, at)
                while window and (window[0][0] + seconds <= now or (requests and len(window) >= requests) or (tokens and spent + n > tokens)):
                    now = max(now, window[0][0] + seconds)
                    spent -= window.popleft()[1]
                window.append((now, n))
                spent += n
                starts.append(now)
            yield pd.DataFrame({"k": frame["k"], "seq": frame["seq"], "start": starts, "waited": np.round(np.array(starts) - frame["at"].to_numpy(), 6)})

    kinds = dict(calls.dtypes)
    ready = calls.select(F.col(key).alias("k"), "seq", F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)).alias("tokens"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    ordered = ready.repartition("k").sortWithinPartitions("k", "at", "seq")
    return ordered.mapInPandas(run, f"k {kinds[key]}, seq {kinds['seq']}, start double, waited double").withColumnRenamed("k", key)


def cache_lookups(writes: DataFrame, reads: DataFrame, ttl: int = 300) -> DataFrame:
    """SM-04: what each read (key, ts) finds of the writes (key, ts, value; a null value deletes) before it: the newest, if it is
    younger than ``ttl`` seconds; an empty value is a miss like none.

    One pass in time order per key, an as-of join by window.
    """
    every = writes.select("key", "ts", F.struct(F.col("ts").alias("at"), "value").alias("held"), F.lit(0).alias("asks")).unionByName(reads.select("key", "ts", F.lit(1).alias("asks")), allowMissingColumns=True)
    by = Window.partitionBy("key").orderBy("ts", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.withColumn("held", F.last("held", ignorenulls=True).over(by)).filter("asks = 1")
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("held.at").cast("timestamp"))
    return found.select("key", "ts", F.when((age < ttl * 1_000_000) & (F.col("held.value") != ""), F.col("held.value")).alias("value"))


def job_state(events: DataFrame) -> DataFrame:
    """SM-02: ``job_id, seq, state, percent``: failed and completed are final, percent stays within 0 and 100, the newest event counts otherwise."""
    final = F.min(F.when(F.col("state").isin("failed", "completed"), F.struct("seq", "state")))
    last = F.max_by("state", "seq")
    one = events.groupBy("job_id").agg(final.alias("f"), last.alias("l"), F.max_by(F.least(F.greatest("percent", F.lit(0.0)), F.lit(100.0)), "seq").alias("percent"), F.count("*").alias("events"))
    return one.select("job_id", F.coalesce("f.state", "l").alias("state"), "percent", "events")


def one_call_per_turn(calls: DataFrame) -> DataFrame:
    """SM-07: the first retrieval call of each turn."""
    by = Window.partitionBy("session_id", "turn").orderBy("seq")
    return calls.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")
