"""Keyed state over streams (SM-02 to SM-04): list and value state, event timers, time to live.

Each of the three is the stream of a batch function of :mod:`tarnlake.operators.sessions` and gives its rows. A key's rows of a
micro-batch are put in time order; a row that comes after a later one was handled counts from then on. State is kept by RocksDB, the only
store that has more than one kind of it, which each function sets for its session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FINAL = ("failed", "completed")


def configured(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _rows(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    held = [b for b in batches if len(b)]
    return pd.concat(held).sort_values(list(order), kind="stable") if held else pd.DataFrame()


class _Jobs(StatefulProcessor):
    """The newest event and the first final one of a job."""

    def __init__(self, days: int | None) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("job", "last_seq long, last_state string, percent double, final_seq long, final_state string, events long", self.days and self.days * 86_400_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last_seq, last_state, percent, final_seq, final_state, events = self.held.get() or (None, None, None, None, None, 0)
        for r in _rows(rows, "seq").itertuples():
            events += 1
            if last_seq is None or r.seq >= last_seq:
                last_seq, last_state = r.seq, r.state
                percent = None if pd.isna(r.percent) else min(100.0, max(0.0, r.percent))
            if r.state in FINAL and (final_seq is None or r.seq < final_seq):
                final_seq, final_state = r.seq, r.state
        self.held.update((last_seq, last_state, percent, final_seq, final_state, events))
        yield pd.DataFrame({"job_id": [key[0]], "state": [final_state or last_state], "percent": [percent], "events": [events]})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, days: int | None = None) -> DataFrame:
    """SM-02: ``events`` (job_id, seq, state, percent) as a stream of a job's row whenever it changes (update mode).

    ``days`` after its last event a job is forgotten, for streams that go on: Spark keeps such time by the clock, and a run
    over what is there would wait for it without end.
    """
    configured(events.sparkSession)
    kind = dict(events.dtypes)["job_id"]
    schema = f"job_id {kind}, state string, percent double, events long"
    return events.groupBy("job_id").transformWithStateInPandas(_Jobs(days), schema, "Update", "ProcessingTime" if days else "None")


class _Pace(StatefulProcessor):
    """The calls of a client's last window, and the time up to which it has been served. A client that is idle for a window is forgotten."""

    def __init__(self, seconds: float, requests: int, tokens: float) -> None:
        self.seconds, self.requests, self.tokens = seconds, requests, tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getListState("window", "start double, tokens double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        window = [tuple(x) for x in self.window.get()] if self.window.exists() else []
        now = window[-1][0] if window else float("-inf")
        spent, first = sum(n for _, n in window), 0
        got = _rows(rows, "at", "seq")
        starts = []
        for at, n in zip(got["at"], got["tokens"], strict=True):
            now = max(now, at)
            while first < len(window) and (window[first][0] + self.seconds <= now or (self.requests and len(window) - first >= self.requests) or (self.tokens and spent + n > self.tokens)):
                now = max(now, window[first][0] + self.seconds)
                spent -= window[first][1]
                first += 1
            window.append((now, n))
            spent += n
            starts.append(now)
        self.window.put(window[first:])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, (tuple, list)) else old)
        self.handle.registerTimer(int((now + self.seconds) * 1000) + 1)
        yield pd.DataFrame({"k": [key[0]] * len(got), "seq": got["seq"].to_numpy(), "start": starts, "waited": np.round(np.array(starts) - got["at"].to_numpy(), 6)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.window.clear()
        yield pd.DataFrame({"k": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "start": pd.Series(dtype="float64"), "waited": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


def paced(calls: DataFrame, key: str, seconds: float = 60.0, requests: int = 2000, tokens: float = 500_000.0, late: str = "0 seconds") -> DataFrame:
    """SM-03 as a stream: when each call (key, ts, tokens, seq) may go and how long it waited (append mode)."""
    configured(calls.sparkSession)
    kinds = dict(calls.dtypes)
    ready = calls.withWatermark("ts", late).select(F.col(key).alias("k"), "ts", "seq", F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)).alias("tokens"), (F.unix_micros("ts") / 1e6).alias("at"))
    schema = f"k {kinds[key]}, seq {kinds['seq']}, start double, waited double"
    return ready.groupBy("k").transformWithStateInPandas(_Pace(seconds, requests, tokens), schema, "Append", "EventTime").withColumnRenamed("k", key)


class _Cache(StatefulProcessor):
    """The writes under a key that a read may still find; a timer takes them away when the last one's time is over."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.writes = handle.getListState("writes", "at long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(x) for x in self.writes.get()] if self.writes.exists() else []
        reads, found = [], []
        for r in _rows(rows, "at", "asks", "seq").itertuples():
            if not r.asks:
                held.append((r.at, r.value))
                continue
            at, value = max((w for w in enumerate(held) if w[1][0] <= r.at), key=lambda w: (w[1][0], w[0]), default=(0, (None, None)))[1]
            reads.append(r.seq)
            found.append(value if at is not None and r.at - at < self.micros and value else None)
        newest = max((at for at, _ in held), default=None)
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 - self.micros
        held = [w for w in held if w[0] > oldest]
        if held:
            self.writes.put(held)
            self.handle.registerTimer((newest + self.micros) // 1000 + 1)
        else:
            self.writes.clear()
        yield pd.DataFrame({"key": [key[0]] * len(reads), "seq": reads, "value": pd.Series(found, dtype=object)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 - self.micros
        held = [tuple(x) for x in self.writes.get() if x[0] > oldest] if self.writes.exists() else []
        if held:
            self.writes.put(held)
        else:
            self.writes.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "value": pd.Series(dtype=object)})

    def close(self) -> None:
        pass


def cache_lookups(operations: DataFrame, ttl: int = 300, late: str = "0 seconds") -> DataFrame:
    """SM-04 as a stream: what each read finds (append mode).

    ``operations``: key, ts, seq, asks (a read, else a write) and value (null deletes, an empty one is a miss). Of writes at
    one moment the last by ``seq`` counts; a write counts for reads at the same moment.
    """
    configured(operations.sparkSession)
    kinds = dict(operations.dtypes)
    ready = operations.withWatermark("ts", late).select("key", "ts", "seq", "asks", "value", F.unix_micros("ts").alias("at"))
    return ready.groupBy("key").transformWithStateInPandas(_Cache(ttl * 1_000_000), f"key {kinds['key']}, seq {kinds['seq']}, value string", "Append", "EventTime")


def resumed(pauses: DataFrame, replies: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """SM-08 as a stream: pauses (session_id, pause_id, ts and more) with each reply (session_id, ts, reply) within ``wait``; one without
    comes back once, with a null reply, when the watermark has passed its time (append mode).

    Rows of both sides are forgotten when nothing can meet them any more. :func:`first_replies` takes the first of several.
    """
    p = pauses.withColumnRenamed("ts", "paused_at").withWatermark("paused_at", late)
    r = replies.select(F.col("session_id").alias("__session"), F.col("ts").alias("replied_at"), "reply").withWatermark("replied_at", late)
    near = (F.col("replied_at") > F.col("paused_at")) & (F.col("replied_at") <= F.col("paused_at") + F.expr(f"INTERVAL {wait}"))
    return p.join(r, (F.col("session_id") == F.col("__session")) & near, "leftOuter").drop("__session")


def first_replies(found: DataFrame) -> DataFrame:
    """Of a pause's replies the first; ``outcome`` says whether the question goes on or timed out."""
    kept = [c for c in found.columns if c not in ("session_id", "pause_id", "replied_at", "reply")]
    one = found.groupBy("session_id", "pause_id").agg(*[F.any_value(c).alias(c) for c in kept], F.min(F.struct("replied_at", "reply")).alias("f"))
    return one.select("session_id", "pause_id", *kept, "f.replied_at", "f.reply", F.when(F.col("f.replied_at").isNull(), "timed_out").otherwise("resumed").alias("outcome"))
