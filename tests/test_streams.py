"""Keyed state over several micro-batches against the batch functions."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import sessions
from tarnlake.plans import sessions as plans
from tarnlake.streaming import state, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """The events in four files by time, one for each micro-batch."""
    at = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts")
    step = -(-len(events) // 4)
    for k in range(4):
        events.iloc[k * step : (k + 1) * step].to_parquet(f"{at}/{k}.parquet", coerce_timestamps="us")
        os.utime(f"{at}/{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return lambda: views.read_events(spark, str(at), schema, files_per_batch=1)


def test_job_states(spark, arriving):
    got = views.drained(spark, state.job_states(plans.jobs_of(arriving())), "update", ["job_id"])
    want = sessions.job_state(plans.jobs(spark, SF))
    key = lambda df: sorted((r.job_id, r.state, r.percent, r.events) for r in df.select("job_id", "state", "percent", "events").collect())
    assert key(got) == key(want)


def test_a_final_state_absorbs_late_events(spark, tmp_path):
    rows = [[(1, 5, "completed", 120.0), (2, 1, "running", -3.0)], [(1, 9, "running", 50.0), (2, 3, "failed", None)], [(1, 2, "failed", 10.0)]]
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, "job_id long, seq long, state string, percent double").coalesce(1).write.parquet(f"{tmp_path}/b{k}")
        time.sleep(1.1)
    stream = spark.readStream.schema("job_id long, seq long, state string, percent double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b*")
    got = {r.job_id: tuple(r) for r in views.drained(spark, state.job_states(stream), "update", ["job_id"]).collect()}
    assert got == {1: (1, "failed", 50.0, 3), 2: (2, "failed", None, 2)}


def test_paced(spark, arriving):
    columns = lambda e: e.filter("user_id IS NOT NULL").select("user_id", F.col("event_id").alias("seq"), "ts", F.col("value").alias("tokens"))
    args = ("user_id", 6 * 3600.0, 3, 60.0)
    got = views.drained(spark, state.paced(columns(arriving()), *args), "append")
    want = sessions.paced(columns(spark.read.parquet(f"{SF}/events.parquet")), *args)
    key = lambda df: sorted((r.user_id, r.seq, round(r.start, 3), round(r.waited, 3)) for r in df.collect())
    assert key(got) == key(want) and any(r[3] > 0 for r in key(got))


def test_cache(spark, arriving):
    got = {(r.key, r.seq): r.value for r in views.drained(spark, _cached(arriving()), "append").collect()}
    want = plans.cache_lookups(spark, SF)
    by_time = {(r.user_id, r.ts): r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").filter("event_id % 2 = 1").collect()}
    assert got == {(r.key, by_time[r.key, r.ts]): r.value for r in want.collect()} and any(got.values())


def _cached(e):
    value = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
    return state.cache_lookups(e.filter("user_id IS NOT NULL").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 2 == 1).alias("asks"), value.alias("value")), 7200)


def test_late_and_missing_replies(spark, tmp_path):
    hour, day = 3600, 86_400
    pauses = [(1, 10, day), (2, 11, day), (3, 12, day + 100), (4, 13, day + 90 * hour), (5, 14, day + 91 * hour)]
    replies = [(1, day + 2 * hour, "late"), (2, day + 1800, "in time"), (2, day + 3000, "second"), (3, day + 50, "before"), (9, day + 10, "no pause"), (8, day + 91 * hour, "end")]
    spark.createDataFrame(pauses, "session_id long, pause_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(replies, "session_id long, s long, reply string").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/r")
    p = spark.readStream.schema("session_id long, pause_id long, ts timestamp").parquet(f"{tmp_path}/p")
    r = spark.readStream.schema("session_id long, reply string, ts timestamp").parquet(f"{tmp_path}/r")
    found = views.drained(spark, state.resumed(p, r, "1 hour"), "append")
    got = {x.pause_id: (x.outcome, x.reply) for x in state.first_replies(found).collect()}
    assert got == {10: ("timed_out", None), 11: ("resumed", "in time"), 12: ("timed_out", None)}  # the last two still wait
    assert found.count() == 4


def test_step_clock_over_many_files_in_any_order(spark, tmp_path):
    import duckdb

    from tarnlake.plans.catalog import ORACLE_SQL, QUERIES

    events = spark.read.parquet(f"{SF}/events.parquet").toPandas().sample(frac=1, random_state=5)
    events.loc[events.index[:20], "ts"] = None
    (tmp_path / "events.parquet").mkdir()
    for k in range(140):
        events.iloc[k::140].to_parquet(f"{tmp_path}/events.parquet/{k:03d}.parquet", coerce_timestamps="us")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(tuple(r) for r in QUERIES["stream_step_clock"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(c.execute(ORACLE_SQL["stream_step_clock"]).fetchall()) and len(got) > 500


def test_step_clock_goes_on_over_micro_batches(spark, arriving):
    steps = lambda e: e.filter("user_id IS NOT NULL").select(F.col("user_id").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), "ts")
    got = {(r.request_id, r.seq): (r.elapsed_ms, r.stage_elapsed_ms) for r in views.drained(spark, views.step_clock(steps(arriving()), forget=False), "append").collect()}
    want, first, last = {}, {}, {}
    for r in sorted(steps(spark.read.parquet(f"{SF}/events.parquet")).collect(), key=lambda r: r.seq):
        a, b = first.setdefault(r.request_id, r.seq), last.get(r.request_id, r.seq)
        want[r.request_id, r.seq], last[r.request_id] = ((r.seq - a) // 1000, (r.seq - b) // 1000), r.seq
    assert got == want
