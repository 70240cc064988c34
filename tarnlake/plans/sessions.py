"""Queries on chats, step logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.operators import sessions
from tarnlake.plans.registry import query, table
from tarnlake.streaming import state, views


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


_TITLE = r"""coalesce(nullif(left(trim(regexp_replace({x}, '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'), ' 。！？!?，,；;：:'), 16), ''), '新会话')"""


@query("session_list", f"""
WITH o AS (SELECT conv_id AS session_id, count(*) AS messages, max(turn) AS last_seq, arg_min(text, turn) FILTER (role = 'user') AS asked FROM conversations GROUP BY 1)
SELECT session_id, messages, last_seq, CASE WHEN asked IS NULL THEN session_id::VARCHAR ELSE {_TITLE.format(x='asked')} END AS title FROM o
""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_list(messages(spark, sf_dir)).orderBy(F.col("last_seq").desc(), "session_id")


@query("last_six_messages", "SELECT session_id, seq, role FROM (SELECT conv_id AS session_id, turn AS seq, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def last_six_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_messages(messages(spark, sf_dir)).select("session_id", "seq", "role")


@query("session_title", f"SELECT conv_id, turn, {_TITLE.format(x='text')} AS title FROM conversations")
def session_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.session_title(F.col("text")).alias("title"))


@query("note_due", "SELECT conv_id AS session_id, count(*) > 6 OR conv_id % 3 = 0 AS due FROM conversations GROUP BY conv_id UNION ALL SELECT -1, true")
def note_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-09: every third session has a note, some a blank one, and one has a note but no messages."""
    m = messages(spark, sf_dir)
    i = F.col("session_id")
    notes = m.select("session_id").distinct().filter(i % 3 != 2).withColumn("note", F.when(i % 3 == 0, "likes short answers").otherwise(""))
    return sessions.note_due(m, 6, notes.unionByName(spark.createDataFrame([(-1, "n")], notes.schema)))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    group = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type"))
    return e.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), "ts", group.alias("step_group"))


@query("step_timing", """
SELECT user_id AS request_id, event_id AS seq, greatest(floor((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1000), 0)::BIGINT AS elapsed_ms, greatest(floor((epoch_us(ts) - coalesce(epoch_us(lag(ts) OVER w), epoch_us(ts))) / 1000), 0)::BIGINT AS stage_elapsed_ms FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def step_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.step_timing(steps(spark, sf_dir)).select("request_id", "seq", "elapsed_ms", "stage_elapsed_ms")


@query("step_groups", """
WITH s AS (SELECT user_id AS request_id, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS g FROM events WHERE user_id IS NOT NULL), f AS (SELECT *, g IS NOT NULL AND row_number() OVER (PARTITION BY request_id, g ORDER BY seq) = 1 AS begins FROM s),
k AS (SELECT *, coalesce(g, 'none#' || sum(begins::INT) OVER (PARTITION BY request_id ORDER BY seq)) AS group_key FROM f)
SELECT request_id, group_key, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS steps FROM k GROUP BY ALL
""")
def step_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.step_groups(steps(spark, sf_dir))


@query("rate_window", """
WITH c AS (SELECT event_id, user_id, ts, value AS tokens FROM events WHERE user_id IS NOT NULL), w AS (SELECT event_id, count(*) OVER x AS window_calls, round(sum(tokens) OVER x, 6) AS window_tokens FROM c WINDOW x AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW))
SELECT event_id, window_calls, window_tokens, window_calls <= 3 AND (window_tokens <= 60 OR window_calls = 1) AS admitted FROM w
""")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("event_id", "user_id", "ts", F.col("value").alias("tokens"))
    return sessions.rate_window(calls, "user_id", 6 * 3600, 3, 60.0).select("event_id", "window_calls", "window_tokens", "admitted")


@query("cache_lookups", """
WITH w AS (SELECT user_id AS key, event_id, ts, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN '' ELSE 'v' || event_id END AS value FROM events WHERE user_id IS NOT NULL AND event_id % 2 = 0), w1 AS (SELECT key, ts, arg_max(value, event_id) AS value, arg_max(value IS NULL, event_id) AS gone FROM w GROUP BY ALL),
r AS (SELECT user_id AS key, ts FROM events WHERE user_id IS NOT NULL AND event_id % 2 = 1)
SELECT r.key, r.ts, CASE WHEN w1.ts IS NOT NULL AND epoch_us(r.ts) - epoch_us(w1.ts) < 7200000000 AND NOT gone AND value <> '' THEN value END AS value FROM r ASOF LEFT JOIN w1 ON r.key = w1.key AND r.ts >= w1.ts
""")
def cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-04: even events write under their user, odd ones read, entries live two hours; of writes at one moment the last counts."""
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    value = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
    w = e.filter("event_id % 2 = 0").select(F.col("user_id").alias("key"), "ts", "event_id", value.alias("value")).groupBy("key", "ts").agg(F.max_by(F.struct("value"), "event_id")["value"].alias("value"))
    return sessions.cache_lookups(w, e.filter("event_id % 2 = 1").select(F.col("user_id").alias("key"), "ts"), 7200)


@query("paced_calls")
def paced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-03; each start hangs on those before it, which SQL has no short form for; the tests hold it against a plain loop."""
    calls = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("user_id", F.col("event_id").alias("seq"), "ts", F.col("value").alias("tokens"))
    return sessions.paced(calls, "user_id", 6 * 3600.0, 3, 60.0)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_of(table(spark, sf_dir, "events"))


def jobs_of(events: DataFrame) -> DataFrame:
    e = F.col("event_type")
    at = F.when(e == "error", "failed").when(e == "purchase", "completed").when(e == "signup", "pending").otherwise("running")
    return events.select((F.col("event_id") % 997).alias("job_id"), F.col("event_id").alias("seq"), at.alias("state"), (F.col("value") * 3 - 20).alias("percent"))


@query("job_state", """
WITH j AS (SELECT event_id % 997 AS job_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'pending' ELSE 'running' END AS state, value * 3 - 20 AS percent FROM events)
SELECT job_id, coalesce(arg_min(state, seq) FILTER (state IN ('failed', 'completed')), arg_max(state, seq)) AS state, arg_max(least(greatest(percent, 0.0), 100.0), seq) AS percent, count(*) AS events FROM j GROUP BY job_id
""")
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.job_state(jobs(spark, sf_dir))


@query("one_call_per_turn", "SELECT session_id, turn, min(seq) AS seq FROM (SELECT user_id AS session_id, event_id // 100 AS turn, event_id AS seq FROM events WHERE user_id IS NOT NULL) GROUP BY ALL")
def one_call_per_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("session_id"), F.floor(F.col("event_id") / 100).alias("turn"), F.col("event_id").alias("seq"))
    return sessions.one_call_per_turn(c)


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = 64) -> DataFrame:
    # a pattern, as a streaming source takes a single file only by one
    return views.read_events(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema, files_per_batch)


_FIELDS = "event_type, count(*) AS n, round(sum(value), 4) AS total"


@query("stream_windows_tumbling", f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", {_FIELDS} FROM events GROUP BY ALL")
def stream_windows_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(views.drained(spark, views.windowed(event_stream(spark, sf_dir), F.window("ts", "1 day"))))


@query("stream_windows_sliding", f"SELECT b - INTERVAL (k * 6) HOUR AS start, b - INTERVAL (k * 6) HOUR + INTERVAL 1 DAY AS \"end\", {_FIELDS} FROM (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) AS b FROM events), range(0, 4) r(k) GROUP BY ALL")
def stream_windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(views.drained(spark, views.windowed(event_stream(spark, sf_dir), F.window("ts", "1 day", "6 hours"))))


@query("stream_windows_session", """
WITH g AS (SELECT *, ts > lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTES OR lag(ts) OVER (PARTITION BY event_type ORDER BY ts) IS NULL AS fresh FROM events), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY event_type, k
""")
def stream_windows_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(views.drained(spark, views.windowed(event_stream(spark, sf_dir), F.session_window("ts", "30 minutes"))))


@query("stream_job_state", """
WITH j AS (SELECT event_id % 997 AS job_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'pending' ELSE 'running' END AS state, value * 3 - 20 AS percent FROM events)
SELECT job_id, coalesce(arg_min(state, seq) FILTER (state IN ('failed', 'completed')), arg_max(state, seq)) AS state, arg_max(least(greatest(percent, 0.0), 100.0), seq) AS percent, count(*) AS events FROM j GROUP BY job_id
""")
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-02: job states in keyed state, as a table of each job's newest row."""
    return views.drained(spark, state.job_states(jobs_of(event_stream(spark, sf_dir))), "update", ["job_id"])


@query("stream_cache_lookups", """
WITH w AS (SELECT user_id AS key, event_id, ts, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN '' ELSE 'v' || event_id END AS value FROM events WHERE user_id IS NOT NULL AND event_id % 2 = 0), w1 AS (SELECT key, ts, arg_max(value, event_id) AS value, arg_max(value IS NULL, event_id) AS gone FROM w GROUP BY ALL),
r AS (SELECT user_id AS key, event_id AS seq, ts FROM events WHERE user_id IS NOT NULL AND event_id % 2 = 1)
SELECT r.key, r.seq, CASE WHEN w1.ts IS NOT NULL AND epoch_us(r.ts) - epoch_us(w1.ts) < 7200000000 AND NOT gone AND value <> '' THEN value END AS value FROM r ASOF LEFT JOIN w1 ON r.key = w1.key AND r.ts >= w1.ts
""")
def stream_cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-04: writes and reads as one stream, writes in list state until a timer takes them."""
    e = event_stream(spark, sf_dir).filter("user_id IS NOT NULL")
    value = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
    return views.drained(spark, state.cache_lookups(e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 2 == 1).alias("asks"), value.alias("value")), 7200), "append")


@query("stream_paced_calls")
def stream_paced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-03: the calls of :func:`paced_calls` as a stream; the tests hold it against the batch, which is held against a plain loop."""
    calls = event_stream(spark, sf_dir).filter("user_id IS NOT NULL").select("user_id", F.col("event_id").alias("seq"), "ts", F.col("value").alias("tokens"))
    return views.drained(spark, state.paced(calls, "user_id", 6 * 3600.0, 3, 60.0), "append")


@query("stream_resumed", """
WITH e AS (SELECT *, max(ts) OVER () - INTERVAL 12 HOUR AS settled FROM events WHERE user_id IS NOT NULL),
p AS (SELECT user_id AS session_id, event_id AS pause_id, ts FROM e WHERE event_type IN ('error', 'signup') AND ts < settled),
r AS (SELECT user_id AS session_id, ts, 'reply ' || event_id AS reply FROM e WHERE event_type = 'click')
SELECT p.session_id, p.pause_id, arg_min(r.reply, r.ts) AS reply, CASE WHEN count(r.ts) > 0 THEN 'resumed' ELSE 'timed_out' END AS outcome FROM p LEFT JOIN r ON p.session_id = r.session_id AND r.ts > p.ts AND r.ts <= p.ts + INTERVAL 6 HOUR GROUP BY ALL
""")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-08: pauses meet replies of the next six hours; those without time out. Pauses of the last twelve hours may still wait and are left out."""
    e = event_stream(spark, sf_dir).filter("user_id IS NOT NULL")
    pauses = e.filter(F.col("event_type").isin("error", "signup")).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("pause_id"), "ts")
    replies = e.filter("event_type = 'click'").select(F.col("user_id").alias("session_id"), "ts", F.concat(F.lit("reply "), F.col("event_id").cast("string")).alias("reply"))
    found = state.first_replies(views.drained(spark, state.resumed(pauses, replies, "6 hours"), "append"))
    newest = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 12 HOURS")).alias("settled"))
    return found.crossJoin(newest).filter("paused_at < settled").select("session_id", "pause_id", "reply", "outcome")


def _naive(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
