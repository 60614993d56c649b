"""Streams replayed to their end, compared with what a batch says."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.corpus import table
from tessera.plans.registry import query
from tessera.session import shared_dir
from tessera.streaming import queues as S
from tessera.streaming import task_queue as Q
from tessera.streaming import token_stream as T


def _events(spark, sf_dir, per_trigger: int | None = None):
    """The events as a stream; one table is one file or folder, read in one batch unless ``per_trigger`` files are asked for."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return (stream.option("maxFilesPerTrigger", per_trigger) if per_trigger else stream).parquet(f"{sf_dir}/events.parque[t]")


COMMANDS = {"view": "enqueue", "signup": "enqueue", "click": "start", "error": "fail", "purchase": "finish"}


def _commands(events, *more):
    c = F.lit("restore")
    for k, v in COMMANDS.items():
        c = F.when(F.col("event_type") == k, v).otherwise(c)
    return events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), c.alias("command"), *more)


STEPS = """
cmd AS (SELECT user_id AS task_id, CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'start' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'finish' ELSE 'restore' END AS c,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
run AS (SELECT DISTINCT user_id AS task_id, NULL::VARCHAR AS s, 0 AS r, 0::BIGINT AS i FROM events
  UNION ALL SELECT run.task_id,
    CASE WHEN c = 'enqueue' THEN coalesce(s, 'pending') WHEN c = 'start' AND s = 'pending' THEN 'processing' WHEN c = 'fail' AND s = 'processing' THEN CASE WHEN r >= 2 THEN 'failed' ELSE 'pending' END
      WHEN c = 'restore' AND s = 'processing' THEN 'pending' WHEN c = 'finish' AND s = 'processing' THEN NULL ELSE s END,
    CASE WHEN s IS NULL THEN 0 WHEN c = 'fail' AND s = 'processing' THEN r + 1 WHEN c = 'finish' AND s = 'processing' THEN 0 ELSE r END, cmd.i
  FROM run JOIN cmd ON cmd.task_id = run.task_id AND cmd.i = run.i + 1),
states AS (SELECT task_id, coalesce(arg_max(coalesce(s, ''), i), '') AS s, arg_max(r, i) AS r, max(i) AS n FROM run GROUP BY 1)
"""


@query("queue_states", f"WITH RECURSIVE {STEPS.strip()} SELECT task_id, CASE WHEN s = '' THEN 'done' ELSE s END AS status, r AS retries, n AS n_commands FROM states")
def queue_states(spark, sf_dir):
    """Users as tasks, their events as commands: the state of each after the whole stream."""
    out = S.replay(_events(spark, sf_dir), lambda e: S.queue_states(_commands(e)), shared_dir(spark, "queue"), shared_dir(spark, "queue-checkpoint"), "update")
    return S.latest(out, "task_id")


@query("task_queue", f"WITH RECURSIVE {STEPS.strip()} SELECT task_id, CASE WHEN s = '' THEN 'done' ELSE s END AS status, r AS retries, n AS n_commands FROM states")
def task_queue(spark, sf_dir):
    """The same tasks in a processor that takes commands in any order, one file a batch; no row is late within the table's span."""
    e = table(spark, sf_dir, "events").agg(F.max("ts").alias("b"), F.min("ts").alias("a")).first()
    hours = int((e.b - e.a).total_seconds() // 3600) + 24 if e.a else 24
    commands = lambda x: _commands(x, F.col("ts").cast("timestamp").alias("ts"))
    with Q.timed_state(spark):
        out = S.replay(_events(spark, sf_dir, 1), lambda x: Q.task_states(commands(x), f"{hours} hours", keep=(hours + 1) * 3600 * 1000), shared_dir(spark, "tasks"), shared_dir(spark, "tasks-checkpoint"), "update")
    return Q.newest_states(out)


@query("queue_summary", f"WITH RECURSIVE {STEPS.strip()} SELECT count(*) FILTER (WHERE s = 'pending') AS pending, count(*) FILTER (WHERE s = 'processing') AS processing, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) AS total FROM states WHERE s <> ''")
def queue_summary(spark, sf_dir):
    return S.queue_summary(queue_states(spark, sf_dir).where("status <> 'done'"))


@query("enqueued_once", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def enqueued_once(spark, sf_dir):
    """Each key enters the queue once."""
    out = S.replay(_events(spark, sf_dir), lambda e: S.enqueued_once(e.select("user_id"), "user_id"), shared_dir(spark, "once"), shared_dir(spark, "once-checkpoint"))
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("stream_windows", "SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events) GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Hourly counts by type from a stream (an addition to the reference's operators)."""
    out = S.replay(_events(spark, sf_dir), lambda e: S.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour"), shared_dir(spark, "windows"), shared_dir(spark, "windows-checkpoint"), "update")
    return out.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("value", "batch").alias("value"))


@query("stream_reviews", "SELECT type, title, count(*) AS n_merged FROM (SELECT event_type AS type, 'user ' || user_id AS title FROM events) GROUP BY 1, 2")
def stream_reviews(spark, sf_dir):
    """Review items merged as they arrive."""
    items = lambda e: e.groupBy(F.col("event_type").alias("type"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("title")).agg(F.count("*").alias("n_merged"))
    out = S.replay(_events(spark, sf_dir), items, shared_dir(spark, "reviews"), shared_dir(spark, "reviews-checkpoint"), "update")
    return out.groupBy("type", "title").agg(F.max_by("n_merged", "batch").alias("n_merged"))


@query(
    "save_sessions",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""",
)
def save_sessions(spark, sf_dir):
    """Changes of a user that follow each other within an hour are saved together, as a stream; a watermark beyond the span of
    the table keeps every row."""
    e = table(spark, sf_dir, "events").agg(F.max("ts").alias("b"), F.min("ts").alias("a")).first()
    hours = int((e.b - e.a).total_seconds() // 3600) + 24
    late = lambda s: S.sessions(s.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", f"{hours} hours")
    out = S.replay(_events(spark, sf_dir), late, shared_dir(spark, "sessions"), shared_dir(spark, "sessions-checkpoint"), "complete")
    last = out.agg(F.max("batch").alias("last"))
    return out.join(F.broadcast(last), F.col("batch") == F.col("last")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("streamed_messages", "SELECT conv_id || ':' || turn AS message_id, md5(regexp_replace(text, '\\r(\\n|\\z)', '\\1', 'g')) AS text, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM conversations WHERE text IS NOT NULL")
def streamed_messages(spark, sf_dir):
    """Every turn sent as an event stream whose bytes are cut without regard to lines and characters, in three batches out of
    order, and put together again."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    pieces = turns.select(F.concat_ws(":", "conv_id", "turn").alias("message_id"), F.explode(T.cut(F.col("text"), 97)).alias("p")).select("message_id", "p.*")
    folder = shared_dir(spark, "pieces")
    for k in (2, 0, 1):
        pieces.where(F.pmod("seq", F.lit(3)) == k).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(pieces.schema).parquet(folder)
    with Q.timed_state(spark):
        lines = S.replay(stream, lambda x: T.said_lines(x), shared_dir(spark, "lines"), shared_dir(spark, "lines-checkpoint"))
    n = lines.groupBy("message_id").agg(F.count("*").alias("n_lines"))
    return T.messages(lines).join(n, "message_id").select("message_id", F.md5("text").alias("text"), "n_lines")
