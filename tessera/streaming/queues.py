"""Structured Streaming: task queues as keyed state, idempotent enqueues, clip polling, windows.

A task queue is a stream of commands (``enqueue``, ``start``, ``fail``, ``finish``, ``cancel``, ``retry``, ``restore``)
per task. The state of a task is its status and retries; state lives in the stream's checkpoint, which takes the place
of a queue file, so a restart resumes where it stopped. Commands of a task are handled in order of ``seq`` within a
batch; batches follow each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RETRIES = 3


def next_status(status: str | None, retries: int, command: str) -> tuple[str | None, int]:
    """Status and retries after a command. Finished and cancelled tasks are forgotten (status None)."""
    if command == "enqueue":
        return (status, retries) if status else ("pending", 0)
    if status is None:
        return None, 0
    if command == "start" and status == "pending":
        return "processing", retries
    if command == "fail" and status == "processing":
        return ("failed" if retries + 1 >= MOST_RETRIES else "pending"), retries + 1
    if command == "retry" and status == "failed":
        return "pending", 0
    if command == "restore" and status == "processing":
        return "pending", retries
    if command == "finish" and status == "processing" or command == "cancel":
        return None, 0
    return status, retries


OUT = "task_id {kind}, status string, retries int, n_commands long"


def queue_states(commands: DataFrame) -> DataFrame:
    """``task_id, status, retries, n_commands`` after each batch, for tasks that got commands (``done`` when forgotten).
    ``commands``: a stream of ``task_id, seq, command``."""
    kind = commands.schema["task_id"].dataType.simpleString()

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, retries, n = state.get if state.exists else (None, 0, 0)
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for c in pdf["command"]:
            status, retries = next_status(status, retries, c)
        n += len(pdf)
        if status is None:
            if state.exists:
                state.remove()
        else:
            state.update((status, retries, n))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status or "done"], "retries": [retries], "n_commands": [n]})

    return commands.groupBy("task_id").applyInPandasWithState(step, OUT.format(kind=kind), "status string, retries int, n long", "update", "NoTimeout")


def queue_summary(states: DataFrame) -> DataFrame:
    """One row: tasks by status and in total."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return states.agg(n("pending"), n("processing"), n("failed"), F.count("*").alias("total"))


def sweep_due(states: DataFrame, processed: int) -> bool:
    """Whether the sweep that follows a drained queue is due: tasks were processed since the last one, and none waits or runs.
    For the end of a stream's batch, which knows how many tasks it finished."""
    return processed > 0 and not states.where(F.col("status").isin("pending", "processing")).limit(1).count()


def enqueued_once(tasks: DataFrame, key: str, watermark: str | None = None, time_col: str = "ts") -> DataFrame:
    """Tasks whose key did not come before; with a watermark, state older than it is dropped."""
    return tasks.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark([key]) if watermark else tasks.dropDuplicates([key])


def replay(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a file stream through ``transform`` until its files are read, and return what was written to ``out``."""
    spark = source.sparkSession
    stream = transform(source)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:  # update and complete outputs, one folder per batch: a batch that is repeated replaces its own folder
        q = stream.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n:06d}")).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", "long")).parquet(out if mode == "append" else f"{out}/b=*")


def latest(states: DataFrame, key: str) -> DataFrame:
    """The newest row of each key of an update stream's batches."""
    rest = [c for c in states.columns if c not in (key, "batch")]
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(key, "x.*")


def clip_stream(spark: SparkSession, folder: str):
    """Clips dropped into a folder as JSON files; start it with a trigger of three seconds."""
    return spark.readStream.schema("clip_id long, title string, url string, text string, day date").json(folder)


def sessions(events: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Changes of a user that follow each other within ``gap`` are saved together (an addition: event-time windows)."""
    s = events.withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def windowed_counts(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """Tumbling counts by type (an addition). Without a watermark no row is late, and all windows stay in the state."""
    w = (events.withWatermark("ts", watermark) if watermark else events).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")
