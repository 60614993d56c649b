"""The task queue under disorder, restarts, crashes and repeats."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import SQL
from tessera.plans.streams import _commands
from tessera.session import shared_dir
from tessera.streaming import queues as S
from tessera.streaming import task_queue as Q

DAY = Q.DAY


def stream(spark, folder, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def test_any_order_of_files_and_a_restart_give_the_states_of_the_sql(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder, out, checkpoint = (shared_dir(spark, n) for n in ("files", "out", "checkpoint"))
    parts = events.withColumn("p", F.pmod(F.xxhash64("event_id"), F.lit(4)))

    def add(p):
        parts.where(F.col("p") == p).drop("p").coalesce(1).write.mode("append").parquet(folder)
        if p == 3:  # some rows come again
            parts.where("p = 0").drop("p").limit(50).coalesce(1).write.mode("append").parquet(folder)

    def run():
        with Q.timed_state(spark):
            commands = lambda x: _commands(x, F.col("ts").cast("timestamp").alias("ts"))
            return S.replay(stream(spark, folder, events.schema), lambda x: Q.task_states(commands(x), "4000 days"), out, checkpoint, "update")

    add(2)
    add(0)
    half = Q.newest_states(run()).agg(F.sum("n_commands")).first()[0]
    add(3)
    add(1)
    got = Q.newest_states(run())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.execute(f"SELECT task_id, status, retries, n_commands FROM ({SQL['queue_states']})").fetchall()
    assert half < events.count() and sorted(map(tuple, got.select("task_id", "status", "retries", "n_commands").collect())) == sorted(want)


def test_crashed_tasks_come_back_and_finished_ones_are_forgotten(spark):
    folder, out, checkpoint = (shared_dir(spark, n) for n in ("files", "out", "checkpoint"))
    schema = "task_id long, seq long, command string, ts timestamp"

    def add(*rows):
        days = [(t, s, c, d) for t, s, c, d in rows]
        df = spark.createDataFrame(days, "task_id long, seq long, command string, d int").select("task_id", "seq", "command", F.timestamp_millis(F.col("d") * F.lit(DAY)).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)

    def run():
        with Q.timed_state(spark):
            q = S.replay(stream(spark, folder, spark.createDataFrame([], schema).schema), lambda x: Q.task_states(x, "1 day", 5 * DAY, 3 * DAY), out, checkpoint, "update")
        return {r.task_id: (r.status, r.retries, r.n_commands) for r in Q.newest_states(q).collect()}

    # 1 starts and says no more; 2 fails three times; 3 finishes
    add((1, 1, "enqueue", 1), (1, 2, "start", 2), (2, 1, "enqueue", 1), (3, 1, "enqueue", 1), (3, 2, "start", 1), (3, 3, "finish", 2))
    add((2, 3, "fail", 2), (2, 5, "fail", 2), (2, 7, "fail", 2))  # before their starts
    add((2, 2, "start", 2), (2, 4, "start", 2), (2, 6, "start", 2))
    assert run() == {1: ("processing", 0, 2), 2: ("failed", 3, 7), 3: ("done", 0, 3)}
    add((9, 1, "enqueue", 20))
    add((9, 2, "start", 21))
    got = run()
    assert got[1] == ("pending", 0, 2) and got[9] == ("processing", 0, 2)
    # 3 is new after it was forgotten, 1 goes on from where it was put back, and what is too late is left out
    add((3, 9, "enqueue", 22), (1, 9, "start", 22), (2, 8, "retry", 22))
    add((1, 10, "finish", 2))
    got = run()
    assert got[3] == ("pending", 0, 1) and got[1] == ("processing", 0, 3) and got[2] == ("pending", 0, 8)


STATES = "task_id long, status string, retries int, n_commands long"


def test_an_epoch_is_taken_once_and_stale_workers_are_refused(spark, tmp_path):
    table = Q.EpochTable(spark, str(tmp_path / "t"), STATES)
    rows = lambda *r: spark.createDataFrame([(*x, 0, 1) for x in r], STATES)
    table.fence()
    assert table.take(rows((1, "pending"), (2, "processing")), 0) and not table.take(rows((1, "failed")), 0)
    assert table.take(rows(), 1) and not table.take(rows((1, "failed")), 1)
    other = Q.EpochTable(spark, str(tmp_path / "t"), STATES)
    other.fence()
    with pytest.raises(Q.Stale):
        table.take(rows((1, "failed")), 2)
    with pytest.raises(Q.Stale):
        table.drained(lambda: None)
    assert other.take(rows((1, "done")), 2)
    assert {(r.task_id, r.status) for r in other.read().collect()} == {(1, "done"), (2, "processing")} and other.state()["epoch"] == 2


def test_the_sweep_runs_once_for_each_drain(spark, tmp_path):
    table, swept = Q.EpochTable(spark, str(tmp_path / "t"), STATES), []
    batch = lambda *r: spark.createDataFrame([(*x, 0, n + 1, 1) for n, x in enumerate(r)], STATES + ", change long")
    sink = Q.into(table, lambda: swept.append(1))
    sink(batch((1, "pending"), (2, "done")), 0)
    assert not swept
    sink(batch((1, "done")), 1)
    sink(batch((1, "done")), 1)  # the batch again
    assert len(swept) == 1 and table.state()["sweeps"] == 1

    def crash():
        swept.append(1)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        Q.into(table, crash)(batch((3, "done")), 2)
    sink(batch((3, "done")), 2)  # the stream starts again with the batch that failed
    assert len(swept) == 3 and table.state()["sweeps"] == 2
    sink(batch((4, "pending")), 3)
    assert len(swept) == 3
