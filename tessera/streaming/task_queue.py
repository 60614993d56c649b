"""A task queue as a stateful processor with timers, and a sink that takes every epoch once.

``task_states`` keeps, for each task, a snapshot and the commands that came after it (a map by ``seq``). Commands may come in
any order and more than once: each batch replays the buffered ones in order of ``seq``, so the state that goes out is that
of all commands seen so far. When the watermark passes a command's time nothing before it can come any more: a timer folds
the commands up to there into the snapshot. A task that is processed for longer than ``crash_after`` without a word is
taken for crashed and pending again; a finished task is forgotten ``keep`` after its last command.

``EpochTable`` is where a stream's batches go: rows are replaced by key, and the batch's epoch is committed with them, in one
version. A batch that is repeated changes nothing, and a worker that was replaced by another (``fence``) is refused.
``drained`` runs what is due when no task waits or runs any more, once for each time that happens after work was done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.versions import KeyedTable
from tessera.streaming.queues import next_status

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 24 * 3600 * 1000


@contextmanager
def timed_state(spark: SparkSession):
    """Streams that start inside keep their state where processors with timers need it; the setting is put back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class TaskProcessor(StatefulProcessor):
    SNAPSHOT = "status string, retries int, n long, since long, folded long, last long, change long"

    def __init__(self, crash_after: int | None, keep: int):
        self.crash_after, self.keep = crash_after, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.snapshot = handle.getValueState("snapshot", self.SNAPSHOT)
        self.buffer = handle.getMapState("commands", "seq long", "command string, at long")

    def _snapshot(self) -> dict:
        names = [c.split()[0] for c in self.SNAPSHOT.split(", ")]
        return dict(zip(names, self.snapshot.get())) if self.snapshot.exists() else {"status": None, "retries": 0, "n": 0, "since": None, "folded": None, "last": 0, "change": 0}

    def _commands(self) -> list[tuple[int, str, int]]:
        return sorted((int(k[0]), v[0], int(v[1])) for k, v in self.buffer.iterator()) if self.buffer.exists() else []

    def _keep(self, s: dict) -> None:
        self.snapshot.update(tuple(s.values()))

    @staticmethod
    def _after(s: dict, commands: list[tuple[int, str, int]]) -> dict:
        s = dict(s)
        for seq, command, at in commands:
            status, s["retries"] = next_status(s["status"], s["retries"], command)
            if status == "processing" and s["status"] != "processing":
                s["since"] = at
            s |= {"status": status, "n": s["n"] + 1, "folded": seq, "last": max(s["last"], at)}
        return s

    def _row(self, key, s: dict) -> pd.DataFrame:
        return pd.DataFrame({"task_id": [key[0]], "status": [s["status"] or "done"], "retries": [s["retries"]], "n_commands": [s["n"]], "change": [s["change"]]})

    def _wait(self, s: dict, now: dict, commands: list[tuple[int, str, int]]) -> None:
        """The next moment at which something is due."""
        if commands:
            self.handle.registerTimer(min(at for _, _, at in commands))
        if now["status"] == "processing" and self.crash_after is not None:
            self.handle.registerTimer(now["since"] + self.crash_after)
        if now["status"] is None:
            self.handle.registerTimer(now["last"] + self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._snapshot()
        for f in rows:
            for seq, command, at in zip(f["seq"].tolist(), f["command"].tolist(), f["at"].tolist()):
                if s["folded"] is None or seq > s["folded"]:  # else it came again, or too late
                    self.buffer.updateValue((seq,), (command, at))
        commands = self._commands()
        now = self._after(s, commands)
        s["change"] = now["change"] = s["change"] + 1
        self._keep(s)
        self._wait(s, now, commands)
        yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, s, commands = timerValues.getCurrentWatermarkInMs(), self._snapshot(), self._commands()
        ready = 0
        while ready < len(commands) and commands[ready][2] <= watermark:
            self.buffer.removeKey((commands[ready][0],))
            ready += 1
        s, commands = self._after(s, commands[:ready]), commands[ready:]
        crashed = not commands and s["status"] == "processing" and self.crash_after is not None and watermark >= s["since"] + self.crash_after
        if crashed:
            s["status"], s["retries"] = next_status(s["status"], s["retries"], "restore")
            s["change"] += 1
        if not commands and s["status"] is None and watermark >= s["last"] + self.keep:
            self.snapshot.clear()
            self.buffer.clear()
            return
        self._keep(s)
        self._wait(s, self._after(s, commands), commands)
        if crashed:
            yield self._row(key, s)

    def close(self) -> None:
        pass


def task_states(commands: DataFrame, delay: str, crash_after: int | None = None, keep: int = 7 * DAY) -> DataFrame:
    """``task_id, status, retries, n_commands, change`` of tasks that got commands or were given up. ``commands``: a stream of ``task_id,
    seq, command, ts``; rows that come later than ``delay`` (an interval) after the newest are dropped. Times in
    milliseconds. Start it inside ``timed_state``."""
    kind = commands.schema["task_id"].dataType.simpleString()
    known = commands.withWatermark("ts", delay).select("task_id", "seq", "command", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "ts").where("seq IS NOT NULL AND ts IS NOT NULL")
    return known.groupBy("task_id").transformWithStateInPandas(TaskProcessor(crash_after, keep), f"task_id {kind}, status string, retries int, n_commands long, change long", "Update", "EventTime")


def newest_states(out: DataFrame) -> DataFrame:
    """The last row of each task in the batches of an update stream."""
    last = F.max_by(F.struct("status", "retries", "n_commands"), F.struct("batch", "change"))
    return out.groupBy("task_id").agg(last.alias("x")).select("task_id", "x.*")


class Stale(Exception):
    """Another worker has taken over."""


class _Repeated(Exception):
    pass


class EpochTable(KeyedTable):
    """A keyed table that a stream's batches change, each once."""

    mine: int | None = None

    def fence(self) -> int:
        """Take over: workers that did so before are refused from now on."""
        self._keep(lambda s: {**s, "fence": s.get("fence", 0) + 1})
        self.mine = self.state()["fence"]
        return self.mine

    def _checked(self, state: dict) -> None:
        if self.mine is not None and state.get("fence", 0) != self.mine:
            raise Stale(f"worker {self.mine} of {self.root}, where {state.get('fence')} writes")

    def take(self, rows: DataFrame, epoch: int) -> bool:
        """Replace the rows of the keys that come and commit the epoch with them; False if it was committed before."""

        def extra(state: dict) -> dict:
            self._checked(state)
            if epoch <= state.get("epoch", -1):
                raise _Repeated
            return {"epoch": epoch}

        try:
            extra(self.state())
            keys = rows.select(F.col(self.key).alias("_key")).distinct()
            kept = lambda have: have.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").unionByName(rows.select(*self.columns))
            before = self.newest()
            if self._change(keys, kept, extra) == before:  # a batch without rows is an epoch as well
                self._keep(lambda s: {**s, **extra(s)})
        except _Repeated:
            return False
        return True

    def drained(self, sweep: Callable[[], None]) -> bool:
        """Run ``sweep`` if no task is pending or processing and any was finished since the last sweep. A crash before its record
        runs it again, so it should be of the kind that may; a record is made once for each drain."""
        states = self.read()
        n = states.agg(F.count_if(F.col("status").isin("pending", "processing")).alias("open"), F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("n_commands"))), F.lit(0)).alias("done")).first()
        state = self.state()
        self._checked(state)
        if n.open or not n.done or n.done == state.get("swept", 0):
            return False
        sweep()
        taken = []

        def change(s: dict) -> dict | None:
            self._checked(s)
            taken.clear()
            if s.get("swept", 0) == n.done:
                return None
            taken.append(1)
            return {**s, "swept": n.done, "sweeps": s.get("sweeps", 0) + 1}

        self._keep(change)
        return bool(taken)


def into(table: EpochTable, sweep: Callable[[], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the newest state of each task, taken once for each epoch, and the sweep that may follow."""

    def run(df: DataFrame, epoch: int) -> None:
        table.take(newest_states(df.withColumn("batch", F.lit(epoch))), epoch)
        if sweep:
            table.drained(sweep)

    return run
