"""Changes of several tables that survive a crash in the middle.

A change is first worked out and staged: each step's rows are written to the journal's folder, and then one record names
the steps. From then on the change will happen: ``apply`` does the steps in their order and records each as done; after a
crash the next ``apply`` goes on with the first step that is not recorded. A step replaces or deletes rows of a keyed table
by what was staged, so doing it again, after a crash between the step and its record, changes nothing. A crash before
the record leaves staged rows that nothing names, and no table changed. Changes of one journal are applied in the order in
which they were begun, by any number of workers.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import file_name, file_stem
from tessera.operators import ingest as N
from tessera.sources.versions import KeyedTable, Versions

#: How often a change gives up its own work because the tables moved on under it.
TRIES = 5


class Journal(Versions):
    """``tables``: the keyed tables by name."""

    def __init__(self, spark, root: str, tables: dict[str, KeyedTable]):
        super().__init__(spark, root)
        self.tables = tables

    def begin(self, kind: str, steps: list[tuple[str, str, DataFrame]], based_on: dict[str, int] | None = None) -> str | None:
        """Stage ``steps`` (table, ``upsert`` or ``delete``, rows) and record them as one change; returns its id. With ``based_on``, the
        versions of the tables that the rows were worked out from, nothing is recorded (None) if a table has moved on, or
        while another change waits."""
        name = f"{kind}-{uuid.uuid4().hex[:12]}"
        for i, (_, _, rows) in enumerate(steps):
            rows.write.parquet(f"{self.root}/staged/{name}/{i}")
        record = {"id": name, "kind": kind, "steps": [{"table": t, "do": do, "schema": rows.schema.simpleString()[7:-1]} for t, do, rows in steps], "done": 0, "at": time.time()}
        taken = []

        def change(state: dict) -> dict | None:
            taken.clear()
            if based_on is not None and (state.get("open") or any(self.tables[t].newest() != v for t, v in based_on.items())):
                return None
            taken.append(name)
            return {"open": [*state.get("open", []), record], "closed": state.get("closed", [])}

        self.update(change)
        return name if taken else None

    def waiting(self) -> list[dict]:
        return self.read().get("open", [])

    def _rows(self, change: dict, i: int) -> DataFrame:
        return self.spark.read.schema(change["steps"][i]["schema"].replace(":", " ")).parquet(f"{self.root}/staged/{change['id']}/{i}")

    def apply(self) -> list[str]:
        """Finish all changes that were begun. Returns the ids of those that this call closed."""
        closed = []
        while todo := self.waiting():
            change = todo[0]
            for i in range(change["done"], len(change["steps"])):
                step = change["steps"][i]
                table = self.tables[step["table"]]
                rows = self._rows(change, i)
                table.upsert(rows) if step["do"] == "upsert" else table.delete(rows)
                self._record(change["id"], i + 1)
            if self._close(change["id"]):
                closed.append(change["id"])
        return closed

    def _record(self, name: str, done: int) -> None:
        def change(state: dict) -> dict | None:
            hit = [c for c in state.get("open", []) if c["id"] == name and c["done"] < done]
            return {**state, "open": [{**c, "done": done} if c in hit else c for c in state["open"]]} if hit else None

        self.update(change)

    def _close(self, name: str) -> bool:
        mine = []

        def change(state: dict) -> dict | None:
            mine.clear()
            if all(c["id"] != name for c in state.get("open", [])):
                return None
            mine.append(name)
            return {"open": [c for c in state["open"] if c["id"] != name], "closed": [*state.get("closed", []), name][-100:]}

        self.update(change)
        if mine:
            self._fs.delete(self._path(f"{self.root}/staged/{name}"), True)
        return bool(mine)

    def _planned(self, kind: str, plan) -> list[str]:
        """Work out, begin and apply a change that reads the tables; once more if they moved on meanwhile."""
        for _ in range(TRIES):
            self.apply()
            based_on = {name: t.newest() for name, t in self.tables.items()}
            if name := self.begin(kind, plan(), based_on):
                return [c for c in self.apply() if c == name] or [name]
        raise RuntimeError(f"{kind}: the tables moved on {TRIES} times while it was worked out")


PAGES, HISTORY = "path string, content string", "path string, content string"


def execute_merges(journal: Journal, merges: DataFrame, today: str, now: Column) -> list[str]:
    """Groups of duplicates merged for good, in the tables ``pages`` (path, content), ``history`` and, if there are any,
    ``vectors`` (page_id). Replaced and deleted texts go to the history first; then canonical pages are written, other pages
    led to them, index lines taken out, merged pages deleted, and their vectors with them."""
    pages = journal.tables["pages"]

    def plan():
        out = N.merge_duplicates(pages.read(), merges, today)
        writes, deletes = out["writes"], out["deletes"]
        index = F.lower(file_name(F.col("path"))) == "index.md"
        canon = merges.select(F.col("canonical").alias("slug")).distinct()
        named = writes.withColumn("slug", file_stem(F.col("path")))
        backups = N.backups(writes.select("path", "backup").unionByName(deletes.select("path", "backup")), now)
        steps = [
            ("history", "upsert", backups),
            ("pages", "upsert", named.join(canon, "slug", "left_semi").select("path", "content")),
            ("pages", "upsert", named.join(canon, "slug", "left_anti").where(~index).select("path", "content")),
            ("pages", "delete", deletes.select("path")),
            ("pages", "upsert", named.join(canon, "slug", "left_anti").where(index).select("path", "content")),
        ]
        if "vectors" in journal.tables:
            steps.append(("vectors", "delete", deletes.select(file_stem(F.col("path")).alias("page_id"))))
        return steps

    return journal._planned("merge", plan)


def execute_deletion(journal: Journal, doomed: DataFrame, now: Column) -> list[str]:
    """Pages (``path``) deleted for good with all that points to them: the history gets every text that changes or goes, then pages that
    named them are rewritten, index lines among them, the pages are deleted, and their vectors."""
    pages = journal.tables["pages"]

    def plan():
        have = pages.read()
        gone = have.join(doomed.select("path").distinct(), "path", "left_semi")
        after = N.cascade_delete(have.withColumn("file_name", file_name(F.col("path"))), doomed)["pages"]
        changed = after.join(have.withColumnRenamed("content", "backup"), "path").where("content <> backup")
        backups = N.backups(changed.select("path", "backup").unionByName(gone.select("path", F.col("content").alias("backup"))), now)
        steps = [("history", "upsert", backups), ("pages", "upsert", changed.select("path", "content")), ("pages", "delete", gone.select("path"))]
        if "vectors" in journal.tables:
            steps.append(("vectors", "delete", gone.select(file_stem(F.col("path")).alias("page_id"))))
        return steps

    return journal._planned("deletion", plan)


def execute_source_deletion(journal: Journal, sources: DataFrame, day: str, now: Column) -> list[str]:
    """Sources (``source``) deleted for good: pages lose them from their lists or go with their last source, as
    ``delete_source_cascade`` says, and entries of the table ``cache`` (name) go, if there is one."""
    pages = journal.tables["pages"]

    def plan():
        have = pages.read()
        cache = journal.tables["cache"].read() if "cache" in journal.tables else journal.spark.createDataFrame([], "name string")
        out = N.delete_source_cascade(have.withColumn("file_name", file_name(F.col("path"))), sources, cache, day)
        gone = have.join(out["deleted"], "path", "left_semi")
        changed = out["pages"].join(have.withColumnRenamed("content", "backup"), "path").where("content <> backup")
        backups = N.backups(changed.select("path", "backup").unionByName(gone.select("path", F.col("content").alias("backup"))), now)
        steps = [("history", "upsert", backups), ("pages", "upsert", changed.select("path", "content")), ("pages", "delete", gone.select("path"))]
        if "vectors" in journal.tables:
            steps.append(("vectors", "delete", gone.select(file_stem(F.col("path")).alias("page_id"))))
        if "cache" in journal.tables:
            steps.append(("cache", "delete", sources.select(F.col("source").alias("name"))))
        return steps

    return journal._planned("source-deletion", plan)
