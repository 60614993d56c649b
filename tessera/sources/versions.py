"""Numbered versions of a state, and tables of which only the touched buckets are written.

A version is a small JSON document, written beside its final name and then renamed, which a file system does for one writer
only: who comes second gets ``Conflict`` and looks again. Nothing that a version names is ever changed; what no version
of the last few names is deleted by ``vacuum`` after a while, so readers of an older version go on undisturbed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer committed this version first."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at = self._path(f"{self.root}/_versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def newest(self) -> int:
        return max(self.numbers(), default=0)

    def read(self, version: int | None = None) -> dict:
        """The state of a version, the newest unless given; of version 0 an empty one."""
        version = self.newest() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_versions/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, based_on: int, state: dict) -> int:
        """Make ``state`` version ``based_on + 1``."""
        draft, final = (self._path(f"{self.root}/_versions/{n}") for n in (f".{uuid.uuid4().hex}", f"v{based_on + 1:08d}.json"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        rename = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, how)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {based_on + 1} of {self.root}") from e
            raise
        return based_on + 1

    def update(self, change: Callable[[dict], dict | None]) -> int:
        """Commit ``change`` of the newest state, however often others come first; nothing if it gives None. Returns the version."""
        while True:
            v = self.newest()
            state = change(self.read(v))
            if state is None:
                return v
            try:
                return self.commit(v, state)
            except Conflict:
                continue

    def delete(self, relative: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{relative}"), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)


BUCKETS, FILE_ROWS = 16, 1_000_000


class KeyedTable(Versions):
    """Rows by a key, dealt into buckets by its hash. A change reads and writes the buckets of its keys alone. Writers need no
    lock: who finds that others committed first goes on if they touched other buckets, and else does its change again on what
    is there now. ``key`` is the first column unless given; all rows of a key are replaced together. Null keys are a key."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str | None = None, buckets: int = BUCKETS):
        super().__init__(spark, root)
        self.schema = schema
        self.columns = spark.createDataFrame([], schema).columns
        self.key, self.buckets = key or self.columns[0], buckets

    def _bucket(self, n: int, key: str | None = None):
        return F.pmod(F.xxhash64(F.col(key or self.key).cast("string")), F.lit(n)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:  # the rows, not the state
        return self._rows(sorted(self.state(version).get("folders", {}).values()))

    def state(self, version: int | None = None) -> dict:
        return super().read(version)

    def update(self, change: Callable[[dict], dict | None]) -> int:
        raise TypeError("change rows by upsert, delete or replace")

    def _keep(self, change: Callable[[dict], dict | None]) -> int:
        """Change what a state holds beside its folders."""
        while True:
            v = self.newest()
            state = change(self.state(v))
            if state is None:
                return v
            try:
                return self.commit(v, state)
            except Conflict:
                continue

    def _write(self, rows: DataFrame, n: int, size: int) -> dict[str, str]:
        """Rows by bucket in a new folder: bucket -> folder. A large bucket is several files, written by several tasks."""
        name, files = f"rows/{uuid.uuid4().hex}", max(1, size // (FILE_ROWS * n))
        dealt = rows.select(*self.columns).withColumn("_b", self._bucket(n))
        dealt.repartition(F.col("_b"), F.pmod(F.monotonically_increasing_id(), F.lit(files))).write.partitionBy("_b").parquet(f"{self.root}/{name}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{name}"))]
        return {f[3:]: f"{name}/{f}" for f in found if f.startswith("_b=")}

    def _change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], extra: Callable[[dict], dict] | None = None) -> int:
        """Replace the rows in the buckets of ``keys`` (a column) by ``change`` of them. ``extra`` gives what else the version holds, from
        the state before it. Returns the version."""
        while True:
            base = self.newest()
            state = self.state(base)
            n, folders = state.get("n", self.buckets), state.get("folders", {})
            touched = [str(r.b) for r in keys.select(self._bucket(n, keys.columns[0]).alias("b")).distinct().collect()]
            if not touched:
                return base
            rows = self._rows([folders[b] for b in touched if b in folders])
            new = self._write(change(rows), n, rows.count())
            while True:
                rest = {b: f for b, f in folders.items() if b not in touched}
                try:
                    return self.commit(base, {**state, "n": n, "folders": rest | new, "at": time.time(), **(extra(state) if extra else {})})
                except Conflict:
                    now = self.newest()
                    latest = self.state(now)
                    if latest.get("n", n) != n or any(latest.get("folders", {}).get(b) != folders.get(b) for b in touched):
                        break  # the same buckets: once more from the start
                    base, state, folders = now, latest, latest.get("folders", {})

    def upsert(self, incoming: DataFrame) -> int:
        """All rows of the keys that come replaced by them. Doing it twice is doing it once."""
        keys = incoming.select(F.col(self.key).alias("_key")).distinct()
        kept = lambda rows: rows.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").unionByName(incoming.select(*self.columns))
        return self._change(keys, kept)

    def delete(self, keys: DataFrame) -> int:  # rows, unlike Versions.delete
        """Without the rows of these keys (a column named as the key)."""
        gone = keys.select(F.col(self.key).alias("_key")).distinct()
        return self._change(gone, lambda rows: rows.join(gone, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti"))

    def replace(self, df: DataFrame) -> int:
        """The whole table; it wins over whatever was there."""
        new = self._write(df, self.buckets, df.count())
        return self._keep(lambda state: {**state, "n": self.buckets, "folders": new, "at": time.time()})

    def count(self) -> int:
        return self.read().count()

    def vacuum(self, keep_versions: int = 10, older_than_s: float = 24 * 3600) -> int:
        """Delete folders of rows that none of the newest versions names and that are older than a writer or reader takes.
        Returns how many went."""
        named = {f.split("/")[1] for v in self.numbers()[-keep_versions:] for f in self.state(v).get("folders", {}).values()}
        at, n = self._path(f"{self.root}/rows"), 0
        for f in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if f.getPath().getName() not in named and time.time() - f.getModificationTime() / 1000 >= older_than_s:
                self._fs.delete(f.getPath(), True)
                n += 1
        return n
