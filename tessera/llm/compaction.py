"""Size-tiered sharding: immutable shards, merges of similarly sized runs, and a versioned manifest.

Arrivals are appended as segments: folders of small shards (Parquet files that are never changed). A segment whose shards
are of about the target size is full and left alone. The others belong to tiers by their size, each ``FAN_IN`` times as
large as the one below; where a tier holds ``FAN_IN`` segments or more, they are merged into one segment of shards of the
target size (a large segment of small shards also by itself), so a row is rewritten about once per tier.

Every change is a new version of the manifest, which names the schema and the segments, not their files: it is written
beside its final name and then renamed, which the file system does for one writer only. A reader takes the highest
committed version, or any older one, and never sees half a change; a writer that loses the race reads the new version and
tries again. Merged segments stay where they are until ``vacuum``, which deletes what no kept version names; so readers of
an older version are not disturbed, and leftovers of failed attempts go as well.

All of it is DataFrame reads and writes and file-system calls of the driver on names; rows never leave the JVM. Rows are
kept as they come: nulls, repeated rows and any columns (helper columns take names that the rows do not have). An empty
arrival adds no rows; columns that an arrival lacks are null, and new ones are added to the table's schema.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm.common import free_name, shared_dir

TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Target-sized shards that one merge makes at most.
RUN_SHARDS = 1000


@dataclass(frozen=True)
class Segment:
    path: str
    files: int
    size: int
    arrival: int


class CommitConflict(Exception):
    """Another writer committed the version first."""


class ShardedTable:
    """A table of immutable segments under ``root``."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        """The committed versions that are still kept, oldest first."""
        at = self._path(f"{self.root}/manifest")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The highest committed version, 0 if there is none."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {"schema": None, "segments": []}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{v:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def segments(self, version: int | None = None) -> list[Segment]:
        return [Segment(**x) for x in self._manifest(version)["segments"]]

    def schema(self, version: int | None = None) -> StructType:
        found = self._manifest(version)["schema"]
        return StructType.fromJson(found) if found else StructType([])

    def commit(self, based_on: int, segments: list[Segment], schema: StructType) -> int:
        """Make ``segments`` version ``based_on + 1``; raises CommitConflict if that version exists already."""
        jvm = self.spark._jvm
        draft = self._path(f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "segments": [vars(s) for s in segments]}).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        final = f"{self.root}/manifest/v{based_on + 1:08d}.json"
        try:  # fails if the name is taken
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, self._path(final), how)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(self._path(final)):
                raise CommitConflict(final) from e
            raise
        return based_on + 1

    def _update(self, change, schema: StructType | None = None) -> int | None:
        """Commit ``change`` of the newest segments, however often others come first; nothing if it gives None."""
        while True:
            v = self.version()
            have, now = self.schema(v), change(self.segments(v))
            if now is None:
                return None
            names = {f.name.lower() for f in have}
            try:
                return self.commit(v, now, StructType([*have, *(StructField(f.name, f.dataType) for f in schema or [] if f.name.lower() not in names)]))
            except CommitConflict:
                continue

    # segments

    def _segment(self, path: str, arrival: int) -> list[Segment]:
        """The folder as a segment; none if it holds no shards."""
        at = self._path(path)
        sizes = [f.getLen() for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".parquet")] if self._fs.exists(at) else []
        return [Segment(path, len(sizes), sum(sizes), arrival)] if sizes else []

    def append(self, df: DataFrame, arrival: int = 0) -> int:
        """Add the rows of ``df`` as a segment of small shards, one per task, and commit. Returns the version."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        new = self._segment(path, arrival)
        return self._update(lambda old: [*old, *new], df.schema)

    def append_each(self, df: DataFrame, arrival: Column, arrivals: int) -> int:
        """Append the rows of each arrival (0 to ``arrivals - 1``) as a segment and version of its own, all in one scan."""
        path, name = f"{self.root}/data/{uuid.uuid4().hex}", free_name("arrival", df.columns)
        df.withColumn(name, arrival).write.partitionBy(name).parquet(path)
        for a in range(arrivals):
            new = self._segment(f"{path}/{name}={a}", a)
            self._update(lambda old, new=new: [*old, *new], df.schema)
        return self.version()

    def shards_of(self, size: int) -> int:
        return max(1, size // self.target)

    def full(self, s: Segment) -> bool:
        return 2 * s.size >= self.target and s.files <= self.shards_of(s.size)

    def tier(self, size: int) -> int:
        """0 from the target size on, one less for each factor of ``fan_in`` below it, one more for each above it."""
        return math.floor(math.log(max(size, 1) / self.target, self.fan_in))

    def runs(self, segments: list[Segment]) -> list[list[Segment]]:
        """What to merge next: segments of one tier, oldest first."""
        tiers: dict[int, list[Segment]] = defaultdict(list)
        for s in sorted(segments, key=lambda s: (s.arrival, s.path)):
            if not self.full(s):
                tiers[self.tier(s.size)].append(s)
        out = []
        for t in sorted(tiers):
            run: list[Segment] = []
            for s in tiers[t]:
                if len(run) >= self.fan_in and sum(x.size for x in run) + s.size > RUN_SHARDS * self.target:
                    out.append(run)
                    run = []
                run.append(s)
            if len(run) >= self.fan_in:
                out.append(run)
            else:  # too few of a kind; large segments of many small shards are packed by themselves
                out += [[s] for s in run if 2 * s.size >= self.target]
        return out

    def compact(self) -> int:
        """Merge until no tier has a run: files are packed into tasks of the target size, and no row is shuffled. Each merge
        leaves fewer shards, so this ends."""
        while runs := self.runs(self.segments()):
            for run in runs:
                path = f"{self.root}/data/{uuid.uuid4().hex}"
                size = sum(s.size for s in run)
                self.spark.read.schema(self.schema()).parquet(*(s.path for s in run)).coalesce(self.shards_of(size)).write.parquet(path)
                new, gone = self._segment(path, max(s.arrival for s in run)), {s.path for s in run}

                def change(now: list[Segment], new=new, gone=gone) -> list[Segment] | None:
                    # None: another writer has merged them meanwhile, and what was written here is a leftover
                    return [s for s in now if s.path not in gone] + new if gone <= {s.path for s in now} else None

                self._update(change)
        return self.version()

    def vacuum(self, keep_versions: int = 10, older_than_ms: int = 24 * 3600 * 1000) -> int:
        """Forget all but the newest versions, and delete segments that no kept version names and that are older than any
        writer may need. Returns how many segments went."""
        versions = self.versions()
        for v in versions[:-keep_versions]:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)
        # names without the scheme: listings may spell it otherwise
        plain = lambda p: self._path(p).toUri().getPath()
        named = {plain(s.path) for v in versions[-keep_versions:] for s in self.segments(v)}
        now, n = self.spark._jvm.System.currentTimeMillis(), 0
        for d in self._fs.listStatus(self._path(f"{self.root}/data")):
            parts = [x.getPath() for x in self._fs.listStatus(d.getPath()) if x.isDirectory()]
            old = now - d.getModificationTime() >= older_than_ms
            gone = [p for p in parts or [d.getPath()] if old and plain(p.toString()) not in named]
            n += len(gone)
            for p in [d.getPath()] if parts and len(gone) == len(parts) else gone:
                self._fs.delete(p, True)
        return n

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the file that holds each and its bytes as the last two columns: ``_shard`` and
        ``_size``, under other names where the rows have these."""
        segments, schema = self.segments(version), self.schema(version)
        shard, size = free_name("_shard", schema.names), free_name("_size", schema.names)
        if not segments:
            return self.spark.createDataFrame([], schema).withColumn(shard, F.lit("")).withColumn(size, F.lit(0).cast("long"))
        df = self.spark.read.schema(schema).parquet(*(s.path for s in segments))
        return df.select("*", F.col("_metadata.file_name").alias(shard), F.col("_metadata.file_size").alias(size))


def shard_arrivals(df: DataFrame, arrivals: int = 4, target_bytes: int = TARGET_BYTES, id_col: str = "doc_id", text_col: str = "text", arrival: Column | None = None) -> DataFrame:
    """Append ``df`` as ``arrivals`` batches, compact, and read the newest version back: ``doc_id, arrival, text_sha256,
    n_chars, shard, shard_bytes`` of each stored row, the hash and length of the text as the shard has it (null for a null
    text). ``arrival``: the batch of each row from 0 on, by default a hash of its id; rows for which it is null come first."""
    table = ShardedTable(df.sparkSession, shared_dir(df.sparkSession, "shards"), target_bytes)
    batch = F.coalesce((F.pmod(F.xxhash64(id_col), F.lit(arrivals)) if arrival is None else arrival).cast("int"), F.lit(0))
    table.append_each(df, batch, arrivals)
    table.compact()
    got = table.read()
    shard, size = got.columns[-2:]
    return got.select(id_col, batch.alias("arrival"), F.sha2(F.col(text_col).cast("binary"), 256).alias("text_sha256"), F.length(text_col).cast("long").alias("n_chars"), F.col(shard).alias("shard"), F.col(size).alias("shard_bytes"))
