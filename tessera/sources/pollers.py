"""Services that are polled, as data sources: a stream of clips with offsets, and searches in partitions.

The calls are injected: options name a function as ``module:function``, which the readers import, and its argument.

``ClipSource`` (``clips``) polls a service that forgets what it has handed out. Each poll's rows are spooled, under a number,
in a folder that outlives the stream, before the stream hears of them; its offset is how many rows were spooled. A batch
that failed is read from the spool again, so each clip comes once, and what was committed is deleted. The folder is one that
the driver reaches (any file system that pyarrow knows by its address).

``SearchSource`` (``searches``) makes one partition of each query, so that calls run on executors side by side and a lost one
is called again. No queries find nothing.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

CLIP = "title string, url string, text string"
HIT = "query string, place int, title string, url string, snippet string"


def called(name: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def drain_folder(folder: str) -> list[dict]:
    """A stand-in for a service: hands out the JSON files of a folder, in the order of their names, and forgets them."""
    at, root = fs.FileSystem.from_uri(folder)
    out = []
    for f in sorted(at.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
        if f.path.endswith(".json"):
            with at.open_input_stream(f.path) as stream:
                out.append(json.loads(stream.read()))
            at.delete_file(f.path)
    return out


class ClipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clips"

    def schema(self) -> str:
        return CLIP

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return ClipReader(self.options)


class ClipReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.call, self.argument = options["call"], options.get("argument", "")
        self.at, self.root = fs.FileSystem.from_uri(options["spool"])
        self.at.create_dir(self.root, recursive=True)

    def _spooled(self) -> list[tuple[int, int, str]]:
        """(first row, rows, file) of what is spooled."""
        names = [f.path for f in self.at.get_file_info(fs.FileSelector(self.root)) if f.path.endswith(".rows")]
        return sorted((*map(int, p.rsplit("/", 1)[1].removesuffix(".rows").split("-")), p) for p in names)

    def _end(self) -> int:
        return max((first + n for first, n, _ in self._spooled()), default=0)

    def initialOffset(self) -> dict:
        return {"rows": min((first for first, _, _ in self._spooled()), default=0)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = max(self._end(), start["rows"])
        if rows := called(self.call)(self.argument):
            name = f"{self.root}/{end:012d}-{len(rows):09d}"
            with self.at.open_output_stream(f"{name}.draft") as out:
                out.write("\n".join(json.dumps(r) for r in rows).encode())
            self.at.move(f"{name}.draft", f"{name}.rows")
            end += len(rows)
        return self.readBetweenOffsets(start, {"rows": end}), {"rows": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        out = []
        for first, n, path in self._spooled():
            if first < end["rows"] and first + n > start["rows"]:
                with self.at.open_input_stream(path) as stream:
                    lines = stream.read().decode().split("\n")
                for i, line in enumerate(lines):
                    if start["rows"] <= first + i < end["rows"]:
                        row = json.loads(line)
                        out.append((row.get("title"), row.get("url"), row.get("text")))
        return iter(out)

    def commit(self, end: dict) -> None:
        spooled = self._spooled()
        for first, n, path in spooled[:-1]:  # the last one says how far the numbers have come
            if first + n <= end["rows"]:
                self.at.delete_file(path)


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "searches"

    def schema(self) -> str:
        return HIT

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.call, self.queries = options["call"], json.loads(options["queries"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in dict.fromkeys(self.queries)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for place, hit in enumerate(called(self.call)(partition.value) if partition else ()):  # without queries there is no partition
            yield partition.value, place, hit.get("title"), hit.get("url"), hit.get("snippet")


def register(spark: SparkSession) -> None:
    """Make both sources known to a session."""
    for source in (ClipSource, SearchSource):
        spark.dataSource.register(source)


def polled_clips(spark: SparkSession, call: str, argument: str, spool: str):
    """Clips of a service as a stream; start it with a trigger of three seconds."""
    register(spark)
    return spark.readStream.format("clips").option("call", call).option("argument", argument).option("spool", spool).load()


def searched(spark: SparkSession, call: str, queries: list[str]):
    """``query, place, title, url, snippet``: what a service finds for each query."""
    register(spark)
    return spark.read.format("searches").option("call", call).option("queries", json.dumps(queries)).load()


def echo(query: str) -> list[dict]:
    """A stand-in for a search service."""
    return [{"title": f"{query} {i}", "url": f"https://x.org/{query}/{i}", "snippet": query} for i in range(len(query))]
