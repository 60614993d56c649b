"""Tables kept by key: vectors by page, groups that are no duplicates; JSON state; and the interfaces of outer services."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.vectors import checked_chunks
from tessera.sources.versions import KeyedTable

CHUNK_SCHEMA = "chunk_id string, page_id string, chunk_index long, chunk_text string, heading_path string, vector array<float>"


class VectorStore(KeyedTable):
    """Chunks of pages with their vectors."""

    def __init__(self, spark: SparkSession, root: str, dim: int):
        super().__init__(spark, root, CHUNK_SCHEMA, "page_id")
        self.dim = dim

    def upsert(self, incoming: DataFrame) -> int:
        """Replace the rows of the pages that come; an empty batch changes nothing, wrong dimensions are an error."""
        n = incoming.count()
        if not n:
            return self.newest()
        good = checked_chunks(incoming, self.dim)
        if good.count() != n:
            raise ValueError(f"every row needs a page id and a vector of {self.dim} numbers")
        return super().upsert(good)


NOT_DUPLICATES = "key string, slugs array<string>"


def declare_different(table: KeyedTable, groups: DataFrame) -> int:
    """Add groups of pages (``slugs``) that are no duplicates to a table of schema ``NOT_DUPLICATES``; a group that is there
    already, in any order and case, is not added again. Returns how many were new."""
    from tessera.functions.text import group_key

    have = table.read()
    new = groups.where(F.size(F.array_distinct(F.transform("slugs", F.lower))) > 1).select(group_key(F.array_distinct(F.transform("slugs", F.lower))).alias("key"), F.array_sort("slugs").alias("slugs"))
    new = new.groupBy("key").agg(F.min("slugs").alias("slugs")).join(have.select("key"), "key", "left_anti")
    n = new.count()
    if n:
        table.upsert(new)
    return n


def read_state(spark: SparkSession, path: str, schema: str, keep_last: int | None = None, by: str | None = None, order: str | None = None) -> DataFrame:
    """A JSON state document as rows; of each group only the last ``keep_last`` if asked for."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    if keep_last is None:
        return df
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep_last).drop("_r")


def reembed(store: VectorStore, pages: DataFrame, call: Callable[[str], list[float]]) -> None:
    """The chunks of changed pages (``page_id, title, content``) embedded anew; rows of other pages stay."""
    from tessera.functions.markdown import chunks

    each = pages.select("page_id", "title", F.explode(chunks()("content")).alias("c"))
    rows = each.select(F.concat_ws("#", "page_id", F.col("c.index").cast("string")).alias("chunk_id"), "page_id", F.col("c.index").alias("chunk_index"), F.col("c.text").alias("chunk_text"), F.col("c.heading_path").alias("heading_path"), "title")
    store.upsert(embed(rows, call))


# interfaces of services that need a network: the caller injects the call

SHORTEST, TRIES = 64, 3


def embed_with_retries(text: str, call: Callable[[str], list[float]], too_long: Callable[[Exception], bool]) -> list[float] | None:
    """The vector of a text; where the service finds it too long, of its first half, three times at most."""
    for _ in range(TRIES + 1):
        try:
            return call(text)
        except Exception as e:
            if not too_long(e) or len(text) // 2 < SHORTEST:
                return None
            text = text[: len(text) // 2]
    return None


def hash_embedding(dim: int = 64) -> Callable[[str], list[float]]:
    """A stand-in for a service: word hashes summed and normalised, the same everywhere."""
    import zlib

    def call(text: str) -> list[float]:
        v = np.zeros(dim)
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h & 1024 else -1
        n = float(np.linalg.norm(v))
        return (v / n if n else v).astype(np.float32).tolist()

    return call


def embed(chunks: DataFrame, call: Callable[[str], list[float]], too_long: Callable[[Exception], bool] = lambda e: False) -> DataFrame:
    """Chunks (``chunk_id, page_id, chunk_index, chunk_text, heading_path, title``) with vectors; failed ones are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = ["\n\n".join(x for x in (t, h, c) if x) for t, h, c in zip(f["title"], f["heading_path"], f["chunk_text"])]
            f = f.assign(vector=[embed_with_retries(t, call, too_long) for t in texts]).drop(columns="title")
            yield f[f["vector"].notna()]

    return chunks.select("chunk_id", "page_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text", "heading_path", "title").mapInPandas(run, CHUNK_SCHEMA)
