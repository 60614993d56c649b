"""Vector search: exact scans, page scores, and upserts of chunk tables.

One query is a scan with an expression per row and a top-k per partition. Many queries are packed into a matrix whose
size is checked, and each batch of vectors meets it in one matrix product; candidates are cut to k per batch and query,
so what is shuffled grows with batches and queries, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vector_index import brute_force, exact_tile, usable

TAIL_SHARE, BEST_CHUNKS, LEAST_CHUNKS, OVER_FETCH = 0.3, 3, 30, 3
#: Queries of one matrix: rows times dimensions.
MAX_QUERY_CELLS = 16_000_000


def distance(vector: Column, query: list[float] | Column) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query)) if isinstance(query, list) else query
    pairs = F.zip_with(F.transform(vector, lambda x: x.cast("double")), F.transform(q, lambda x: x.cast("double")), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def similarity(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows with ``distance`` and ``score``; vectors of another dimension are passed over."""
    good = vectors.where(F.size(vector_col) == len(query))
    d = good.withColumn("distance", distance(F.col(vector_col), query)).withColumn("score", similarity(F.col("distance")))
    return d.drop(vector_col).orderBy("distance", id_col).limit(k)


def page_scores(hits: DataFrame, page_col: str | list[str] = "page_id", id_col: str = "chunk_id") -> DataFrame:
    """A page's best chunk plus a bounded share of its others, and its three best chunks; with several columns (a query and a
    page) for each combination. Hits are the top few of a search, so a group is small."""
    keys = [page_col] if isinstance(page_col, str) else page_col
    top, total = F.max("score"), F.sum("score")
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", F.col(id_col).alias("id"))))), 1, BEST_CHUNKS)
    out = hits.groupBy(*keys).agg(top.alias("top"), total.alias("total"), F.count("*").alias("n_chunks"), best.alias("matched"))
    bonus = F.least(TAIL_SHARE * (F.col("total") - F.col("top")), F.greatest(F.lit(0.0), 1 - F.col("top")))
    return out.select(*keys, (F.col("top") + bonus).alias("score"), "n_chunks", "matched")


def search_pages(vectors: DataFrame, query: list[float], k: int = 10, page_col: str = "page_id", id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    hits = nearest(vectors, query, max(OVER_FETCH * k, LEAST_CHUNKS), id_col, vector_col)
    return page_scores(hits, page_col, id_col).orderBy(F.desc("score"), page_col).limit(k)


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, vec_id, distance, rank``: the ``k`` nearest others of each query. Queries of a bounded matrix (counted first) are
    broadcast and meet each batch of vectors; more of them are dealt out in blocks, so that neither the driver nor a task
    holds all."""
    ids = queries.select(F.col(id_col).alias("id"), vector_col)
    size = ids.agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("d")).first()
    if not size.n:
        return vectors.select(F.col(id_col).alias("query_id"), F.col(id_col), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    kind = vectors.schema[id_col].dataType.simpleString()
    if size.n * size.d > MAX_QUERY_CELLS:
        asked = usable(queries, id_col, vector_col, size.d).select(F.col("id").alias("qid"), "v")
        found = brute_force(usable(vectors, id_col, vector_col, size.d), asked, k, size.d)
        return found.select(F.col("qid").alias("query_id"), F.col("id").alias(id_col), "distance", "rank")
    block = ids.toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((block["id"].to_pylist(), np.array(block[vector_col].to_pylist(), np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        asked = pa.table({"qid": pa.array(qid), "v": pa.array(list(q))})
        compare = exact_tile(k, size.d)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                got = compare(pa.table({"id": part.column(0), "v": part.column(1)}), asked).combine_chunks()
                yield pa.RecordBatch.from_arrays([got["qid"].combine_chunks().cast(part.column(0).type), got["id"].combine_chunks(), got["distance"].combine_chunks()], names=["query_id", id_col, "distance"])

    good = usable(vectors, id_col, vector_col, size.d).withColumnRenamed("id", id_col)
    found = good.mapInArrow(run, f"query_id {kind}, {id_col} {kind}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def checked_chunks(chunks: DataFrame, dim: int, page_col: str = "page_id", vector_col: str = "vector") -> DataFrame:
    """Rows that may be stored: a valid page id and a vector of the table's dimension."""
    from tessera.functions.text import is_page_id

    if dim <= 0:
        raise ValueError("vectors need a dimension")
    return chunks.where(is_page_id(F.col(page_col)) & (F.size(vector_col) == dim))


def upsert_pages(table: DataFrame, incoming: DataFrame, page_col: str = "page_id") -> DataFrame:
    """The table with all rows of incoming pages replaced; an empty batch changes nothing."""
    return table.join(incoming.select(page_col).distinct(), page_col, "left_anti").unionByName(incoming)


def delete_pages(table: DataFrame, pages: DataFrame, page_col: str = "page_id") -> DataFrame:
    return table.join(pages.select(page_col).distinct(), page_col, "left_anti")
