"""Whitening of embeddings from an exact integer scatter matrix.

Each entry ``c`` becomes the integer ``x = floor(1024 * c) + 100000``. A pass over the vectors takes ``SHIFT`` from every
``x`` and adds up sums and cross-products per partition: as a product of doubles where all partial sums stay below 2^53
(so it is exact), else in Python's integers of any size. The sums leave a task as 32-bit limbs, which Spark adds per
(row, column, limb), so no number is ever rounded or can overflow. The driver gets the d(d+1)/2 sums of d dimensions,
which do not grow with the rows, forms ``n * XtX - S * St`` as integers (the shift cancels), and only then turns them into
doubles and decomposes them. A second pass projects each row; the whitened values are written to the shared folder, their
covariance is measured there, and rows come out one for each component.

Rows whose vector is null or empty, or holds null or non-finite entries, are left out; so are vectors of another length
than most have (of equally frequent lengths, the longest counts). Ids may be null and rows may repeat; every row counts.
Entries of any finite size are taken exactly. Components without variance (an eigenvalue of no more than rounding error)
have no whitened value and are left out, so equal vectors give no rows. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Fixed values of the result's definition.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8

#: Taken from every integer before products are formed; any value gives the same scatter matrix.
SHIFT = OFFSET
#: Integers up to this size are exact in a double.
EXACT = 1 << 53
LIMB = 32
ROWS = 8192


def shifted(c: np.ndarray) -> np.ndarray:
    """``floor(SCALE * c) + OFFSET - SHIFT`` of finite doubles: int64, or Python's integers where int64 could not hold them."""
    if c.size and np.abs(c).max() >= 2.0**50:
        # beyond 2^53 a double is an integer, so no product is rounded
        whole = [int(v) * SCALE if abs(v) >= EXACT else int(np.floor(v * SCALE)) for v in c.ravel().tolist()]
        return np.array([v + OFFSET - SHIFT for v in whole], object).reshape(c.shape)
    return np.floor(c * SCALE).astype(np.int64) + (OFFSET - SHIFT)


def products(y: np.ndarray) -> np.ndarray:
    """The cross-products of the columns of ``y``, exact, in Python's integers."""
    n, d = y.shape
    most = max(1, max(abs(int(y.max())), abs(int(y.min())))) if y.size else 1
    rows = EXACT // (most * most)
    if y.dtype == object or not rows:
        y = y.astype(object)
        return y.T.dot(y)
    out = np.zeros((d, d), object)
    for at in range(0, n, rows):
        part = y[at : at + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, 32 bits) of an integer, each with its sign; zeros are left out."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if low := value & ((1 << LIMB) - 1):
            yield k, sign * low
        value, k = value >> LIMB, k + 1


def _vectors(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    """The vectors of a batch without nulls, all of ``d`` entries."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: rows with a vector of finite doubles and at least one entry."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.select(F.col(id_col).alias("id"), v.alias("v")).where("size(v) > 0").where(~bad)


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, shifted sums and shifted cross-products of the vectors ``v``, as integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, xx = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = shifted(_vectors(batch.slice(at, ROWS), 0, d))
                n += len(y)
                s += y.astype(object).sum(0) if y.dtype == object else y.sum(0, dtype=np.int64).astype(object)
                xx += products(y)
        # row -1 holds the sums, and the count in place d
        cells = [(-1, d, n), *((-1, j, s[j]) for j in range(d)), *((i, j, xx[i, j]) for i in range(d) for j in range(i, d))]
        found = [(i, j, k, v) for i, j, x in cells for k, v in limbs(int(x))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "v"])

    sums = vectors.select("v").mapInArrow(run, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    n, s, xx = 0, [0] * d, [[0] * d for _ in range(d)]
    for i, j, k, v in zip(*(c.to_pylist() for c in sums.toArrow().columns)):
        v <<= LIMB * k
        if i >= 0:
            xx[i][j] += v
        elif j < d:
            s[j] += v
        else:
            n += v
    for i in range(d):
        for j in range(i):
            xx[i][j] = xx[j][i]
    return n, s, xx


def decomposed(n: int, s: list[int], xx: list[list[int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Falling eigenvalues, their unit eigenvectors (columns; the largest entry is positive) and the trace of the covariance.
    ``n * XtX - S * St`` is formed in integers; each entry is rounded once."""
    d = len(s)
    v = np.array([[(n * xx[i][j] - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)])
    trace = sum(n * xx[i][i] - s[i] * s[i] for i in range(d)) / (n * n)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    held = e > max(float(e[0]), 0.0) * d * 1e-15
    return e[held], u[:, held], trace


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error``: one row per
    vector, its whitened components by falling eigenvalue. The deviation is exact, and null beyond 38 digits."""
    spark, kind = table.sparkSession, table.schema[id_col].dataType
    vectors = usable(table, id_col, vector_col)
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], f"{id_col} {kind.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    if not sizes:
        return empty
    d = sizes[0].d
    vectors = vectors.where(F.size("v") == d)
    n, s, xx = scatter(vectors, d)
    e, u, trace = decomposed(n, s, xx)
    if not len(e):
        return empty
    e, u = e[:components], u[:, :components]
    unit = u / np.sqrt(e)
    small = all(abs(v) < 1 << 62 for v in s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, most = np.array(s, object), isqrt((1 << 63) // d) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = shifted(_vectors(part, 1, d))
                fits = small and y.dtype != object and n * max(abs(int(y.max())), abs(int(y.min()))) < 1 << 62
                z = y * n - sums.astype(np.int64) if fits else y.astype(object) * n - sums
                if z.dtype == object or max(abs(int(z.max())), abs(int(z.min()))) > most:
                    dev = [sum(int(v) ** 2 for v in row) for row in z.tolist()]
                else:
                    dev = (z * z).sum(1).tolist()
                w = (z / n).astype(np.float64) @ unit
                flat = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([str(x) for x in dev]), flat], names=["id", "deviation", "w"])

    made = vectors.select("id", "v").mapInArrow(run, f"id {kind.simpleString()}, deviation string, w array<double>")
    made = written(made.select("id", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "w"), "whitened")
    m = len(e)
    at = lambda k: F.get("w", F.lit(k))
    off = [F.abs(F.covar_pop(at(i), at(j)) - (1.0 if i == j else 0.0)) for i in range(m) for j in range(i, m)]
    worst = max(made.agg(*off).first())
    share = F.array(*(F.lit(float(x / trace)) for x in e))
    return made.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), share.alias("explained"), F.lit(float(worst)).alias("identity_error"))
