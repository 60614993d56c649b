"""Helpers shared by the training-data operators: shared storage, row iteration, word and hash rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: Words of the contamination, licence and near-duplicate operators, after A-Z are lower-cased: fixed values.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_alnum = re.compile(ALNUM_WORD)


ARROW_ROWS = 1000


def written(df: DataFrame, name: str, keys: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and Catalyst knows the size. While it is
    written, rows go to Python workers in batches of at most ``ARROW_ROWS``, which bounds what a task holds of long texts
    outside the heap; the session's setting is put back afterwards. A table of ``keys`` alone (no texts or signatures) is
    written by an eighth of the tasks that shuffles of texts are set to, so that it does not come in as many tiny files."""
    spark = df.sparkSession
    path, setting = shared_dir(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    if int(before) <= 0 or int(before) > ARROW_ROWS:
        spark.conf.set(setting, str(ARROW_ROWS))
    out = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)) if keys else df
    try:
        out.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, wherever Spark's file systems keep it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def row_key(id_col: str, text_col: str, *more: str) -> Column:
    """128 bits of a hash of id, text and more columns (null texts as empty ones, other nulls as values of their own)."""
    def part(name: str) -> Column:
        x = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    return F.unhex(F.md5(F.concat(*map(part, (id_col, *more)), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))))


#: Tables of at most this many rows (of a few longs) are broadcast, after they were counted; others are shuffled.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, most: int | None = None, items: Column | None = None) -> DataFrame:
    """A table, marked for broadcast only if its counted rows are few enough; rows with arrays count as so many as their
    ``items``. It is worked out twice, so it should be written or follow from a written one by little work."""
    n = df.count() if items is None else df.agg(F.sum(1 + items).alias("n")).first().n or 0
    return F.broadcast(df) if n <= (BROADCAST_ROWS if most is None else most) else df


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """The rows of ``df`` as one column ``row`` beside ``more``, so that no name of theirs clashes with others."""
    return df.select(*more, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until it is none of ``taken`` (names are compared as Spark does)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def paths_of(df: DataFrame) -> list[str]:
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


def lower_ascii(text: str) -> str:
    """A-Z in lower case; bytes know no other letters."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def alnum_words(text: str | None) -> list[str]:
    return _alnum.findall(lower_ascii(text)) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_hashes_128(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves of 128-bit hashes of words."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def bitmap(hashes: DataFrame, n: int, least_bits: int = 1 << 20, most_bits: int = 1 << 28) -> tuple[np.ndarray, int]:
    """Bits (packed into bytes) of the ``n`` values of column ``h``, by their low bits, and how many bits there are: 16 a value
    within the bounds, so that what the driver and every worker hold is bounded. Bits are set in a distributed
    grouping; the driver gets them as 64-bit words."""
    bits = least_bits
    while bits < most_bits and bits < 16 * n:
        bits *= 2
    word = F.shiftright(F.col("h").bitwiseAND(F.lit(bits - 1)), 6).alias("w")
    got = hashes.groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, cast((h & {bits - 1}L) & 63L as int)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.view(np.uint8), bits


def in_bitmap(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have their bit set."""
    low = (h & np.uint64(bits - 1)).astype(np.int64)
    return (table[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0


def rows(batches: Iterator[pa.RecordBatch], max_chars: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of two-column batches, in slices of about ``max_chars`` characters, so that memory follows the
    longest text and not the number of rows of a batch. Null texts come as empty ones."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at, n, some, some_ids = 0, len(ids), [], []
        size = 0
        for at in range(n):
            text = texts[at].as_py() or ""
            some.append(text)
            some_ids.append(ids[at].as_py())
            size += len(text)
            if size >= max_chars:
                yield some_ids, some
                some, some_ids, size = [], [], 0
        if some:
            yield some_ids, some


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word hashes; shorter input gives none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= np.uint64(0x5851F42D4C957F2D)
        h += words[i : i + n]
    return mix(h)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Positions kept by winnowing: the rightmost minimum of each window of ``w`` values (all but one if fewer)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.empty(0, np.int64)
    best = h[:n].copy()
    at = np.zeros(n, np.int32)
    for i in range(1, w):
        now = h[i : i + n]
        le = now <= best
        np.copyto(best, now, where=le)
        at[le] = i
    return np.unique(at.astype(np.int64) + np.arange(n))


class Bounded(dict):
    """A cache of what ``make`` gives, emptied when it holds ``most`` keys or their lengths add up to more than ``most_chars``; a
    key that is longer than ``longest`` is worked out each time."""

    def __init__(self, make, most: int = 400_000, most_chars: int = 8_000_000, longest: int = 1000):
        super().__init__()
        self.make, self.most, self.most_chars, self.longest, self.held = make, most, most_chars, longest, 0

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most or self.held > self.most_chars:
            self.clear()
            self.held = 0
        self[key] = v = self.make(key)
        self.held += len(key)
        return v
