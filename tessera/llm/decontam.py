"""Benchmark decontamination by winnowing.

Every text is turned into word numbers (0 for a word that no benchmark item has); of the hashes of its runs of ``K``
words, winnowing keeps the least of each ``W`` in a row. A span of ``WINDOW = K + W - 1`` words that a document
shares with an item has all ``W`` of its runs in common with it, so both keep the same run of it: joining the kept
fingerprints of documents with those of the items finds every such span. Each hit is extended to the windows of
``WINDOW`` words around it, which are compared word for word, so a collision of hashes changes nothing.

An item of fewer words than ``WINDOW`` is one window as a whole; it is too short for the guarantee, so the hash of all its
words is its fingerprint, sought at every place.

Documents and items with null texts have no words; items without words never occur. An item id that repeats counts
once, and an item without an id counts in ``n_hit`` alone. Rows of documents are judged one by one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import alnum_words, bitmap, gram_hashes, in_bitmap, mix, paths_of, remove, row_key, rows, sliding_min, word_hashes_128, written

WINDOW, K = 13, 5
W = WINDOW - K + 1

#: Benchmarks of up to this many bytes of text go to every executor as one index; larger ones are dealt out by
#: fingerprint and joined.
MAX_INDEX_BYTES = 4 << 20

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class BenchmarkIndex:
    """Vocabulary, fingerprints and windows of benchmark items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.vocab: dict[str, int] = {}
        self.windows: dict[bytes, set] = {}
        self.short: dict[int, dict[bytes, set]] = {}
        prints = []
        for item, text in items:
            words = alnum_words(text)
            if not words:
                continue
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint64)
            raw, size = ids.astype("<u4").tobytes(), min(WINDOW, len(ids))
            into = self.windows if size == WINDOW else self.short.setdefault(size, {})
            for i in range(len(ids) - size + 1):
                into.setdefault(raw[4 * i : 4 * (i + size)], set()).add(item)
            if size == WINDOW:
                h = gram_hashes(ids, K)
                prints.append(h[sliding_min(h, W)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        self.heads = {n: np.array(sorted({int.from_bytes(k[:4], "little") for k in d}), np.uint32) for n, d in self.short.items()}
        # one bit for the low bits of each fingerprint: most of a document's fingerprints end here
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.prints & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def judge(self, texts: list[str]) -> list[tuple]:
        """n_words, n_hit, n_items, items_sha256, contaminated of each text."""
        get, per = self.vocab.get, [alnum_words(t) for t in texts]
        sizes = [len(p) for p in per]
        # texts in a row, a word that matches nothing between them
        flat = np.zeros(sum(sizes) + len(sizes), np.uint32)
        starts, at = [], 0
        for words in per:
            starts.append(at)
            flat[at : at + len(words)] = [get(w, 0) for w in words]
            at += len(words) + 1
        hit = np.zeros(len(flat), bool)
        found: dict[int, set] = {}
        of = np.repeat(np.arange(len(per)), [n + 1 for n in sizes])

        def mark(i: int, size: int, items: set) -> None:
            hit[i : i + size] = True
            found.setdefault(int(of[i]), set()).update(items)

        raw = flat.tobytes()
        if len(self.prints) and len(flat) >= WINDOW:
            h = gram_hashes(flat.astype(np.uint64), K)
            kept = sliding_min(h, W)
            kept = kept[self.bits[(h[kept] & np.uint64((1 << 20) - 1)).astype(np.int64)]]
            near = self.prints[np.minimum(np.searchsorted(self.prints, h[kept]), len(self.prints) - 1)]
            hits, done = kept[near == h[kept]], -1
            for p in hits.tolist():
                for i in range(max(done + 1, p - W + 1, 0), p + 1):
                    if items := self.windows.get(raw[4 * i : 4 * (i + WINDOW)]):
                        mark(i, WINDOW, items)
                done = max(done, p)
        for size, windows in self.short.items():
            for i in np.flatnonzero(np.isin(flat, self.heads[size])).tolist():
                if items := windows.get(raw[4 * i : 4 * (i + size)]):
                    mark(i, size, items)
        out = []
        for d, (s, n) in enumerate(zip(starts, sizes)):
            out.append(verdict(n, int(hit[s : s + n].sum()), found.get(d, ())))
        return out


def verdict(n_words: int, n_hit: int, items) -> tuple:
    names = sorted({str(i) for i in items if i is not None})
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def _batch(ids: list, rows_: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows_))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)


#: The index that this process built last, by the name of its benchmark: tasks of one query share it.
_built: dict[str, BenchmarkIndex] = {}


def _index(name: str, items: list[tuple[object, str | None]]) -> BenchmarkIndex:
    if name not in _built:
        _built.clear()
        _built[name] = BenchmarkIndex(items)
    return _built[name]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``.

    The benchmark's size is measured first. Up to ``max_index_bytes`` it is one broadcast index, and documents are
    judged where they lie, without a shuffle. Beyond that see ``decontaminate_large``.
    """
    # items without text have no windows; those that are left are counted before any of them is fetched
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text")).where("length(item_text) > 0")
    size = items.agg(F.sum(F.octet_length("item_text") + F.lit(64)).alias("n")).first()["n"] or 0
    if size > max_index_bytes:
        return decontaminate_large(docs, items, id_col, text_col)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])
    kind, names, name = docs.schema[id_col].dataType, [id_col, *(f.split()[0] for f in RESULT.split(", "))], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared.value)
        for batch in batches:
            for ids, texts in rows([batch]):
                yield _batch(ids, index.judge(texts), batch.column(0).type, names)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, {RESULT}")


def _halves(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [word_hashes_128(alnum_words(t)) for t in texts]


def _window_keys(low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each run of ``size`` words, as two columns."""
    return gram_hashes(low, size), gram_hashes(mix(high), size)


def _of_items(items: DataFrame) -> DataFrame:
    """Of each item its windows (``item_id, size, a, b``) and its fingerprints (``size, h``: the window's size and a hash)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in rows([batch]):
                out: list[tuple] = []
                for item, (low, high) in zip(ids, _halves(texts)):
                    size = min(WINDOW, len(low))
                    if size:
                        a, b = _window_keys(low, high, size)
                        out += [(item, size, x, y, None) for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist())]
                        h = gram_hashes(low, K)[sliding_min(gram_hashes(low, K), W)] if size == WINDOW else a
                        out += [(None, size, None, None, x) for x in h.view(np.int64).tolist()]
                cols = list(zip(*out)) or [()] * 5
                kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item_id", "size", "a", "b", "h"])

    return items.mapInArrow(run, f"item_id {kind}, size int, a long, b long, h long").distinct()


def decontaminate_large(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """As ``decontaminate``, for a benchmark that no executor should hold as a whole.

    The items' fingerprints are set in a bitmap of bounded size. Documents are read once: their own fingerprints are looked
    up in it, and each hit is extended to the windows around it (those of items under ``WINDOW`` words are looked up at
    every place). So only hashes of such windows leave a document, never its text, and they are joined with the items'
    windows on 128 bits. A fuller bitmap lets more windows through to the join and changes nothing else. A document's
    window takes one salt and an item's takes all, so that a window that very many documents have is dealt to ``salts``
    tasks; spans and items of a document then add up.
    """
    spark = docs.sparkSession
    of_items = written(_of_items(items.where(F.length("item_text") > 0)), "benchmark-windows")
    windows = of_items.where("a IS NOT NULL").select("item_id", "size", "a", "b")
    prints = of_items.where("h IS NOT NULL")
    sizes = sorted(r["size"] for r in prints.where(f"size < {WINDOW}").select("size").distinct().collect())  # at most 12
    maps = {}
    for name, some in (("long", prints.where(f"size = {WINDOW}")), ("short", prints.where(f"size < {WINDOW}"))):
        n = some.count()
        if n:
            maps[name] = bitmap(some, n)
    shared = spark.sparkContext.broadcast(maps)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            both = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int32()), batch.column(2)], names=["i", "text"])
            for at, texts in rows([both]):
                mine, n_words, found = batch.take(pa.array(at, pa.int32())), [], []
                for i, (low, high) in enumerate(_halves(texts)):
                    n_words.append(len(low))
                    if "long" in tables and len(low) >= WINDOW:
                        h = gram_hashes(low, K)
                        kept = sliding_min(h, W)
                        kept = kept[in_bitmap(h[kept], *tables["long"])]
                        if len(kept):
                            starts = np.unique(np.clip(kept[:, None] - np.arange(W), 0, len(low) - WINDOW))
                            a, b = _window_keys(low, high, WINDOW)
                            found.append((i, WINDOW, starts, a[starts], b[starts]))
                    for size in sizes:
                        if len(low) >= size:
                            a, b = _window_keys(low, high, size)
                            starts = np.flatnonzero(in_bitmap(a, *tables["short"]))
                            found.append((i, size, starts, a[starts], b[starts]))
                n = len(at)
                yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), pa.array(n_words, pa.int64()), *(pa.nulls(n, k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=names)
                for i, size, starts, a, b in found:
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, mine.column(0).type), pa.array([mine.column(1)[i].as_py()] * n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(np.full(n, size, np.int32)), pa.array(starts.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    names = ["id", "rk", "n_words", "size", "start", "a", "b"]
    keyed = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    seen = written(keyed.mapInArrow(run, f"id {kind}, rk binary, n_words long, size int, start long, a long, b long"), "document-windows")
    salted = seen.where("size IS NOT NULL").select("rk", "size", "start", "a", "b", F.pmod(F.xxhash64("rk", "start"), F.lit(salts)).cast("int").alias("salt")).distinct()
    every = windows.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    hits = written(salted.join(every, ["size", "a", "b", "salt"]).select("rk", "start", "size", "item_id"), "hits")
    before = Window.partitionBy("rk").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("rk", F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e")).distinct()
    n_hit = spans.withColumn("m", F.coalesce(F.max("e").over(before), F.lit(0))).groupBy("rk").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "m"))).alias("n_hit"))
    items_of = hits.select("rk", F.col("item_id").cast("string").alias("x")).distinct().groupBy("rk").agg(F.array_sort(F.collect_list("x")).alias("names"))
    judged = written(n_hit.join(items_of, "rk"), "judged")
    for gone in (of_items, hits):
        for p in paths_of(gone):
            remove(spark, p)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return seen.where("size IS NULL").join(judged, "rk", "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
