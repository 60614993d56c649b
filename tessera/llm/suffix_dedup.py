"""Passages that repeat across documents, found with sparse suffix arrays.

Of every ``SAMPLE`` runs of ``K`` words in a row the one with the least hash is retained (content-selected minimisers),
so equal passages retain equal places, and every passage of ``MIN_WORDS`` words has a retained place among its first
``SAMPLE``. Places whose run of ``K`` words occurs once in the corpus cannot match and are dropped early with a bitmap of
bounded size (a false positive only costs work); where there are too many repeated runs for it, they are joined with the
places instead. The suffixes that start at the other places are sorted over the whole
cluster by ranges, each is compared with its neighbours (longest common prefix), and matches are extended to the left.
A place matches if both sides together reach ``MIN_WORDS``.

Neighbours up to ``NEAR`` steps away are compared. Where more suffixes than that agree on enough words, the partner with
the longest left side may lie further off; such places are settled exactly: each of the ``SAMPLE`` windows of ``MIN_WORDS``
words around them is counted over the corpus, in a grouping that combines before the shuffle. So every passage of
``MIN_WORDS`` words that two places share is found, whatever the size of its family, and no family meets in one task:
equal suffixes are spread by a salt, and ranges hand each other ``NEAR`` boundary rows in a second small shuffle.

A result row has the words of the text, how many of them lie in repeated passages, and the passages as word spans.
A passage that repeats within one text counts as well. Null and wordless texts have no passages; rows of equal id and
text count as one row. Words are compared by 64- and 32-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM_WORD, alnum_words, bitmap, gram_hashes, in_bitmap, lower_ascii, mix, packed, paths_of, remove, rows, word_hashes, written

MIN_WORDS = 50
K = 12
SAMPLE = 20
NEAR = 8
LEFT, RIGHT = SAMPLE - 1, MIN_WORDS

#: Bits of the bitmap of repeated runs: 16 a run, within these bounds (the bitmap goes to the driver and every worker).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Boundaries that one group of the second shuffle compares, and salts of the joins on runs and windows.
BOUNDARIES, SALTS = 64, 16


def _retained(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of every ``w`` in a row, the rightmost of equals (the high bits of the hashes count)."""
    mask = np.uint64((1 << max(1, len(h).bit_length())) - 1)
    m = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
    if len(h) < w:
        return np.empty(0, np.int64)
    wide, k = {1: m}, 1
    while 2 * k <= w:
        wide[2 * k] = np.minimum(wide[k][:-k], wide[k][k:])
        k *= 2
    least, done = wide[k], k
    for step in sorted(wide, reverse=True):
        if done + step <= w:
            n = len(h) - done - step + 1
            least, done = np.minimum(least[:n], wide[step][done : done + n]), done + step
    chosen = np.zeros(len(h), bool)
    chosen[(mask - (least & mask)).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def _places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes in a row, where each text starts and ends, the runs' hashes, the retained places (runs across
    two texts and those of texts under ``MIN_WORDS`` words are not retained)."""
    per = [alnum_words(t) for t in texts]
    size = np.array([len(p) for p in per], np.int64)
    ends = np.cumsum(size)
    flat = word_hashes(list(chain.from_iterable(per)))
    h = gram_hashes(flat, K)
    if not len(h):
        return flat, ends - size, ends, h, np.empty(0, np.int64)
    inside = np.repeat(np.where(size >= MIN_WORDS, ends - K, -1), size)[: len(h)] >= np.arange(len(h))
    h[~inside] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = _retained(h, SAMPLE)
    return flat, ends - size, ends, h, at[inside[at]]


def _runs(texts: DataFrame) -> DataFrame:
    """One row for each text (``_id, _row, n_words``) and one for each retained run (``h``), written."""
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int32()), batch.column(2)], names=["i", "text"])
            for i, some in rows([both], 2_000_000):
                _, starts, ends, h, at = _places(some)
                mine, n = batch.take(pa.array(i, pa.int32())), len(at)
                for cols in ([mine.column(0), mine.column(1), pa.array(ends - starts, pa.int64()), pa.nulls(len(i), pa.int64())], [pa.nulls(n, mine.column(0).type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(h[at].view(np.int64))]):
                    yield pa.RecordBatch.from_arrays(cols, names=["_id", "_row", "n_words", "h"])

    return written(texts.select("_id", "_row", "text").mapInArrow(run, f"_id {kind}, _row long, n_words long, h long"), "runs")


def _repeated(runs: DataFrame) -> tuple[DataFrame, int]:
    """The runs retained twice or more (``h``, written) and how many there are."""
    often = written(runs.where("h IS NOT NULL").groupBy("h").count().where("count > 1").select("h"), "repeated-runs")
    return often, often.count()


def _joined_places(texts: DataFrame, often: DataFrame) -> DataFrame:
    """``_row, text, at``: the texts with their retained places whose runs are among ``often``, by a salted join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in rows(batches, 2_000_000):
            _, starts, ends, h, at = _places(some)
            doc = np.searchsorted(ends, at, "right")
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.array(ids, np.int64)[doc]), pa.array(at - starts[doc], pa.int64())], names=["h", "_row", "pos"])

    places = texts.select("_row", "text").mapInArrow(run, "h long, _row long, pos long").withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    salted = often.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    at = places.join(salted, ["h", "salt"], "left_semi").distinct().groupBy("_row").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    return texts.join(at, "_row").select("_row", "text", "at").dropDuplicates(["_row"])


def _suffixes(texts: DataFrame, often: DataFrame, n: int) -> DataFrame:
    """``h, _row, pos, nr, nl, right, left``: the retained suffixes that may match. ``right`` is the next ``RIGHT`` words
    as big-endian 32-bit hashes, so that binary order is suffix order, and ``left`` the ``LEFT`` words before, nearest
    first; both are padded, and ``nr`` and ``nl`` say how many words the text really has there."""
    small = 4 * n <= MOST_BITS
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(often, n, LEAST_BITS, MOST_BITS) if small else None)
    cells = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), len(x), [None, pa.py_buffer(x.astype(">u4").tobytes())]).cast(pa.binary())

    def cut(ids: list, some: list[str], given: list | None) -> Iterator[pa.RecordBatch]:
        flat, starts, ends, h, at = _places(some)
        if given is None:
            at = at[in_bitmap(h[at], *shared.value)]
        else:
            at = np.concatenate([np.array(g, np.int64) + s for g, s in zip(given, starts)] or [at[:0]])
        doc = np.searchsorted(ends, at, "right")
        nr, nl = np.minimum(ends[doc] - at, RIGHT), np.minimum(at - starts[doc], LEFT)
        short = np.concatenate([np.zeros(LEFT, ">u4"), (flat >> np.uint64(32)).astype(">u4"), np.zeros(RIGHT, ">u4")])
        for lo in range(0, len(at), 8192):
            s = slice(lo, lo + 8192)
            right = short[LEFT + at[s, None] + np.arange(RIGHT)] * (np.arange(RIGHT) < nr[s, None])
            left = short[LEFT - 1 + at[s, None] - np.arange(LEFT)] * (np.arange(LEFT) < nl[s, None])
            yield pa.RecordBatch.from_arrays([
                pa.array(h[at[s]].view(np.int64)), pa.array(np.array(ids, np.int64)[doc[s]]), pa.array(at[s] - starts[doc[s]], pa.int64()),
                pa.array(nr[s], pa.int32()), pa.array(nl[s], pa.int32()), cells(right), cells(left),
            ], names=["h", "_row", "pos", "nr", "nl", "right", "left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in rows(batches, 2_000_000):
            yield from cut(ids, some, None)

    def run_given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from cut([batch.column(0)[i].as_py()], [batch.column(1)[i].as_py() or ""], [batch.column(2)[i].as_py()])

    kinds = "h long, _row long, pos long, nr int, nl int, right binary, left binary"
    return texts.select("_row", "text").mapInArrow(run, kinds) if small else _joined_places(texts, often).mapInArrow(run_given, kinds)


@dataclass
class _Block:
    """Rows of the sorted suffixes as arrays."""

    row: np.ndarray
    pos: np.ndarray
    nr: np.ndarray
    nl: np.ndarray
    right: np.ndarray
    left: np.ndarray

    def __len__(self) -> int:
        return len(self.row)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Block:
        cell = lambda k, w: np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u4").astype(np.uint32).reshape(-1, w)
        return cls(*(batch.column(k).to_numpy() for k in range(4)), cell(4, RIGHT), cell(5, LEFT))

    def __getitem__(self, s: slice) -> _Block:
        return _Block(*(x[s] for x in vars(self).values()))

    def __add__(self, other: _Block) -> _Block:
        return _Block(*(np.concatenate([x, y]) for x, y in zip(vars(self).values(), vars(other).values())))


def _common(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, np.minimum(na, nb))


_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(LEFT + RIGHT)], np.uint64)
_BACK = np.array([pow(_BASE, -i, 1 << 64) for i in range(LEFT + 1)], np.uint64)


def _window_hashes(b: _Block, a_least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the block, words before the place, hash) of the windows of ``MIN_WORDS`` words around each place that
    start ``a_least`` words before it or more and lie inside the text."""
    around = np.concatenate([b.left[:, ::-1], b.right], 1).astype(np.uint64) + np.uint64(1)
    total = np.concatenate([np.zeros((len(b), 1), np.uint64), np.cumsum(around * _POWERS, axis=1, dtype=np.uint64)], 1)
    starts = LEFT - np.arange(LEFT + 1)  # of the window with a words before the place, a = 0, 1, ...
    h = mix((total[:, starts + MIN_WORDS] - total[:, starts]) * _BACK[starts])
    a = np.arange(LEFT + 1)
    ok = (a >= a_least[:, None]) & (a <= b.nl[:, None]) & (MIN_WORDS - a <= b.nr[:, None])
    i, k = np.nonzero(ok)
    return i, k, h[i, k]


def _compare(b: _Block, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``lo:hi`` of a sorted block against neighbours: spans (``_row, start, end``) and windows (``_row, start,
    hash``) still to be counted, one set for each distinct surrounding, of rows that more than ``NEAR`` neighbours on a
    side agree with. A window can only repeat if its words from the place on do, so shorter common prefixes rule the
    others out."""
    n = len(b)
    none = np.empty((0, 3), np.int64)
    if n < 2:
        return none, none
    most_l, most_r, longest = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
    deep, again = np.zeros(n, bool), np.zeros(n, bool)
    for step in range(1, min(NEAR, n - 1) + 1):
        r = _common(b.right[:-step], b.nr[:-step], b.right[step:], b.nr[step:])
        l = np.zeros(len(r), np.int64)
        near = np.flatnonzero(r >= MIN_WORDS - LEFT)
        l[near] = _common(b.left[near], b.nl[near], b.left[near + step], b.nl[near + step])
        k = np.flatnonzero((l + r >= MIN_WORDS) & ((b.row[:-step] != b.row[step:]) | (b.pos[:-step] != b.pos[step:])))
        for at in (k, k + step):
            most_l[at] = np.maximum(most_l[at], l[k])
            most_r[at] = np.maximum(most_r[at], r[k])
        if step == 1:
            longest[:-1] = r
            longest[1:] = np.maximum(longest[1:], r)
            same = (r == b.nr[:-1]) & (r == b.nr[1:]) & (l == b.nl[:-1]) & (l == b.nl[1:])
            again[1:] = same & ((b.row[:-1] != b.row[1:]) | (b.pos[:-1] != b.pos[1:]))
        if step == NEAR:
            deep[near] = deep[near + step] = True
    here = np.zeros(n, bool)
    here[lo:hi] = True
    k = np.flatnonzero(here & (most_r >= 0))
    spans = np.stack([b.row[k], b.pos[k] - most_l[k], b.pos[k] + most_r[k]], 1)
    # rows of one surrounding know each other's matches: the first speaks for all
    k = np.flatnonzero(here & deep & ~again)
    i, a, h = _window_hashes(_Block(*(x[k] for x in vars(b).values())), MIN_WORDS - longest[k])
    return spans, np.stack([b.row[k][i], b.pos[k][i] - a, h.view(np.int64)], 1)


#: What a sorted partition returns: spans (0), windows still to be counted (1), its first (2) and last (3) rows.
FOUND = "kind int, _row long, start long, end long, h long, part int, i int, nr int, nl int, right binary, left binary"
_KINDS = dict(zip((f.split()[0] for f in FOUND.split(", ")), (pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 4, pa.binary(), pa.binary())))


def _found(kind: int, n: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _KINDS.items()], names=list(_KINDS))


def _of_compare(spans: np.ndarray, windows: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(spans):
        yield _found(0, len(spans), _row=spans[:, 0], start=spans[:, 1], end=spans[:, 2])
    if len(windows):
        yield _found(1, len(windows), _row=windows[:, 0], start=windows[:, 1], end=windows[:, 1] + MIN_WORDS, h=windows[:, 2])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition, some thousand rows at a time with ``NEAR`` rows of overlap."""
    part, held, lo, first = TaskContext.get().partitionId(), None, 0, None
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            new = _Block.of(batch.slice(at, 8192))
            held = new if held is None else held + new
            first = new[:NEAR] if first is None else (first + new)[:NEAR]
            hi = len(held) - NEAR
            if hi > lo:
                yield from _of_compare(*_compare(held, lo, hi))
                cut = max(0, hi - NEAR)
                held, lo = held[cut:], hi - cut
    if held is None:
        return
    yield from _of_compare(*_compare(held, lo, len(held)))
    for kind, b in ((2, first), (3, held[-NEAR:])):
        cells = lambda x: [r.astype(">u4").tobytes() for r in x]
        yield _found(kind, len(b), part=np.full(len(b), part), i=np.arange(len(b)), _row=b.row, start=b.pos, nr=b.nr, nl=b.nl, right=cells(b.right), left=cells(b.left))


def _over_boundaries(found: DataFrame) -> DataFrame:
    """Spans and windows of rows that lie on both sides of a boundary of the sorted partitions, written. Boundaries are
    dealt out in groups, each with the rows of the ``NEAR`` partitions on either side of it, which hold all neighbours."""
    ends = found.where("kind >= 2").select("part", "kind", "i", "_row", "start", "nr", "nl", "right", "left")
    ranks = ends.select("part").distinct().select("part", F.row_number().over(Window.orderBy("part")).alias("r"))  # a row for each partition
    # the boundary before the partition of rank k is k; last rows serve the ones after theirs, first rows theirs and those before
    first, last = F.when(F.col("kind") == 3, F.col("r") + 1).otherwise(F.greatest(F.lit(2), F.col("r") - NEAR + 1)), F.when(F.col("kind") == 3, F.col("r") + NEAR).otherwise(F.greatest(F.lit(2), F.col("r")))
    dealt = ends.join(F.broadcast(ranks), "part").withColumn("chunk", F.explode(F.sequence(F.floor(first / BOUNDARIES), F.floor(last / BOUNDARIES))))

    def judge(rank: list[int], kind: list[int], rows_: _Block, chunk: int) -> Iterator[pa.RecordBatch]:
        rank, kind = np.array(rank), np.array(kind)
        for k in range(max(2, chunk * BOUNDARIES), (chunk + 1) * BOUNDARIES):
            if not (rank >= k).any():
                break
            before, after = np.flatnonzero((kind == 3) & (rank < k))[-NEAR:], np.flatnonzero((kind == 2) & (rank >= k))[:NEAR]
            if len(before) and len(after) and rank[after[0]] == k:
                pick = np.concatenate([before, after])
                block = _Block(*(x[pick] for x in vars(rows_).values()))
                yield from _of_compare(*_compare(block, 0, len(block)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rank, kind, held = None, [], [], None
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if now is not None and now != chunks[lo]:
                    yield from judge(rank, kind, held, now)
                    rank, kind, held = [], [], None
                now, some = int(chunks[lo]), batch.slice(lo, hi - lo)
                rank, kind = rank + some.column(1).to_pylist(), kind + some.column(2).to_pylist()
                block = _Block.of(pa.RecordBatch.from_arrays(some.columns[3:], names=list("abcdef")))
                held = block if held is None else held + block
        if now is not None:
            yield from judge(rank, kind, held, now)

    ordered = dealt.repartition("chunk").sortWithinPartitions("chunk", "r", "kind", "i").select("chunk", "r", "kind", "_row", "start", "nr", "nl", "right", "left")
    return written(ordered.mapInArrow(run, FOUND), "boundaries")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, texts, count = [], [], []
        for spans in batch.column(1):
            out: list[list[int]] = []
            for x in spans.as_py():
                if out and x["start"] <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], x["end"])
                else:
                    out.append([x["start"], x["end"]])
            n.append(sum(e - s for s, e in out))
            count.append(len(out))
            texts.append(",".join(f"{s}:{e}" for s, e in out))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(count, pa.int64()), pa.array(texts, pa.string())], names=["_row", "n_repeated_words", "n_passages", "passages"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_repeated_words, n_passages, passages`` of each row; passages are ``start:end`` in words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("_row"), F.col(text_col).alias("text"))
    # suffixes that agree begin with one run, so the run's hash may lead the order: it is even and quick to compare
    order = ["h", "right", "left", "salt"]
    runs = _runs(texts)
    often, n = _repeated(runs)
    suffixes = _suffixes(texts, often, n).withColumn("salt", F.xxhash64("_row", "pos"))
    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ordered.select("_row", "pos", "nr", "nl", "right", "left").mapInArrow(_neighbours, FOUND), "neighbours")
    edges = _over_boundaries(found)
    both = found.where("kind < 2").union(edges).select("kind", "_row", "start", "end", "h")
    windows = both.where("kind = 1").withColumn("place", F.xxhash64("_row", "start"))
    again = written(windows.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("h"), "repeated-windows")
    spans = both.where("kind = 0").select("_row", "start", "end").union(windows.join(again, "h", "left_semi").select("_row", "start", "end")).distinct()
    merged = written(spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("x")).mapInArrow(_merged, "_row long, n_repeated_words long, n_passages long, passages string"), "passages")
    for gone in (often, found, edges, again):
        for p in paths_of(gone):
            remove(spark, p)
    out = runs.where("h IS NULL").join(merged, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("_id").alias(id_col), "n_words", zero("n_repeated_words"), zero("n_passages"), F.coalesce("passages", F.lit("")).alias("passages"))


_word = re.compile(ALNUM_WORD)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each repeated passage in one place only: a word goes if some window of ``MIN_WORDS`` words around it also
    stands in a row of a lesser id (null ids last, then by the hash of id and text), or earlier in its own text. The text
    between a removed word and the next one goes with it; what comes first keeps its text, so no passage is lost.

    Windows are only hashed inside repeated passages, and their first places are found in a grouping that combines before
    the shuffle. Repeated rows are one row for this, and lose alike; null texts stay null, other columns stay as they are."""
    spark = docs.sparkSession
    row = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    found = repeated_passages(docs.select(row.alias("r"), F.col(text_col).alias("t")), "r", "t").where("n_passages > 0").select("r", "passages").dropDuplicates(["r"])
    texts = docs.select(row.alias("r"), F.col(id_col).alias("id"), F.col(text_col).alias("t")).dropDuplicates(["r"]).join(written(found, "repeated-passages"), "r")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = gram_hashes(word_hashes(alnum_words(batch.column(2)[i].as_py())), MIN_WORDS)
                at = np.concatenate([np.arange(int(s), int(e) - MIN_WORDS + 1) for s, e in (x.split(":") for x in batch.column(3)[i].as_py().split(","))])
                mine = batch.slice(i, 1).take(pa.array(np.zeros(len(at), np.int32)))
                yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), pa.array(at, pa.int64()), pa.array(h[at].view(np.int64))], names=["r", "id", "start", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    every = written(texts.select("r", "id", "t", "passages").mapInArrow(windows, f"r long, id {kind}, start long, h long"), "passage-windows")
    place = F.struct(F.col("id").isNull().alias("n"), "id", "r", "start")
    first = written(every.groupBy("h").agg(F.min(place).alias("x")).select("h", F.col("x.r").alias("fr"), F.col("x.start").alias("fs")), "first-places")
    salted = every.withColumn("salt", F.pmod(F.xxhash64("r"), F.lit(SALTS)).cast("int"))
    again = salted.join(first.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["h", "salt"]).where("r <> fr OR start <> fs")
    gone = written(again.groupBy("r").agg(F.sort_array(F.collect_list("start")).alias("at")), "windows-to-remove")  # bounded by the text

    @F.pandas_udf("string")
    def cut(text, at):
        import pandas as pd

        return pd.Series([t if a is None else _without(t, a) for t, a in zip(text, at)], dtype=object)

    keyed = packed(docs, row.alias("r")).join(gone, "r", "left")
    new = F.when(F.col("at").isNull(), F.col("row")[text_col]).otherwise(cut(F.col("row")[text_col], "at"))
    out = keyed.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
    for p in paths_of(every) + paths_of(first):
        remove(spark, p)
    return out


def _without(text: str, starts) -> str:
    """A text without the words of the windows that start at ``starts``."""
    words = [m.start() for m in _word.finditer(lower_ascii(text))]
    drop = np.zeros(len(words) + 1, np.int64)
    for s in starts:
        drop[s] += 1
        drop[s + MIN_WORDS] -= 1
    drop = np.cumsum(drop)[:-1] > 0
    bounds, out = [*words, len(text)], [text[: words[0]]]
    for i, gone in enumerate(drop.tolist()):
        if not gone:
            out.append(text[bounds[i] : bounds[i + 1]])
    return "".join(out)
