"""Links to known pages, found by hashes of all their titles.

``title_matches`` finds every place where a title stands in a text as whole words, outside front matter, code, and links that
are there already; places that overlap are settled from the left, the longest title first. ``linked`` makes the first
place of each target in a page a link, unless the page links to the target already or is the target.

A bit table of hashes of the titles says where in a text one may stand, for all lengths at once; the titles themselves decide. Up
to ``PART_CHARS`` characters (measured first) both are broadcast and a text is read once, where it lies. Beyond, only the table
is, of ``MARK_BITS`` at most; what passes in the texts, where they lie, meets the titles by join, which leaves those that stand
somewhere. If they are few enough, they are broadcast. Otherwise the places found are gathered by text, and pages join them:
the one case where texts are shuffled, once, however many titles there are.

Titles shorter than ``SHORTEST`` characters are no terms; of titles that read alike the least target counts. Null texts have no
places, null titles and targets are left out, repeated rows are pages of their own. Matching tells upper from lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed

SHORTEST, PART_CHARS = 4, 32_000_000
#: Bits of the table for each title, and of the table at most (beyond, more passes that is no title); characters that are hashed at once.
BITS_EACH, MARK_BITS, AT_ONCE = 64, 1 << 28, 1 << 20
#: Where nothing is linked: front matter, code, links, images and addresses.
CLOSED = re.compile(r"\A---\r?\n[\s\S]*?\r?\n---(?=\r?\n|\Z)|```[\s\S]*?(?:```|\Z)|`[^`\n]*`|!?\[\[[^\]]*\]\]|!?\[[^\]\n]*\]\([^)\n]*\)|https?://\S+")
LINKED = re.compile(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]")
PLACES = "array<struct<start: int, end: int, target: string>>"


def opened(text: str, found: list[tuple]) -> list[tuple]:
    """Those of the places (start, end and others) that lie outside what is closed."""
    closed = [m.span() for m in CLOSED.finditer(text)] if found else []
    if not closed:
        return found
    begins, ends = (np.array(x) for x in zip(*closed))
    i = np.searchsorted(begins, [f[1] - 1 for f in found], "right") - 1  # the last that begins before the place ends
    return [f for f, k in zip(found, i.tolist()) if k < 0 or ends[k] <= f[0]]


def settled(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Places that do not overlap: from the left, the longest first."""
    out, free = [], 0
    for start, end, target in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
        if start >= free:
            out.append((start, end, target))
            free = end
    return out


def with_links(text: str, found: list[tuple[int, int, str]], own: str | None) -> str:
    """The text with the first place of each target as a link."""
    done = {m[1].strip().lower() for m in LINKED.finditer(text)} | ({own.lower()} if own else set())
    out, at = [], 0
    for start, end, target in found:
        if target.lower() in done:
            continue
        done.add(target.lower())
        term = text[start:end]
        out += [text[at:start], f"[[{term}]]" if term.lower() == target.lower() else f"[[{target}|{term}]]"]
        at = end
    return "".join([*out, text[at:]])


def _terms(titles: DataFrame) -> DataFrame:
    """``term, target``: one row for each title that reads differently."""
    named = titles.select(F.trim("title").alias("term"), F.col("target").cast("string").alias("target")).where(f"target IS NOT NULL AND length(term) >= {SHORTEST}")
    return named.groupBy("term").agg(F.min("target").alias("target"))


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Hashes:
    """Hashes of any stretches of some text: sums of its code points times powers of a base, modulo 2^64, shifted to the same power."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, codes: np.ndarray):
        n = 1 << max(len(codes), AT_ONCE).bit_length()  # few sizes, which are kept
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(self.BASE, n)[: len(codes)], out=self.sums[1:])
        self.back = _powers(pow(self.BASE, -1, 1 << 64), n)

    def __call__(self, at: np.ndarray, n: np.ndarray | int, kind: int) -> np.ndarray:
        """Of the ``n`` characters from ``at``; hashes of another kind or length differ."""
        h = (self.sums[at + n] - self.sums[at]) * self.back[at]
        h ^= np.asarray(n).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


START, WHOLE = 0, (1, 2, 3)  #: Kinds of hashes: of a title's first 4, 8, 16 and so on characters, and of all of it.


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in groups of about ``AT_ONCE`` characters: number of the first, code points of all, where each begins and the last ends."""
    first, n = 0, 0
    for i, text in enumerate(texts, 1):
        n += len(text or "")
        if n >= AT_ONCE or i == len(texts):
            group = [t or "" for t in texts[first:i]]
            yield first, np.frombuffer("".join(group).encode("utf-32-le"), "<u4"), np.array([0, *accumulate(map(len, group))])
            first, n = i, 0


def _sizes(lengths: list[int] | np.ndarray) -> list[int]:
    """Powers of two from ``SHORTEST`` to the longest length."""
    return [1 << k for k in range(SHORTEST.bit_length() - 1, int(max(lengths)).bit_length())]


def _bits(n_terms: int) -> int:
    return min(MARK_BITS, 1 << max(10, (n_terms * BITS_EACH).bit_length()))


def _marks(terms: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of a word of 64 bits, the bit to set there) in a table of ``bits``."""
    for _, codes, at in _grouped(terms):
        hashes, n = _Hashes(codes), np.diff(at)
        starts = [hashes(at[:-1][n >= size], size, START) for size in _sizes(n)]
        slots = np.unique(np.concatenate([*starts, *(hashes(at[:-1], n, k) for k in WHOLE)]) & np.uint64(bits - 1))
        yield (slots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slots & np.uint64(63))


def _table(terms: DataFrame, bits: int) -> np.ndarray:
    """The bit table of ``terms``. Only words that have bits come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, marks in _marks(batch.column(0).to_pylist(), bits):
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(marks.view(np.int64))], names=["word", "mark"])

    words = terms.select("term").mapInArrow(run, "word long, mark long").groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["mark"].to_numpy().view(np.uint64)
    return table


ALNUM = np.array([chr(c).isalnum() for c in range(ord("⺀"))] + [False])  #: What words go on with; the last is for scripts without spaces, whose words have no ends.


def _marked(codes: np.ndarray, begins: np.ndarray, table: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of all whole-word stretches whose hashes the table has."""
    word = ALNUM[np.minimum(codes, len(ALNUM) - 1)]
    cut = np.ones(len(codes) + 1, bool)
    cut[1:-1] = ~(word[1:] & word[:-1])
    cut[begins] = True

    def has(h: np.ndarray) -> np.ndarray:
        slot = h & np.uint64(len(table) * 64 - 1)
        return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for a in range(0, len(codes), 2 * AT_ONCE):  # a long text by windows
        hashes, b = _Hashes(codes[a : a + 2 * AT_ONCE + lengths[-1]]), len(codes) - a
        alike = np.flatnonzero(cut[a : min(a + 2 * AT_ONCE, len(codes))])
        for size in (s for s in _sizes(lengths) if 2 * s > lengths[0]):
            alike = alike[alike + size <= b]
            alike = alike[has(hashes(alike, size, START))]
            for n in (n for n in lengths if size <= n < 2 * size):
                at = alike[alike + n <= b]
                at = at[cut[a + at + n]]
                for kind in WHOLE:
                    at = at[has(hashes(at, n, kind))]
                found.append((at + a, np.full(len(at), n)))
    return tuple(np.concatenate(c) for c in zip(*found))


def standing(texts: list[str | None], table: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(number of the text, start and end of all places where a title may stand as whole words), for texts that have any."""
    for first, codes, begins in _grouped(texts) if lengths else ():
        at, n = _marked(codes, begins[:-1], table, lengths)
        of = np.searchsorted(begins, at, "right") - 1
        inside = at + n <= begins[of + 1]
        found: dict[int, list[tuple[int, int]]] = {}
        for i, start, k in zip(of[inside].tolist(), (at - begins[of])[inside].tolist(), n[inside].tolist()):
            found.setdefault(first + i, []).append((start, start + k))
        yield from found.items()


def _stretches(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """``key, start, end, term``: what ``standing`` finds outside what is closed; ``key`` is the digest of the text."""
    lengths = sorted(r.n for r in terms.select(F.length("term").alias("n")).distinct().collect())
    shared = pages.sparkSession.sparkContext.broadcast(_table(terms, _bits(terms.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(keys[i], s, e, texts[i][s:e]) for i, found in standing(texts, shared.value, lengths) for s, e in opened(texts[i], found)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["key", "start", "end", "term"])

    return pages.where("content IS NOT NULL").select(F.md5("content").alias("key"), "content").mapInArrow(run, "key string, start int, end int, term string")


def _chars(terms: DataFrame) -> int:
    return terms.agg(F.sum(F.length("term") + F.length("target")).alias("n")).first().n or 0


def title_matches(pages: DataFrame, titles: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of ``pages`` (``content`` and others) with ``places``: settled (start, end, target), in code points. ``titles``: ``title,
    target``."""
    terms = _terms(titles)
    if _chars(terms) > part_chars:
        terms = checkpointed(terms)
        stretches = _stretches(pages, terms)
        terms = checkpointed(terms.join(stretches.select("term").distinct(), "term", "left_semi"))
        if _chars(terms) > part_chars:
            return _gathered(pages, stretches.join(terms, "term"))
    named = terms.select("term", "target").toArrow().cast(pa.schema([("term", pa.string()), ("target", pa.string())])).combine_chunks()
    table = np.zeros(_bits(len(named)) // 64, np.uint64)
    for batch in named.to_batches(10_000):
        for words, marks in _marks(batch.column(0).to_pylist(), len(table) * 64):
            np.bitwise_or.at(table, words, marks)
    shared = pages.sparkSession.sparkContext.broadcast((named, table, sorted(pc.unique(pc.utf8_length(named["term"])).to_pylist())))

    @F.pandas_udf(PLACES)
    def find(texts: pd.Series) -> pd.Series:
        named, table, lengths = shared.value
        out, texts = [[] for _ in texts], texts.tolist()
        stood = list(standing(texts, table, lengths))
        which = pc.index_in(pa.array([texts[i][s:e] for i, found in stood for s, e in found], pa.string()), value_set=named["term"])
        targets = iter(named["target"].take(which).to_pylist())  # none where only hashes agree
        for i, found in stood:
            known = [(s, e, x) for (s, e), x in zip(found, targets) if x is not None]
            out[i] = [{"start": s, "end": e, "target": x} for s, e, x in settled(opened(texts[i], known))]
        return pd.Series(out, dtype=object)

    return pages.withColumn("places", find("content"))


def _gathered(pages: DataFrame, places: DataFrame) -> DataFrame:
    """``pages`` with their ``places`` out of rows ``key, start, end, target``."""
    found = places.groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "end", "target")).alias("_found"))

    @F.pandas_udf(PLACES)
    def settle(found: pd.Series) -> pd.Series:
        return found.map(lambda f: [] if f is None else [{"start": s, "end": e, "target": x} for s, e, x in settled([(p["start"], p["end"], p["target"]) for p in f])])

    return pages.withColumn("_key", F.md5("content")).join(found, "_key", "left").withColumn("places", settle("_found")).drop("_key", "_found")


def linked(pages: DataFrame, titles: DataFrame, own: str | None = None, part_chars: int = PART_CHARS, count: str | None = None) -> DataFrame:
    """``pages`` with ``content`` enriched by links to the titles' targets. ``own``: the column that names a page as a target;
    ``count``: a column to add with how many places a page has."""
    names = pages.withColumn("_own", F.col(own).cast("string") if own else F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def write(content: pd.Series, found: pd.Series, me: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else with_links(c, [(p["start"], p["end"], p["target"]) for p in f], m) for c, f, m in zip(content, found, me)], dtype=object)

    met = title_matches(names, titles, part_chars)
    places = [] if count is None else [F.size("places").alias(count)]
    return met.withColumn("content", write("content", "places", "_own")).select(*pages.columns, *places)
