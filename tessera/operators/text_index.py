"""Substring search over many questions at once, from a positional index of three-character runs.

``build`` deals pages into shards of bounded text, in one pass without a shuffle, and inverts each shard: for every run of
three characters of the lower-case content (field 0) and of title and file name (field 1), the places where it stands, as
differences in the narrowest of 1, 2, 4 or 8 bytes. Two blanks that no text holds follow each page, so that every place
starts a run, and a needle of one or two characters is a range of runs. A shard is one row; its postings lie in ``BUCKETS``
columns by a hash of the run's first two characters, so a search reads the columns of its needles alone.

``search`` deals questions into parts, and each shard meets each part in one row: without a shuffle where the questions
are few enough to be broadcast (they are counted), by their part beyond. A needle is found once for each shard and part by
intersecting places of its runs from the rarest on (which is exact, so no text is read), pages are scored as
``score_pages`` does, and the best ``n`` of each question in all shards of a task leave it; the best of all are joined to
their texts for snippets. What is shuffled are ``n`` rows for each question and task, however many pages hold a term.

Pages without content are not indexed, questions without text find nothing; repeated paths are pages of their own, ties
are broken by path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import page_title
from tessera.operators import retrieval as R

#: Characters and pages of a shard (a longer page is a shard of its own), questions of a part, and columns of postings.
SHARD_CHARS, SHARD_PAGES, PART_QUESTIONS, BUCKETS = 1_200_000, 4096, 1024, 32
#: Questions beyond this, and their best pages, are not broadcast.
FEW_QUESTIONS = 16_384
#: Pages that a task keeps as the best so far before it passes them on.
KEPT = 200_000
RUN = 3
#: Beyond Unicode: follows each page.
BLANK = 0x1FFFFF
COLUMNS = [f"b{i}" for i in range(BUCKETS)]
PAGE = "path string, title string, content string, shard long, doc int"
SHARD = "shard long, starts array<binary>, paths array<string>, names array<string>, " + ", ".join(f"{c} binary" for c in COLUMNS)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


WIDTHS = (1, 2, 4, 8)


def bucket_of(run: np.ndarray | int) -> np.ndarray | int:
    """The column of a run, by its first two characters."""
    first, second = run >> 42, (run >> 21) & BLANK
    return (first * 31 + second) % BUCKETS


def inverted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a field of a shard, sorted: the runs, where each one's places begin, all places, and the starts of the pages."""
    points = [np.append(_points(t), [BLANK, BLANK]) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in points])[:-1]]).astype(np.int64) if points else np.empty(0, np.int64)
    p = np.concatenate([*points, [BLANK, BLANK]]) if points else np.empty(0, np.int64)
    at = np.flatnonzero(p[:-2] != BLANK)
    letters, code = np.unique(p, return_inverse=True)
    k, bits = max(1, len(letters)), max(1, int(len(p)).bit_length())
    if k**3 << bits < 1 << 63:  # run and place in one number, which sorts fast
        run = (code[:-2] * k + code[1:-1]) * k + code[2:]
        both = np.sort(run[at] << bits | at)
        order, run = both & ((1 << bits) - 1), both >> bits
        first = np.flatnonzero(np.diff(run, prepend=-1))
        at = order[first]
    else:
        run = p[:-2] << 42 | p[1:-1] << 21 | p[2:]
        order = at[np.argsort(run[at], kind="stable")]
        first = np.flatnonzero(np.diff(run[order], prepend=-1))
        at = order[first]
    return p[at] << 42 | p[at + 1] << 21 | p[at + 2], first, order, starts


def bucketed(runs: np.ndarray, first: np.ndarray, places: np.ndarray) -> list[bytes]:
    """Postings by bucket, and in it by the width that the differences of a run's places need: how many runs, the runs, how many
    places each has, and the differences of all."""
    n = np.diff(np.append(first, len(places)))
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    most = np.maximum.reduceat(steps, first) if len(first) else np.empty(0, np.int64)
    width, bucket = np.searchsorted([1 << 8, 1 << 16, 1 << 32], most, "right"), bucket_of(runs)
    order = np.lexsort((runs, width, bucket))
    n, runs, kind = n[order], runs[order], bucket[order] * len(WIDTHS) + width[order]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    steps = steps[np.repeat(first[order] - np.append(0, ends[:-1]), n) + np.arange(total)] if total else steps
    cut = np.searchsorted(kind, np.arange(BUCKETS * len(WIDTHS) + 1))
    edge = np.append(0, ends)
    out = []
    for b in range(BUCKETS):
        parts = []
        for w, size in enumerate(WIDTHS):
            i, j = cut[b * len(WIDTHS) + w], cut[b * len(WIDTHS) + w + 1]
            parts += [np.array([j - i, edge[j] - edge[i]], "<i8").tobytes(), runs[i:j].astype("<i8").tobytes(), n[i:j].astype("<i4").tobytes(), steps[edge[i] : edge[j]].astype(f"<u{size}").tobytes()]
        out.append(b"".join(parts))
    return out


def opened(data: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one field's postings in a bucket, for each width: runs, where each one's differences begin and end, and those."""
    out, at = [], 0
    for size in WIDTHS:
        k, total = (int(x) for x in np.frombuffer(data, "<i8", 2, at))
        runs, n = np.frombuffer(data, "<i8", k, at + 16), np.frombuffer(data, "<i4", k, at + 16 + 8 * k)
        at += 16 + 12 * k
        out.append((runs, np.append(0, np.cumsum(n, dtype=np.int64)), np.frombuffer(data, f"<u{size}", total, at)))
        at += size * total
    return out


def _shard_row(shard: int, pages: list[tuple]) -> dict:
    """``pages``: path, title, content, name, content_lower, title_lower."""
    starts, fields = [], []
    for f in (4, 5):
        runs, first, places, at = inverted([p[f] for p in pages])
        starts.append(at.astype("<i8").tobytes())
        fields.append(bucketed(runs, first, places))
    both = {c: len(x).to_bytes(8, "little") + x + y for c, x, y in zip(COLUMNS, *fields)}
    return {"shard": shard, "starts": starts, "paths": [p[0] for p in pages], "names": [p[3] for p in pages]} | both


def _built(most_chars: int):
    """Pages as rows of kind ``pages`` with their shard and place in it, and each full shard as a row of kind ``shards``."""
    page_kinds = [("path", pa.string()), ("title", pa.string()), ("content", pa.string()), ("shard", pa.int64()), ("doc", pa.int32())]
    shard_kinds = [("starts", pa.list_(pa.binary())), ("paths", pa.list_(pa.string())), ("names", pa.list_(pa.string())), *((c, pa.binary()) for c in COLUMNS)]
    schema = pa.schema([*page_kinds, *shard_kinds, ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, pages, chars = TaskContext.get().partitionId(), 0, [], 0

        def full() -> Iterator[pa.RecordBatch]:
            shard = task << 32 | number
            rows = [{"path": p[0], "title": p[1], "content": p[2], "shard": shard, "doc": i, "kind": "pages"} for i, p in enumerate(pages)]
            yield pa.RecordBatch.from_pylist([*rows, _shard_row(shard, pages) | {"kind": "shards"}], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                page = tuple(c[i].as_py() for c in batch.columns)
                if pages and (chars + len(page[4]) > most_chars or len(pages) >= SHARD_PAGES):
                    yield from full()
                    number, pages, chars = number + 1, [], 0
                pages.append(page)
                chars += len(page[4])
        if pages:
            yield from full()

    return run


class Needle:
    """A needle's runs and where they stand in it, worked out once for all shards."""

    def __init__(self, text: str):
        p = _points(text)
        self.short = None
        if len(p) < RUN:
            low = int(p[0]) << 42 | (int(p[1]) << 21 if len(p) > 1 else 0)
            self.short = low, low + (1 << (21 if len(p) > 1 else 42)), [bucket_of(low)] if len(p) > 1 else list(range(BUCKETS))
        else:
            offsets = np.unique(np.append(np.arange(0, len(p) - RUN + 1, RUN), len(p) - RUN))
            self.runs = list(zip(offsets.tolist(), (p[offsets] << 42 | p[offsets + 1] << 21 | p[offsets + 2]).tolist()))


class Shard:
    """A shard's row with the columns that some questions need."""

    def __init__(self, row: dict):
        self.starts = [np.frombuffer(x, "<i8") for x in row["starts"]]
        self.paths, self.names = row["paths"], row["names"]
        self.at: list[dict[int, tuple[np.ndarray, int, int]]] = [{}, {}]
        self.sorted: list[dict[int, np.ndarray]] = [{}, {}]
        for b, c in enumerate(COLUMNS):
            if c in row:
                cut = 8 + int.from_bytes(row[c][:8], "little")
                for f, data in enumerate((row[c][8:cut], row[c][cut:])):
                    found = opened(data)
                    for runs, ends, steps in found:
                        e = ends.tolist()
                        self.at[f].update(zip(runs.tolist(), zip([steps] * len(runs), e, e[1:])))
                    self.sorted[f][b] = np.sort(np.concatenate([runs for runs, _, _ in found]))
        self.open: list[dict[int, np.ndarray]] = [{}, {}]

    def _places(self, run: int, f: int) -> np.ndarray:
        got = self.open[f].get(run)
        if got is None:
            steps, a, b = self.at[f][run]
            got = self.open[f][run] = np.cumsum(steps[a:b], dtype=np.int64)
        return got

    def places(self, needle: Needle, f: int) -> np.ndarray:
        """Where a needle of at least one character stands, rising."""
        none, known = np.empty(0, np.int64), self.at[f]
        if needle.short:
            low, high, buckets = needle.short
            out = []
            for b in buckets:
                runs = self.sorted[f][b]
                out += [self._places(int(r), f) for r in runs[np.searchsorted(runs, low) : np.searchsorted(runs, high)]]
            return np.sort(np.concatenate(out)) if out else none
        found = []
        for offset, run in needle.runs:
            held = known.get(run)
            if held is None:
                return none
            found.append((held[2] - held[1], offset, run))
        found.sort()
        out = self._places(found[0][2], f) - found[0][1]
        for _, offset, run in found[1:]:
            here = self._places(run, f)
            want = out + offset
            k = here.searchsorted(want)
            k[k == len(here)] = 0
            out = out[here[k] == want]
            if not len(out):
                break
        return out

    def page_of(self, places: np.ndarray, f: int) -> np.ndarray:
        return self.starts[f].searchsorted(places, "right") - 1

    def held(self, needles: list[Needle | None], f: int) -> np.ndarray:
        """Which pages hold which needle (rows); every page holds the empty one (None)."""
        out = np.zeros((len(needles), len(self.paths)), bool)
        for i, needle in enumerate(needles):
            if needle is None:
                out[i] = True
            else:
                places = self.places(needle, f)
                if len(places):
                    out[i, self.page_of(places, f)] = True
        return out

    def occurrences(self, phrase: Needle | None, length: int) -> np.ndarray:
        """Of each page's content, without overlaps, from the left."""
        n = np.zeros(len(self.paths), np.int64)
        if phrase:
            places = self.places(phrase, 0)
            end = -1
            for at, page in zip(places.tolist(), self.page_of(places, 0).tolist()):
                if at >= end:
                    n[page] += 1
                    end = at + length
        return n


class Asked:
    """The questions of a part, their needles numbered."""

    def __init__(self, questions: list[dict]):
        texts: dict[str, int] = {}
        self.questions = [(q["qid"], q["phrase"], q["terms"], np.array([texts.setdefault(t, len(texts)) for t in q["terms"]]), texts.setdefault(q["phrase"], len(texts))) for q in questions]
        self.needles = [Needle(t) if t else None for t in texts]

    def answers(self, shard: Shard, n: int, number: int) -> list[tuple]:
        """The best ``n`` pages of a shard for each question."""
        by_name: dict[str, list[int]] = {}
        for i, name in enumerate(shard.names):
            by_name.setdefault(name, []).append(i)
        in_content, in_titles = (shard.held(self.needles, f) for f in (0, 1))
        out: list[tuple] = []
        for qid, phrase, terms, at, p in self.questions:
            here = in_content[at]
            titled = in_titles[at].sum(0)
            score = R.CONTENT_TOKEN * here.sum(0) + R.TITLE_TOKEN * titled
            occ = None
            if phrase:
                score = score + R.PHRASE_IN_TITLE * in_titles[p]
                if in_content[p].any():
                    occ = np.minimum(shard.occurrences(self.needles[p], len(phrase)), R.MOST_OCCURRENCES)
                    score = score + R.PHRASE_IN_CONTENT * occ
            if phrase in by_name:
                score[by_name[phrase]] += R.FILE_NAME
            good = np.flatnonzero(score > 0)
            if len(good) > n:
                some = score[good]
                good = good[some >= np.partition(some, len(good) - n)[len(good) - n]]
            best = sorted(good.tolist(), key=lambda i: (-score[i], shard.paths[i] is not None, shard.paths[i] or ""))[:n]
            for i in best:
                first = here[:, i]
                anchor = phrase if occ is not None and occ[i] else terms[int(first.argmax())] if first.any() else None
                out.append((qid, number, i, shard.paths[i], float(score[i]), bool(titled[i] or (phrase and in_titles[p, i])), anchor))
        return out


def _answered(n: int, columns: list[str], kind: pa.DataType):
    kinds = (kind, pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string())
    names = ["qid", "shard", "doc", "path", "score", "title_match", "anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Asked] = {}
        best: dict = {}  # of each question, over the shards of the task

        def passed_on() -> Iterator[pa.RecordBatch]:
            out = [(qid, *x) for qid, some in best.items() for x in some]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(i)[at].as_py() for i, c in enumerate(columns) if c != "questions"}
                if row["part"] not in asked:
                    asked[row["part"]] = Asked(batch.column(columns.index("questions"))[at].as_py())
                for qid, *x in asked[row["part"]].answers(Shard(row), n, row["shard"]):
                    best.setdefault(qid, []).append(x)
                for qid, some in best.items():
                    if len(some) > n:
                        best[qid] = sorted(some, key=lambda x: (-x[3], x[2] is not None, x[2] or "", x[0], x[1]))[:n]
                if n * len(best) > KEPT:
                    yield from passed_on()
                    best = {}
        yield from passed_on()

    return run


def _columns(needle: str) -> Column:
    """The postings columns of a needle's runs (SQL of an array of ints); of a single character, all."""
    code = lambda i: f"ascii(substr({needle}, {i}, 1))"
    bucket = lambda i: f"cast(({code(i)} * 31 + {code(f'{i} + 1')}) % {BUCKETS} as int)"
    last = f"length({needle}) - {RUN - 1}"
    runs = f"transform(concat(sequence(1, {last}, {RUN}), array({last})), i -> {bucket('i')})"
    return F.expr(f"CASE WHEN length({needle}) >= {RUN} THEN {runs} WHEN length({needle}) = 2 THEN array({bucket('1')}) WHEN length({needle}) = 1 THEN sequence(0, {BUCKETS - 1}) ELSE array() END")


class TextIndex:
    """An index folder, opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def pages(self) -> DataFrame:
        """``path, title, content, shard, doc``."""
        return self.spark.read.schema(f"{PAGE}, kind string").parquet(self.path).where("kind = 'pages'").drop("kind")

    def shards(self, buckets: list[int] | None = None) -> DataFrame:
        """A row for each shard, with the postings of all buckets or of those given."""
        rows = self.spark.read.schema(f"{SHARD}, kind string").parquet(self.path).where("kind = 'shards'").drop("kind")
        return rows if buckets is None else rows.select("shard", "starts", "paths", "names", *(f"b{i}" for i in buckets))

    @classmethod
    def build(cls, path: str, pages: DataFrame, shard_chars: int = SHARD_CHARS) -> TextIndex:
        """``pages``: ``path, file_name, content``."""
        base = pages.where("content IS NOT NULL").select("path", "file_name", "content", page_title(F.col("content"), F.col("file_name")).alias("title"))
        named = base.select("path", "title", "content", F.lower(F.regexp_replace("file_name", r"\.md$", "")).alias("name"), F.lower("content").alias("content_lower"), F.lower(F.concat_ws(" ", "title", "file_name")).alias("title_lower"))
        built = named.mapInArrow(_built(shard_chars), f"{PAGE}, {SHARD.split(', ', 1)[1]}, kind string")
        # a shard is a long row: row groups are small, and their size is looked at after few rows
        built.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.page.size.row.check.min", 4).partitionBy("kind").parquet(path)
        return cls(pages.sparkSession, path)

    def search(self, questions: DataFrame, id_col: str = "qid", text_col: str = "text", n: int = R.TOP) -> DataFrame:
        """``qid, rank, path, title, title_match, score, snippet``: the ``n`` best pages of every question."""
        text = F.col(text_col)
        asked = questions.where(text.isNotNull()).select(F.col(id_col).alias("qid"), text.alias("question"))
        asked = asked.withColumn("phrase", R.query_phrase(F.col("question"))).withColumn("terms", R.query_terms(F.col("question")))
        count = asked.count()
        parts = max(1, -(-count // PART_QUESTIONS))
        needles = asked.select(F.explode(F.array_distinct(F.concat("terms", F.array("phrase")))).alias("needle"))
        buckets = sorted(r.b for r in needles.select(F.explode(_columns("needle")).alias("b")).distinct().collect())
        packs = asked.select(F.pmod(F.xxhash64("qid", "question"), F.lit(parts)).cast("int").alias("part"), F.struct("qid", "phrase", "terms").alias("q")).groupBy("part").agg(F.collect_list("q").alias("questions"))
        rows = self.shards(buckets).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = rows.join(F.broadcast(packs) if count <= FEW_QUESTIONS else packs, "part")
        # no more tasks than shuffles have: each passes on its best of every question
        met = met.coalesce(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        kind = dict(asked.dtypes)["qid"]
        arrow = questions.limit(0).select(F.col(id_col).alias("q")).toArrow().schema.field("q").type
        found = met.mapInArrow(_answered(n, met.columns, arrow), f"qid {kind}, shard long, doc int, path string, score double, title_match boolean, anchor string")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "path", "shard", "doc")
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("path")
        top = top.join(asked.select("qid", "question"), "qid")
        texts = self.pages.join(F.broadcast(top) if count <= FEW_QUESTIONS else top, ["shard", "doc"])
        return texts.select("qid", "rank", "path", "title", "title_match", "score", R.snippet(F.col("content"), F.coalesce("anchor", "question")).alias("snippet"))
