"""An inverted-file vector index, and exact search in blocks.

The index is a folder of Parquet tables. A k-means quantiser, fitted by distributed rounds over a bounded sample
(``SAMPLE`` rows by least hash), deals every row into the list of its nearest centroid; the row's residual is stored as a
product code of one byte for each ``WIDTH`` dimensions, beside the vector itself. ``rows`` is partitioned by list; a list
takes as many files as it has rows. A search reads codes of the probed lists alone, keeps the ``depth`` best of each query
by its distance tables, and reads vectors for those to rank them exactly. How many lists are probed and how deep it looks
is measured when the index is built: on ``TRIED`` rows as queries against all rows, so that ``target`` of their true
neighbours are in the probed lists, and ``target`` of those come through the codes. ``search(exact=True)`` probes
all lists and compares vectors instead of codes, and ranks as brute force does.

Queries meet rows in blocks: both sides are dealt into parts of bounded size by hash, within a list (or in all of the
table, for brute force), and each pair of parts is one task's matrix product. So a list that holds a third of all rows, or
is probed by all queries, is many tasks; what is shuffled grows with rows and queries times parts, never with pairs. The
driver holds centroids, codebooks and counts of lists, which have bounds, and no vectors but those of the ``TRIED`` queries.

Rows with a null id or vector, with another number of entries than the index has, or with entries that are null or not
finite are not indexed; such queries find nothing. Ids that repeat are rows of their own, and a query's own id is left out.
Ties are broken by id. An empty table gives an index without rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE, TRIED, ROUNDS, TARGET, NEIGHBOURS = 65_536, 128, 8, 0.97, 10
WIDTH, CODES = 4, 256
MOST_LISTS, LIST_ROWS = 4096, 128
#: Parts of one block join; a matrix of one part against another has at most the product of both.
PART_ROWS, PART_QUERIES = 8192, 1024
#: Cells of one matrix in a task.
CELLS = 1 << 22


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _lists_of(m: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel(), kind))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first."""
    out, step = [], max(1, CELLS // len(centres))
    for at in range(0, len(x), step):
        d = _squares(x[at : at + step], centres)
        if k == 1:
            out.append(d.argmin(1)[:, None])
        else:
            few = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            out.append(np.take_along_axis(few, np.take_along_axis(d, few, 1).argsort(1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


def _padded(x: np.ndarray) -> np.ndarray:
    """Rows as (row, part, entry), filled up with zeros to whole parts."""
    parts = -(-x.shape[1] // WIDTH)
    return np.pad(x, ((0, 0), (0, parts * WIDTH - x.shape[1]))).reshape(len(x), parts, WIDTH)


def usable(table: DataFrame, id_col: str, vector_col: str, d: int | None = None) -> DataFrame:
    """``id, v``: rows that can be compared."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0").where(~bad)
    return good.where(F.size("v") == d) if d else good


def meet(left: DataFrame, right: DataFrame, key: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: int | None = None, queries: int | None = None) -> DataFrame:
    """``run`` of every pair of parts of the rows of ``left`` (``id``) and ``right`` (``qid``) that agree in ``key``; parts hold about
    ``rows`` and ``queries`` rows. The counts by key come to the driver's plan only as a table."""
    rows, queries = rows or PART_ROWS, queries or PART_QUERIES
    counts = left.groupBy(key).agg(F.count("*").alias("n")).join(right.groupBy(key).agg(F.count("*").alias("m")), key)
    parts = counts.select(key, F.ceil(F.col("n") / rows).cast("int").alias("lp"), F.ceil(F.col("m") / queries).cast("int").alias("rp"))

    def dealt(df: DataFrame, id_col: str, own: str, other: str) -> DataFrame:
        mine, others = F.pmod(F.xxhash64(id_col, F.monotonically_increasing_id()), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return df.join(F.broadcast(parts), key).withColumn(f"p_{own}", mine).withColumn(f"p_{other}", others).drop("lp", "rp")  # a row for each list

    keys = [key, "p_lp", "p_rp"]
    return dealt(left, "id", "lp", "rp").groupBy(*keys).cogroup(dealt(right, "qid", "rp", "lp").groupBy(*keys)).applyInArrow(run, schema)


def _best(qid: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, row) of the ``k`` least distances of each query to rows of other ids, and all that tie with the last."""
    d = np.where(qid[:, None] == ids[None, :], np.inf, d)
    m = min(k, d.shape[1])
    last = np.partition(d, m - 1, axis=1)[:, m - 1]
    last = np.where(np.isfinite(last), last, np.finfo(float).max / 2)
    return np.nonzero((d <= last[:, None] * (1 + 1e-9)) & np.isfinite(d))


def exact_tile(k: int, d: int, more: tuple[str, ...] = ()) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``k`` nearest rows of each query of a pair of parts. Products pick them; distances are sums of squared differences."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and queries.num_rows:
            x, ids, qid = _matrix(rows["v"], d), rows["id"].to_numpy(), queries["qid"].to_numpy()
            q_all, step = _matrix(queries["v"], d), max(1, CELLS // rows.num_rows)
            for at in range(0, len(qid), step):
                q = q_all[at : at + step]
                i, j = _best(qid[at : at + step], ids, _squares(q, x), k)
                distance = np.concatenate([np.sqrt(((q[i[c : c + 65536]] - x[j[c : c + 65536]]) ** 2).sum(1)) for c in range(0, len(i), 65536)] or [np.empty(0)])
                out.append(pa.table({"qid": queries["qid"].combine_chunks().take(pa.array(i + at)), "id": rows["id"].combine_chunks().take(pa.array(j)), "distance": distance} | {c: rows[c].combine_chunks().take(pa.array(j)) for c in more}))
        if out:
            return pa.concat_tables(out)
        return pa.table({"qid": queries["qid"].slice(0, 0), "id": rows["id"].slice(0, 0), "distance": pa.array([], pa.float64())} | {c: rows[c].slice(0, 0) for c in more})

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: DataFrame, k: int, d: int, more: tuple[str, ...] = ()) -> DataFrame:
    """``qid, id, distance, rank`` (and columns ``more`` of the rows): the ``k`` nearest rows of every query, all compared in blocks.
    ``rows``: ``id, v``; ``queries``: ``qid, v``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"qid {dict(queries.dtypes)['qid']}", f"id {kinds['id']}", "distance double", *(f"{c} {kinds[c]}" for c in more)])
    one = F.lit(0).alias("all")
    return ranked(meet(rows.select("*", one), queries.select("qid", "v", one), "all", exact_tile(k, d, more), schema), k)


def lloyd(sample: DataFrame, start: np.ndarray, rounds: int = ROUNDS, of: Callable[[np.ndarray], np.ndarray] = lambda x: x[:, None, :]) -> np.ndarray:
    """K-means by distributed rounds. ``start``: centres as (part, centre, entry); ``of`` turns vectors into (row, part, entry), and
    each part has centres of its own. A centre without rows stays where it is. Only sums of centres reach the driver."""
    centres, d = start, sample.select(F.size("v").alias("d")).limit(1).collect()[0].d

    def step(now: np.ndarray) -> np.ndarray:
        parts, k, width = now.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros(now.shape), np.zeros((parts, k), np.int64)
            for batch in batches:
                x = of(_matrix(batch.column(0), d))
                for p in range(parts):
                    near = _nearest(x[:, p], now[p])[:, 0]
                    n[p] += np.bincount(near, minlength=k)
                    for e in range(width):
                        sums[p, :, e] += np.bincount(near, x[:, p, e], k)
            at = np.flatnonzero(n.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at]), _lists_of(sums.reshape(-1, width)[at])], names=["at", "n", "s"])

        each = sample.select("v").mapInArrow(run, "at long, n long, s array<double>")
        got = each.groupBy("at").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(e))) for e in range(width))).alias("s")).toArrow()
        out = now.reshape(-1, width).copy()
        if got.num_rows:
            out[got["at"].to_numpy()] = _matrix(got["s"], width) / got["n"].to_numpy()[:, None]
        return out.reshape(now.shape).astype(np.float32).astype(np.float64)

    for _ in range(rounds):
        centres = step(centres)
    return centres


class VectorIndex:
    """An index folder, opened: its model is small and held by the driver, its rows stay a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        model = spark.read.parquet(f"{self.path}/model").first()
        facts = json.loads(model.facts)
        self.d, self.n, self.probes, self.depth, self.schema = facts["d"], facts["n"], facts["probes"], facts["depth"], facts["schema"]
        self.centres = np.frombuffer(model.centres, np.float64).reshape(-1, max(1, self.d))
        self.codebook = np.frombuffer(model.codebook, np.float64).reshape(-1, facts["codes"], WIDTH)

    @property
    def rows(self) -> DataFrame:
        """``id, code, v`` and the partition ``list``."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    @classmethod
    def build(cls, path: str, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, target: float = TARGET) -> VectorIndex:
        spark, path = table.sparkSession, path.rstrip("/")
        good = usable(table, id_col, vector_col)
        sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
        d, n = (sizes[0].d, sizes[0].n) if sizes else (0, 0)
        good = good.where(F.size("v") == d)
        good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").write.parquet(f"{path}/sample")
        sample = spark.read.parquet(f"{path}/sample")
        k = max(1, min(lists or n // LIST_ROWS, MOST_LISTS, n))
        start = sample.limit(max(k, CODES)).toArrow() if n else None
        first = _matrix(start["v"], d) if n else np.zeros((1, 1))
        centres = lloyd(sample, first[None, :k].copy())[0] if n else first

        def split(x: np.ndarray) -> np.ndarray:
            return _padded(x - centres[_nearest(x, centres)[:, 0]])

        codebook = lloyd(sample, split(first[:CODES]).transpose(1, 0, 2).copy(), of=split) if n else np.zeros((1, 1, WIDTH))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), d)
                at = _nearest(x, centres)[:, 0]
                r = _padded(x - centres[at])
                code = np.stack([_nearest(r[:, p], codebook[p])[:, 0] for p in range(len(codebook))], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(at, pa.int32())], names=["id", "v", "code", "list"])

        kind = dict(good.dtypes)["id"]
        coded = good.mapInArrow(run, f"id {kind}, v array<double>, code binary, list int")
        files = F.pmod(F.xxhash64("id"), F.lit(max(1, n // (k * 16 * PART_ROWS)))).alias("file")
        entries = "array<float>" if dict(table.dtypes)[vector_col] == "array<float>" else "array<double>"
        coded.select("id", F.col("v").cast(entries).alias("v"), "code", "list").repartition(F.col("list"), files).sortWithinPartitions("list").write.partitionBy("list").parquet(f"{path}/rows")
        schema = f"id {kind}, v {entries}, code binary, list int"
        made = cls._with(spark, path, d, n, 1, 1, schema, centres, codebook)
        probes, depth = made._measured(target) if n else (1, 1)
        made.probes, made.depth = probes, depth
        facts = json.dumps({"d": d, "n": n, "probes": probes, "depth": depth, "codes": codebook.shape[1], "schema": schema})
        spark.createDataFrame([(facts, centres.tobytes(), codebook.tobytes())], "facts string, centres binary, codebook binary").coalesce(1).write.parquet(f"{path}/model")
        return made

    @classmethod
    def _with(cls, spark: SparkSession, path: str, d: int, n: int, probes: int, depth: int, schema: str, centres: np.ndarray, codebook: np.ndarray) -> VectorIndex:
        self = cls.__new__(cls)
        self.spark, self.path, self.d, self.n, self.probes, self.depth, self.schema, self.centres, self.codebook = spark, path, d, n, probes, depth, schema, centres, codebook
        return self

    def _measured(self, target: float) -> tuple[int, int]:
        """Lists to probe and candidates to keep, so that each loses no more than ``1 - target`` of the true neighbours of the tried
        queries: their neighbours are found in all rows, and the rows that the codes put before a neighbour are counted."""
        rows = self.rows.select("id", F.col("v").cast("array<double>").alias("v"), "code", "list")
        tried = rows.orderBy(F.xxhash64("id", F.lit("tried")), "id").limit(TRIED).select(F.col("id").alias("qid"), "v")
        got = tried.toArrow()
        qid, q = got["qid"].to_pylist(), _matrix(got["v"], self.d)
        true = brute_force(rows, self.spark.createDataFrame(got), NEIGHBOURS, self.d, ("code", "list")).toArrow()
        if not true.num_rows:
            return 1, 1
        place = {x: i for i, x in enumerate(qid)}
        at, lists = np.array([place[x] for x in true["qid"].to_pylist()]), true["list"].to_numpy()
        order = _nearest(q, self.centres, len(self.centres))
        rank = (order[at] == lists[:, None]).argmax(1)
        probes = int(np.quantile(rank, target, method="higher")) + 1
        codes = np.frombuffer(b"".join(true["code"].to_pylist()), np.uint8).reshape(true.num_rows, -1)
        inside = rank < probes
        at, lists, codes = at[inside], lists[inside], codes[inside]
        centres, codebook = self.centres, self.codebook
        limit = np.array([_coded(q[a : a + 1] - centres[lst], codebook, c[None])[0, 0] for a, lst, c in zip(at, lists, codes)])
        probed = order[:, :probes]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = np.zeros(len(at), np.int64)
            for batch in batches:
                lst = batch.column(1).to_numpy()
                code = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for one in np.unique(lst):
                    who = np.flatnonzero((probed == one).any(1))
                    approx = _coded(q[who] - centres[one], codebook, code[lst == one])
                    for w, row in zip(who, approx):
                        mine = np.flatnonzero(at == w)
                        before[mine] += (row[None, :] < limit[mine, None]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at))), pa.array(before)], names=["i", "n"])

        counted = self.rows.select("code", "list").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        return probes, max(NEIGHBOURS, int(np.quantile(counted["n"].to_numpy(), target, method="higher")) + 1)

    def search(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, depth: int | None = None, exact: bool = False) -> DataFrame:
        """``query_id, id, distance, rank``: for each query its ``k`` nearest rows of other ids. ``probes`` and ``depth`` are those of
        the index unless given (a depth for ``k`` over ``NEIGHBOURS`` grows in proportion); ``exact`` compares with all rows."""
        asked = usable(queries, id_col, vector_col, self.d or -1).select(F.col("id").alias("qid"), "v")
        rows = self.rows
        qkind, kind = dict(asked.dtypes)["qid"], dict(rows.dtypes)["id"]
        # lists meet queries in groups of about a part's rows, so that a query's best are kept once for many lists
        groups = max(1, min(len(self.centres), -(-self.n // PART_ROWS)))
        group = F.pmod("list", F.lit(groups)).cast("int").alias("group")
        if exact:
            everywhere = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            full = meet(rows.select("id", F.col("v").cast("array<double>").alias("v"), group), everywhere, "group", exact_tile(k, self.d), f"qid {qkind}, id {kind}, distance double")
            return ranked(full, k).select(F.col("qid").alias("query_id"), "id", "distance", "rank")
        probes = min(len(self.centres), probes or self.probes)
        depth = max(k, depth or self.depth * -(-k // NEIGHBOURS))
        centres, codebook, d = self.centres, self.codebook, self.d

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each query and group, with the lists of the group that the query probes."""
            for batch in batches:
                near = _nearest(_matrix(batch.column(1), d), centres, probes)
                at, lists = np.repeat(np.arange(batch.num_rows), near.shape[1]), near.ravel()
                order = np.lexsort((lists, lists % groups, at))
                at, lists = at[order], lists[order]
                first = np.flatnonzero(np.diff(at * groups + lists % groups, prepend=-1))
                some = pa.ListArray.from_arrays(pa.array(np.append(first, len(lists)), pa.int32()), pa.array(lists, pa.int32()))
                who = pa.array(at[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(lists[first] % groups, pa.int32()), some], names=["qid", "v", "group", "lists"])

        def tile(codes: pa.Table, some: pa.Table) -> pa.Table:
            out = []
            if codes.num_rows and some.num_rows:
                ids, qid, lst = codes["id"].to_numpy(), some["qid"].to_numpy(), codes["list"].to_numpy()
                q, lists = _matrix(some["v"], d), some["lists"].to_pylist()
                code = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
                rows_of = {int(x): np.flatnonzero(lst == x) for x in np.unique(lst)}
                step = max(1, CELLS // len(ids))
                for at in range(0, len(q), step):
                    part = q[at : at + step]
                    approx = np.full((len(part), len(ids)), np.inf)
                    asking: dict[int, list[int]] = {}
                    for i, mine in enumerate(lists[at : at + step]):
                        for x in mine:
                            asking.setdefault(x, []).append(i)
                    for x, here in rows_of.items():
                        if who := asking.get(x):
                            approx[np.ix_(who, here)] = _coded(part[who] - centres[x], codebook, code[here])
                    i, j = _best(qid[at : at + step], ids, approx, depth)
                    out.append(pa.table({"qid": some["qid"].combine_chunks().take(pa.array(i + at)), "id": codes["id"].combine_chunks().take(pa.array(j)), "list": pa.array(lst[j], pa.int32()), "approx": approx[i, j]}))
            return pa.concat_tables(out) if out else pa.table({"qid": some["qid"].slice(0, 0), "id": codes["id"].slice(0, 0), "list": pa.array([], pa.int32()), "approx": pa.array([], pa.float64())})

        probed = asked.mapInArrow(probe, f"qid {qkind}, v array<double>, group int, lists array<int>")
        few = meet(rows.select("id", "code", "list", group), probed, "group", tile, f"qid {qkind}, id {kind}, list int, approx double")
        best = Window.partitionBy("qid").orderBy("approx", "id")
        kept = few.withColumn("r", F.row_number().over(best)).where(F.col("r") <= depth).select("qid", "id", "list").distinct()
        vectors = kept.join(rows.select("list", "id", F.col("v").cast("array<double>").alias("v")), ["list", "id"]).join(asked.withColumnRenamed("v", "q"), "qid")

        def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                far = np.sqrt(((_matrix(b.column(2), d) - _matrix(b.column(3), d)) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far)], names=["qid", "id", "distance"])

        found = vectors.select("qid", "id", "v", "q").mapInArrow(distances, f"qid {qkind}, id {kind}, distance double")
        return ranked(found, k).select(F.col("qid").alias("query_id"), "id", "distance", "rank")


def _coded(residuals: np.ndarray, codebook: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Squared distances of residuals (queries) to coded rows: a table of each query's distances to all codes, then sums."""
    r = _padded(residuals)
    out = np.zeros((len(r), len(code)))
    for p in range(len(codebook)):
        out += _squares(r[:, p], codebook[p])[:, code[:, p]]
    return out


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """``n_true, n_found``: of the true neighbours (``query_id, id``), how many were found."""
    hit = true.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
