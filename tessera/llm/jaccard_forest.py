"""N-gram Jaccard join with a MinHash LSH forest.

Texts are sets of 5-word shingles (a text of fewer words is one shingle); texts with equal sets are one class, so copies
are never compared with each other. Each class has one signature of ``DEPTH`` minhashes in each of ``TREES`` trees. A
tree is its signatures in sorted order, in which every prefix is a run of neighbours: a node of the prefix trie. All
nodes of the levels ``ROOT`` to ``DEPTH`` are counted.

Each class starts with its full signature in every tree and shortens the matched prefix level by level until a class at
the threshold meets it somewhere with probability ``RECALL``. Nodes of more than ``CROWD`` classes are left out of that
where it can be afforded: a prefix that is crowded stays long. As what crowds a prefix (text that very many share) is
found in near-duplicates as well, the trees left out are taken off every tree's chance of a match, ``s**depth - share``,
and not only off their number; where no depth gives the recall without the crowded nodes, they are matched like all
others. A node that some class stops at is open: all classes below it are candidates of each other.

Candidates are verified exactly on whole sets before anything is connected. Classes are laid out in blocks of at most
``BLOCK``, each beside the others that met the same least class in most trees; a pair of blocks is a task if some open node has classes in both,
and then it holds the classes of the nodes that do (all of both blocks, for nodes of more than ``BLOCK`` classes). What a task returns grows with its classes (links counted, one tie each), never with its pairs. Connected
components are taken of verified links alone.

Each row of the result has ``class_id`` (least id of the rows with the same set), ``n_links`` (other classes of
similarity ``THRESHOLD`` or more) and ``group_id`` (least id of the rows that links connect).

Null and wordless texts have the empty set: they are one class without links. Null ids are passed over when the least
id is sought; a group of null ids alone has a null id. Repeated rows are rows of one class. Rows are told apart by 128
bits of a hash of id and text; shingles and classes by 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import alnum_words, gram_hashes, mix, packed, paths_of, remove, row_key, rows, sized, word_hashes, written
from tessera.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES, ROOT, DEPTH, RECALL = 40, 5, 10, 0.9999
#: Bits that a minhash below the root has in a signature (equal bits of unequal minhashes only add candidates).
BITS = 60 // (DEPTH - ROOT)
CROWD = 32
BLOCK, BLOCK_CHARS = 256, 2_000_000


def prefix_levels(sizes: list[list[int]], threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, crowd: int = CROWD) -> list[int]:
    """The level (0: ``ROOT``) at which a class matches in each tree where it is not alone at the root. ``sizes``: how many
    classes share its prefix at each level of those trees."""
    last = DEPTH - ROOT
    enough = lambda p: 1 - (1 - max(p, 0)) ** trees >= recall
    for at in range(last, -1, -1):
        left_out = sum(n[at] > crowd for n in sizes)
        if enough(threshold ** (ROOT + at) - left_out / trees):
            return [next((a for a in range(at, last) if n[a] <= crowd), last) for n in sizes]
    return [max((a for a in range(last + 1) if enough(threshold ** (ROOT + a))), default=0)] * len(sizes)


def shingle_set(text: str) -> np.ndarray:
    ids = word_hashes(alnum_words(text))
    return np.unique(gram_hashes(ids, min(SHINGLE, len(ids)))) if len(ids) else np.empty(0, np.uint64)


def _signatures(df: DataFrame) -> DataFrame:
    """``rk, id, cid, n_chars, trees``: the row's key, the set's hash, and ``root, tail`` of the signature in each tree: the
    hash of the first ``ROOT`` minhashes, and ``BITS`` bits of each further one, so that tails sort as signatures do."""
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)
    kinds = pa.struct([("root", pa.int64()), ("tail", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int32()), batch.column(2)], names=["i", "text"])
            for at, texts in rows([both], 600_000):
                sets = [shingle_set(t) for t in texts]
                full = [s for s in sets if len(s)]
                root, tail = np.empty((2, 0), np.int64)
                if full:
                    x = (np.concatenate(full) >> np.uint64(32)).astype(np.uint32)
                    starts = np.cumsum([0, *(len(s) for s in full[:-1])])
                    least = np.stack([np.minimum.reduceat(p * x + q, starts) for p, q in zip(a, b)], 1).reshape(len(full), TREES, DEPTH)
                    label = np.tile(np.arange(TREES, dtype=np.uint64), (len(full), 1))
                    for i in range(ROOT):
                        label = mix(label + least[:, :, i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    low = np.zeros_like(label)
                    for i in range(ROOT, DEPTH):  # the high bits of a minimum say little before they are mixed
                        low = (low << np.uint64(BITS)) | ((least[:, :, i] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64)
                    root, tail = label.ravel().view(np.int64), low.ravel().view(np.int64)
                ends = np.cumsum([0, *(TREES * (len(s) > 0) for s in sets)])
                trees = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(root), pa.array(tail)], fields=list(kinds)))
                cid = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
                mine = batch.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), pa.array(cid, pa.int64()), pa.array(map(len, texts), pa.int64()), trees], names=["rk", "id", "cid", "n_chars", "trees"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("rk", "id", "text").mapInArrow(run, f"rk binary, id {kind}, cid long, n_chars long, trees array<struct<root: long, tail: long>>")


def _linked(sets: list[np.ndarray], side: np.ndarray, cross: bool, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold; with ``cross``, only pairs of different sides count."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), size)
    shared = df[col] > 1
    number = np.cumsum(df > 1) - 1
    doc, col = doc[shared], number[col[shared]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    both, step = np.zeros((n, n), np.float64), 8192
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, [lo, lo + step])
        m = np.zeros((n, step), np.float32)
        m[doc[i:j], col[i:j] - lo] = 1
        both += m @ m.T
    ok = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(ok, False)
    return ok & (side[:, None] != side[None, :]) if cross else ok


def _roots(ok: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links, the least row that links lead to."""
    root = np.arange(len(ok))
    while True:
        least = np.minimum(root, np.where(ok, root[None, :], len(ok)).min(1, initial=len(ok)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _verified(texts: DataFrame, threshold: float) -> DataFrame:
    """Tasks ``i, j`` of rows ``cid, side, text`` verified: ``cid, n, lead`` for each class of a task."""

    def judge(group: list[tuple]) -> pa.RecordBatch:
        i, j = group[0][:2]
        cids = np.array([g[2] for g in group], np.int64)
        ok = _linked([g[4] for g in group], np.array([g[3] for g in group]), i != j, threshold)
        return pa.RecordBatch.from_arrays([pa.array(cids), pa.array(ok.sum(1), pa.int64()), pa.array(cids[_roots(ok)])], names=["cid", "n", "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            for k, key in enumerate(zip(*cols)):
                if group and group[0][:2] != key[:2]:
                    yield judge(group)
                    group = []
                if not group or group[-1][2] != key[2]:  # a repeated row comes once
                    group.append((*key, shingle_set(batch.column(4)[k].as_py() or "")))
        if group:
            yield judge(group)

    dealt = texts.repartition("i", "j").sortWithinPartitions("i", "j", "cid")
    return dealt.select("i", "j", "cid", "side", "text").mapInArrow(run, "cid long, n long, lead long")


def _open_nodes(trie: DataFrame, threshold: float) -> DataFrame:
    """``g, cid``: the open node that is nearest to the root on each path, with the classes below it."""
    level = F.explode(F.sequence(F.lit(0), F.lit(DEPTH - ROOT))).alias("level")
    nodes = trie.select("cid", "root", "tail", level)
    nodes = nodes.select("cid", "root", "level", F.xxhash64("root", "level", F.expr(f"shiftright(tail, {BITS} * ({DEPTH - ROOT} - level))")).alias("node"))
    sizes = written(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node-sizes", True)
    # a class has at most TREES paths of a few levels each
    paths = nodes.join(sized(sizes), "node").groupBy("cid").agg(F.collect_list(F.struct("root", "level", "node", "n")).alias("path"))

    def stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                trees: dict[int, list] = {}
                for x in path:
                    trees.setdefault(x["root"], [(None, 1)] * (DEPTH - ROOT + 1))[x["level"]] = (x["node"], x["n"])
                for tree, at in zip(trees.values(), prefix_levels([[n for _, n in t] for t in trees.values()], threshold)):
                    if tree[at][0] is not None:
                        out.append(tree[at][0])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["node"])

    opened = written(paths.select("path").mapInArrow(stops, "node long").distinct(), "open-nodes", True)
    first = nodes.join(sized(opened), "node").groupBy("cid", "root").agg(F.min(F.struct("level", "node")).alias("x"))
    out = written(first.select(F.col("x.node").alias("g"), "cid"), "candidate-groups", True)
    for gone in (sizes, opened):
        for p in paths_of(gone):
            remove(trie.sparkSession, p)
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """``cid, rk, block`` of ``cid, rk, n_chars, run, anchor``: pieces of the order of runs and anchors, bounded in classes and characters,
    however many partitions there are (one row of each is added up to say where the next one starts)."""
    least = BLOCK_CHARS // BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.maximum(batch.column(2).to_numpy(), least)
            ends = total + np.cumsum(size)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(size), part), pa.int32()), pa.array(ends, pa.int64())], names=["cid", "rk", "part", "upto"])

    dealt = members.repartitionByRange("run", "anchor", "cid").sortWithinPartitions("run", "anchor", "cid")
    laid = written(dealt.select("cid", "rk", "n_chars").mapInArrow(run, "cid long, rk binary, part int, upto long"), "laid-out")
    parts = laid.groupBy("part").agg(F.max("upto").alias("size"))
    starts = parts.select("part", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("start"))
    return laid.join(F.broadcast(starts), "part", "left").select("cid", "rk", F.expr(f"(coalesce(start, 0L) + upto) div {BLOCK_CHARS}").alias("block"))


def _tasks(groups: DataFrame, placed: DataFrame) -> DataFrame:
    """``i, j, cid, rk, side``: the classes that each block (``i = j``) or pair of blocks compares."""
    of = placed.select("cid", "block")
    spans = written(groups.join(sized(of), "cid").select("g", "block", "cid"), "spans", True)
    where = spans.groupBy("g", "block").agg(F.count("*").alias("n"))
    over = where.groupBy("g").agg(F.count("*").alias("b"), F.sum("n").alias("size")).where("b > 1").select("g", "size")
    wide = written(where.select("g", "block").join(sized(over), "g"), "group-blocks", True)
    pairs = wide.select("g", "size", F.col("block").alias("i")).join(wide.select("g", F.col("block").alias("j")), "g").where("i < j")
    few = pairs.where(F.col("size") <= BLOCK).select("g", "i", "j").join(spans, "g").where("block = i OR block = j").select("i", "j", "cid").distinct()
    many = written(pairs.where(F.col("size") > BLOCK).select("i", "j").distinct(), "block-pairs", True)
    whole = many.withColumn("block", F.explode(F.array("i", "j"))).join(sized(of), "block").select("i", "j", "cid")
    own = of.select(F.col("block").alias("i"), F.col("block").alias("j"), "cid")
    every = few.union(whole).distinct().union(own)
    return every.join(sized(placed), "cid").select("i", "j", "cid", "rk", (F.col("block") == F.col("j")).cast("int").alias("side"))


def link_groups(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(``rk, id, cid`` of every row, ``cid, n_links, gid`` of every class that has a candidate), both written."""
    spark = docs.sparkSession
    keyed = docs.select(row_key(id_col, text_col).alias("rk"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = written(_signatures(keyed), "signatures")
    each = sig.select("cid", F.inline("trees"))
    met = written(each.groupBy("root").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("root"), "shared-roots")
    trie = written(each.join(sized(met), "root").distinct().repartitionByRange("root", "tail").sortWithinPartitions("root", "tail"), "trie")
    groups = _open_nodes(trie, threshold)
    lead = groups.groupBy("g").agg(F.min("cid").alias("lead"), F.count("*").alias("size"))
    # the least class that it meets in the most trees (chance meetings are those of one tree); first of all, though, what lies
    # in a node that no block holds goes with the largest such node, so that this node spans few blocks
    often = groups.join(lead, "g").groupBy("cid", "lead").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    most, top = F.min(F.struct((-F.col("n")).alias("n"), "lead"))["lead"], F.max(F.struct("size", "lead"))
    anchors = written(often.groupBy("cid").agg(most.alias("anchor"), top.alias("top")).select("cid", F.when(F.col("top.size") > BLOCK, F.col("top.lead")).otherwise(F.col("anchor")).alias("run"), "anchor"), "anchors", True)
    members = sig.select("cid", "rk", "n_chars").join(sized(anchors), "cid").groupBy("cid", "run", "anchor").agg(F.min("rk").alias("rk"), F.max("n_chars").alias("n_chars"))
    placed = written(_blocks(members), "blocks", True)
    tasks = written(_tasks(groups, placed), "tasks", True)
    judged = written(_verified(keyed.select("rk", "text").join(sized(tasks), "rk"), threshold), "verified")
    joined = components(judged.where("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")))
    links = judged.groupBy("cid").agg(F.sum("n").alias("n_links"))
    found = links.join(joined.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "n_links", F.coalesce("comp", "cid").alias("gid"))
    found = written(found, "link-groups", True)
    for gone in (met, trie, groups, anchors, placed, tasks, judged):
        for p in paths_of(gone):
            remove(spark, p)
    return sig.select("rk", "id", "cid"), found


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, n_links, group_id`` for each row of ``docs``."""
    sig, groups = link_groups(docs, id_col, text_col, threshold)
    classes = sig.groupBy("cid").agg(F.min("id").alias("class_id"))
    of = written(classes.join(groups, "cid", "left").select("cid", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("gid", "cid").alias("gid")), "classes", True)
    ids = of.groupBy("gid").agg(F.min("class_id").alias("group_id"))
    of = of.join(ids, "gid").select("cid", "class_id", "n_links", "group_id")
    return sig.join(of, "cid").select(F.col("id").alias(id_col), "class_id", "n_links", "group_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the least id stays (of equal ids, that of the
    least hash of id and text), once; of rows that are equal in both, the one whose columns come first as JSON."""
    sig, groups = link_groups(docs, id_col, text_col, threshold)
    ranked = sig.join(groups.select("cid", "gid"), "cid", "left").select("rk", "id", F.coalesce("gid", "cid").alias("gid"))
    per_row = ranked.groupBy("gid", "rk", "id").agg(F.count("*").alias("copies"))
    first = per_row.groupBy("gid").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rk")).alias("x")).select("gid", F.col("x.rk").alias("keep"))
    marked = per_row.join(first, "gid").select("rk", (F.col("rk") == F.col("keep")).alias("stays"), "copies")
    odd = written(marked.where("NOT stays OR copies > 1"), "rows-to-drop", True)
    keyed = packed(docs, row_key(id_col, text_col).alias("rk"))
    single = keyed.join(sized(odd).select("rk"), "rk", "left_anti").select("row")
    again = keyed.join(sized(odd.where("stays").select("rk")), "rk", "left_semi")
    once = again.groupBy("rk").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.union(once).select("row.*")
