"""Divergence of sources: dense tiles of groups by terms.

Terms are runs of letters (and of all characters beyond ASCII), A-Z in lower case. Tasks count them per (lang, source,
term) and how many rows hold them; counts are added up by all three, so a frequent term or a large source is spread. Each
language keeps the terms of at least ``min_docs`` of its rows.

The kept terms of a language are dealt into blocks of about ``BLOCK_TERMS`` by hash, and its sources, numbered by name,
into blocks of ``BLOCK_GROUPS``. A tile (language, two blocks of sources, block of terms) is one dense int64 matrix for each
block of sources: parts per thousand million of each (group, term), terms that a group lacks included. All pairs of its
groups are computed by broadcasting, a bounded number of cells at a time, and summed over the tile's terms; Spark adds the
partial pair matrices of all tiles. Tiles on the diagonal also compare their groups with the language and keep a heap of
the ``top`` largest terms for each group; the heaps are merged by rank. Tiles are as many as the work needs, and none
holds more than its blocks, however large a source or a language is; the result itself has a row for each pair of sources.

All arithmetic is exact: shares come from a long division in steps that fit 64 bits (languages of up to 9e15 terms).
Null texts, languages and sources count as empty strings; rows of one id count apart. Groups without terms take part, and
a language without kept terms gives its pairs the value 0. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, rows, sized, written

#: Fixed values of the result's definition.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
PARTS, MIN_DOCS, TOP = 1_000_000_000, 3, 200

BLOCK_TERMS, BLOCK_GROUPS = 4096, 256
#: Cells of one broadcast product, and distinct (lang, source, term) that a task counts before it passes them on.
CELLS, COUNTED = 1 << 20, 200_000


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and rows that hold the term."""
    find = re.compile(TERM).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, size = {}, {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                k = len(terms)
                cols = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(terms), pa.string()), pa.array(list(terms.values()), pa.int64()), pa.array([held[lang, source][t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            at = 0
            for _, texts in rows([pa.RecordBatch.from_arrays([batch.column(1), batch.column(0)], names=["l", "t"])]):
                for text in texts:
                    key = langs[at], sources[at]
                    at += 1
                    found = find(lower_ascii(text))
                    if not found:
                        continue
                    mine = n.setdefault(key, Counter())
                    before = len(mine)
                    mine.update(found)
                    held.setdefault(key, Counter()).update(set(found))
                    size += len(mine) - before
                    if size >= COUNTED:
                        yield from out()
                        n, held, size = {}, {}, 0
        yield from out()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = docs.select(empty(text_col).alias("text"), empty(lang_col).alias("lang"), empty(source_col).alias("source"))
    counted = each.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(PARTS * (count + 1) / total)``, exact for totals up to 9e15, as long division by thousands."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over the terms (columns) of the divergence of each row of ``p`` from each row of ``q``."""
    step = max(1, CELLS // max(1, q.size))
    return np.concatenate([divergence(p[i : i + step, None, :], q[None, :, :]).sum(-1) for i in range(0, len(p), step)])


def _tile(top: int, block_groups: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        lang, a, b = f["lang"].iat[0], f["a"].iat[0], f["b"].iat[0]
        is_group = f["term"].isna().to_numpy()
        groups, cells = f[is_group].sort_values("g"), f[~is_group]
        names, g = groups["source"].to_numpy(), groups["g"].to_numpy()
        v, n, n_lang = int(groups["v"].iat[0]), groups["n"].to_numpy(np.int64), int(groups["n_lang"].iat[0])
        codes, terms = pd.factorize(cells["term"])
        counts = np.zeros((len(g), len(terms)), np.int64)
        counts[np.searchsorted(g, cells["g"].to_numpy()), codes] = cells["n"].to_numpy(np.int64)
        p = shares(counts, (n + v)[:, None]) if len(terms) else counts
        # terms of the block that only sources of other blocks hold: alike for all of them
        others = int(groups["m"].fillna(0).iat[0]) - len(terms)
        bare = shares(np.zeros((len(g), 1), np.int64), (n + v)[:, None]) if others else None
        side = (g // block_groups).astype(int)
        out = []
        for x, y in {(a, b), (b, a)}:
            ix, iy = np.flatnonzero(side == x), np.flatnonzero(side == y)
            value = pair_sums(p[ix], p[iy])
            if others:
                value = value + others * pair_sums(bare[ix], bare[iy])
            i, j = np.nonzero(g[ix][:, None] != g[iy][None, :])
            out.append(pd.DataFrame({"source": names[ix][i], "part": "pair", "item": names[iy][j], "value": value[i, j]}))
        if a == b and len(terms):
            total = np.zeros(len(terms), np.int64)
            total[codes] = cells["n_term"].to_numpy(np.int64)
            q = shares(total, np.int64(n_lang + v))
            for i, name in enumerate(names):
                over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                best = heapq.nsmallest(top, zip((-divergence(p[i, over], q[over])).tolist(), terms[over]))
                out.append(pd.DataFrame({"source": name, "part": "term", "item": [t for _, t in best], "value": [-x for x, _ in best]}))
        return pd.concat(out).assign(lang=lang)[["lang", "source", "part", "item", "value"]]

    return run


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source the divergence from every other source of its language
    (part ``pair``), and its ``top`` terms above the language's share (part ``term``)."""
    counts = term_counts(docs, text_col, lang_col, source_col)
    by_term = Window.partitionBy("lang", "term")
    kept = counts.withColumn("held", F.sum("docs").over(by_term)).withColumn("n_term", F.sum("n").over(by_term)).withColumn("once", F.min("source").over(by_term) == F.col("source"))
    kept = written(kept.where(F.col("held") >= min_docs).select("lang", "source", "term", "n", "n_term", "once"), "kept-terms")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct()
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    per_lang = kept.where("once").groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_term").alias("n_lang"))
    numbered = groups.join(per_group, ["lang", "source"], "left").join(sized(written(per_lang, "languages")), "lang", "left")
    numbered = numbered.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    last = F.max("g").over(Window.partitionBy("lang"))
    facts = numbered.select("lang", "source", "g", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), last.alias("last"))
    facts = written(facts.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).cast("int")), "groups")
    block = F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block")
    nothing = F.lit(None).cast("long")
    cells = kept.join(sized(facts.select("lang", "source", "g", "last", "blocks")), ["lang", "source"])
    cells = cells.select("lang", "source", "g", "last", block, "term", "n", "n_term", nothing.alias("v"), nothing.alias("n_lang"), nothing.alias("m"))
    in_block = kept.where("once").join(sized(facts.select("lang", "blocks").distinct()), "lang").groupBy("lang", block).agg(F.count("*").alias("m"))
    # every tile gets all its groups, also those that hold none of its terms
    marks = facts.select("lang", "source", "g", "last", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(None).cast("string").alias("term"), "n", nothing.alias("n_term"), "v", "n_lang")
    marks = marks.join(sized(written(in_block, "blocks")), ["lang", "block"], "left")
    mine = F.floor(F.col("g") / block_groups).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / block_groups).cast("int")))
    dealt = cells.unionByName(marks).withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.withColumn("a", F.least("mine", "other")).withColumn("b", F.greatest("mine", "other")).drop("mine", "other", "last")
    tiles = written(dealt.groupBy("lang", "a", "b", "block").applyInPandas(_tile(top, block_groups), "lang string, source string, part string, item string, value long"), "tiles")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = tiles.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms.select(pairs.columns))
