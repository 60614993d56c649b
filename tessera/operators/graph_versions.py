"""A relevance graph kept up to date by what changed.

The graph lies in a folder as signed runs: each version adds to every table the rows by which it differs from the one before, and
a table is the sum of its runs. ``advance`` takes changed and deleted pages, and works out from them alone, in this order:
which raw links came and went; which others have to be resolved anew, since a page that they may name came or went; the
edges and degrees that follow; the classes that nodes leave and join; the pairs of neighbours of the nodes whose edges changed;
and the pairs that share a source with a changed page. Only the folders (buckets of a hash) of the nodes, names and sources
concerned are read, so work grows with the change and what it touches, not with the graph. ``relevance`` sums the pairs' runs;
``compact`` makes one run of all.

Nodes with the same links, sources and type (twins, by 128 bits of a hash, their mark) score alike, so pairs are kept between
classes and become rows where they are put out. A class keeps its name as long as its mark, and takes it along where all its members
move to a mark that no other class has: a node without twins stays the class that it was, whatever becomes of it.

Weights of common neighbours are whole numbers of 1e-12, so that sums do not depend on the order of changes: any way to a
graph ends in the rows that a rebuild gives. Versions are committed one at a time; who comes second does its change again.

Pages: ``id, type, sources, links`` (raw targets). Of repeated ids the largest row counts; null ids are left out, null lists are
empty. Deleting a page that is not there changes nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import link_id
from tessera.operators.graph import COMMON_NEIGHBOUR, DIRECT, SHARED_SOURCE, Twins, _paired, affinity
from tessera.session import stored
from tessera.sources.versions import Conflict, Versions

BUCKETS, UNIT = 64, 10**12
#: Tables: the columns that name a row, the column that its bucket comes from, and what is summed.
TABLES = {
    "nodes": ("id string, type string", "id", ("n",)),
    "forms": ("form string, id string, exact boolean", "form", ("n",)),
    "out": ("src string, target string", "src", ("n",)),
    "named": ("key string, src string, target string", "key", ("n",)),
    "edges": ("src string, dst string", "src", ("n",)),
    "near": ("at string, id string", "at", ("o", "i")),
    "by_page": ("id string, s string", "id", ("n",)),
    "classes": ("id string, mark string, c string", "id", ("n",)),
    "marks": ("mark string, c string", "mark", ("n",)),
    "held": ("at string, c string", "at", ("n",)),
    "by_source": ("s string, c string", "s", ("n",)),
    "pairs": ("a string, b string", "a", ("common", "aa", "sab", "sba")),
}


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table][0].split(", ")]


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _summed(rows: DataFrame, table: str) -> DataFrame:
    """Rows that do not cancel out."""
    sums = TABLES[table][2]
    return rows.groupBy(*_names(table)).agg(*(F.sum(c).alias(c) for c in sums)).where(" OR ".join(f"{c} <> 0" for c in sums))


def _keys(target: str | Column) -> Column:
    t = F.col(target) if isinstance(target, str) else target
    return F.array_distinct(F.array(t, link_id(t), F.lower(t)))


def _weight(degree: Column) -> Column:
    return F.round(F.lit(float(UNIT)) / F.log(F.greatest(degree, F.lit(2)).cast("double"))).cast("long")


def _marked(near: DataFrame, by_page: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, mark``: a hash of all that a node is known by."""
    fact = lambda rows, id_, kind, x, n: rows.select(F.col(id_).alias("id"), F.lit(kind).alias("kind"), F.col(x).alias("x"), F.col(n).alias("n"))
    facts = [fact(near.where("o > 0"), "at", "to", "id", "o"), fact(near.where("i > 0"), "at", "from", "id", "i"), fact(by_page, "id", "source", "s", "n"), fact(nodes, "id", "type", "type", "n")]
    hashed = reduce(DataFrame.unionByName, facts).groupBy("id").agg(*(F.bit_xor(F.xxhash64(F.lit(k), "kind", "x", "n")).alias(f"h{k}") for k in (0, 1)))
    known = hashed.join(nodes.select("id").distinct(), "id", "left_semi")
    return known.select("id", F.concat(*(F.lpad(F.hex(h), 16, "0") for h in ("h0", "h1"))).alias("mark"))


class GraphVersions(Versions):
    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self._made: dict[str, DataFrame] = {}

    def _schema(self, table: str) -> str:
        return f"{TABLES[table][0]}, {', '.join(f'{c} long' for c in TABLES[table][2])}, bucket int"

    def table(self, name: str, state: dict | None = None, keys: DataFrame | None = None) -> DataFrame:
        """A table of a state (the newest), or its rows whose bucket column is among ``keys`` (one column)."""
        runs = (self.read() if state is None else state).get("runs", {}).get(name, [])
        schema = self._schema(name)
        if not runs:
            return self.spark.createDataFrame([], schema).drop("bucket")
        rows = reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(f"{self.root}/{r}") for r in runs))
        if keys is not None:
            by, key = TABLES[name][1], keys.columns[0]
            touched = [r.b for r in keys.select(_bucket(key).alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(touched)).join(keys.select(F.col(key).alias(by)).distinct(), by, "left_semi")
        return _summed(rows, name)

    def _run(self, folder: str, name: str, delta: DataFrame) -> DataFrame:
        """A run written, and read again without its buckets."""
        by = TABLES[name][1]
        _summed(delta, name).withColumn("bucket", _bucket(by)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}/{name}")
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.root}/{folder}/{name}").drop("bucket")

    def advance(self, pages: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """The next version, with ``pages`` in place of those of their ids and without ``deleted`` (``id``). Returns its number."""
        none = self.spark.createDataFrame([], "id string, type string, sources array<string>, links array<string>")
        pages = none if pages is None else stored(pages.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("type", "sources", "links")).alias("x")).select("id", "x.*"))
        while True:
            base = self.newest()
            state, folder = self.read(base), f"runs/{uuid.uuid4().hex}"
            for name, delta in self._deltas(state, pages, deleted, base + 1):
                self._made[name] = self._run(folder, name, delta)
            runs = {name: [*state.get("runs", {}).get(name, []), f"{folder}/{name}"] for name in TABLES}
            try:
                return self.commit(base, {"runs": runs})
            except Conflict:
                super().delete(folder)

    def _deltas(self, state: dict, pages: DataFrame, deleted: DataFrame | None, version: int):
        """(table, signed rows) in the order in which they follow from each other; each is written before the next is asked for."""
        made = self._made = {}
        now = pages.select("id")
        changed = (now if deleted is None else now.union(deleted.select(F.col("id").cast("string")))).where("id IS NOT NULL").distinct()
        minus = lambda df: df.withColumn("n", -F.col("n"))
        one = F.lit(1).cast("long").alias("n")
        yield "nodes", minus(self.table("nodes", state, changed)).unionByName(pages.select("id", "type", one))
        listed = lambda c: F.explode(F.coalesce(F.col(c), F.array().cast("array<string>")))
        yield "by_page", minus(self.table("by_page", state, changed)).unionByName(pages.select("id", listed("sources").alias("s"), one))
        links = pages.select(F.col("id").alias("src"), listed("links").alias("target"), one).where("target IS NOT NULL")
        yield "out", minus(self.table("out", state, changed)).unionByName(links)
        yield "named", made["out"].select(F.explode(_keys("target")).alias("key"), "src", "target", "n")
        came = made["nodes"].groupBy("id").agg(F.sum("n").alias("n")).where("n <> 0")
        exact = came.select(F.col("id").alias("form"), "id", F.lit(True).alias("exact"), "n")
        yield "forms", exact.unionByName(came.select(F.explode(F.array_distinct(F.array(F.lower("id"), link_id(F.col("id"))))).alias("form"), "id", F.lit(False).alias("exact"), "n"))
        yield "edges", self._edges(state)
        yield "near", self._near(state)
        yield "classes", self._classes(state, version)
        yield "marks", made["classes"].select("mark", "c", "n")
        turned = self._turned(state)
        yield "held", self._of_classes(state, turned, "near").select(F.col("id").alias("at"), "c", "way").withColumnRenamed("way", "n")
        yield "by_source", self._of_classes(state, turned, "by_page").select("s", "c", (F.col("way") * F.col("n")).alias("n"))
        yield "pairs", self._pairs(state)

    def _resolved(self, targets: DataFrame, forms: DataFrame) -> DataFrame:
        """``target, dst``: as ``resolve_links`` does, from the forms of the targets' keys."""
        each = targets.select("target", F.explode(_keys("target")).alias("form"), link_id(F.col("target")).alias("_l"), F.lower("target").alias("_p"))
        met = each.join(forms.where("n > 0"), "form")
        same = F.col("exact") & (F.col("form") == F.col("target"))
        loose = ~F.col("exact") & ((F.col("form") == F.col("_l")) | (F.col("form") == F.col("_p")))
        return met.groupBy("target").agg(F.coalesce(F.min(F.when(same, F.col("id"))), F.min(F.when(loose, F.col("id")))).alias("dst")).where("dst IS NOT NULL")

    def _edges(self, state: dict) -> DataFrame:
        """Counts of resolved links that change: of links that changed, and of those that may name a page that came or went."""
        made = self._made
        again = self.table("named", state, made["forms"].select("form").distinct()).select("src", "target").distinct()
        all_ = made["out"].select("src", "target").unionByName(again).distinct()
        before = self.table("out", state, all_.select("src").distinct()).join(all_, ["src", "target"], "left_semi")
        after = _summed(before.unionByName(made["out"]), "out")
        targets = all_.select("target").distinct()
        old = self.table("forms", state, targets.select(F.explode(_keys("target")).alias("form")).distinct())
        new = _summed(old.unionByName(made["forms"]), "forms")
        lost = before.join(self._resolved(targets, old), "target").select("src", "dst", (-F.col("n")).alias("n"))
        won = after.join(self._resolved(targets, new), "target").select("src", "dst", "n")
        return lost.unionByName(won).where("dst <> src")

    def _near(self, state: dict) -> DataFrame:
        """Edges that appear or vanish, seen from both ends: ``o`` for those that leave ``at``, ``i`` for those that come in."""
        d = self._made["edges"]
        old = self.table("edges", state, d.select("src").distinct()).withColumnRenamed("n", "n0")
        both = d.join(old, ["src", "dst"], "left").select("src", "dst", F.coalesce("n0", F.lit(0)).alias("n0"), "n")
        di = ((F.col("n0") + F.col("n") > 0).cast("long") - (F.col("n0") > 0).cast("long")).alias("d")
        flips = both.select("src", "dst", di).where("d <> 0")
        zero = F.lit(0).cast("long")
        there = flips.select(F.col("src").alias("at"), F.col("dst").alias("id"), F.col("d").alias("o"), zero.alias("i"))
        return there.unionByName(flips.select(F.col("dst").alias("at"), F.col("src").alias("id"), zero.alias("o"), F.col("d").alias("i")))

    def _now(self, state: dict, table: str, keys: DataFrame) -> DataFrame:
        """The rows of keys as they are after this change."""
        made = self._made[table].join(keys.select(F.col(keys.columns[0]).alias(TABLES[table][1])).distinct(), TABLES[table][1], "left_semi")
        return _summed(self.table(table, state, keys).unionByName(made.select(*_names(table), *TABLES[table][2])), table)

    def _classes(self, state: dict, version: int) -> DataFrame:
        """Nodes whose mark changes, out of the class that they were in and into that of their new mark."""
        made = self._made
        ids = reduce(DataFrame.unionByName, (made["near"].select(F.col("at").alias("id")), made["by_page"].select("id"), made["nodes"].select("id"))).distinct()
        was = self.table("classes", state, ids).select("id", F.col("mark").alias("m0"), F.col("c").alias("c0"))
        is_ = _marked(*(self._now(state, t, ids) for t in ("near", "by_page", "nodes"))).withColumnRenamed("mark", "m1")
        moved = stored(was.join(is_, "id", "full").where("NOT (m0 <=> m1)"))
        left, came = moved.where("m0 IS NOT NULL"), moved.where("m1 IS NOT NULL")
        there = self.table("marks", state, left.select(F.col("m0").alias("mark")).union(came.select("m1")).distinct())
        known = there.select(F.col("mark").alias("m1"), F.col("c").alias("known"))
        # classes that all leave and nobody joins give their names to where their members go, if no class is there
        free = there.join(left.groupBy(F.col("m0").alias("mark")).agg(F.count("*").alias("k")), "mark").where("n = k").join(came.select(F.col("m1").alias("mark")).distinct(), "mark", "left_anti")
        goals = came.join(free.select(F.col("mark").alias("m0"), "c"), "m0").join(known, "m1", "left_anti").groupBy("c").agg(F.min("m1").alias("m1")).groupBy("m1").agg(F.min("c").alias("freed"))
        least = came.groupBy("m1").agg(F.concat(F.min("id"), F.lit(f"@{version}")).alias("new"))
        names = least.join(known, "m1", "left").join(goals, "m1", "left").select("m1", F.coalesce("known", "freed", "new").alias("c"))
        one = F.lit(1).cast("long")
        out = left.select("id", F.col("m0").alias("mark"), F.col("c0").alias("c"), (-one).alias("n"))
        return out.unionByName(came.join(names, "m1").select("id", F.col("m1").alias("mark"), "c", one.alias("n")))

    def _turned(self, state: dict) -> DataFrame:
        """``c, member, way``: classes that go (-1) or come (1) with a mark, each with one that was or is in it; a class that takes its
        name along does both."""
        d = self._made["marks"]
        old = self.table("marks", state, d.select("mark").distinct()).withColumnRenamed("n", "n0")
        each = d.join(old, ["mark", "c"], "left").withColumn("n0", F.coalesce("n0", F.lit(0)))
        way = F.when(F.col("n0") == 0, 1).when(F.col("n0") + F.col("n") == 0, -1).cast("long")
        turned = each.select("mark", "c", way.alias("way")).where("way IS NOT NULL")
        members = self._made["classes"].join(turned, ["mark", "c"]).where("n = way")
        return stored(members.groupBy("mark", "c", "way").agg(F.min("id").alias("member")).select("c", "member", "way"))

    def _of_classes(self, state: dict, turned: DataFrame, table: str) -> DataFrame:
        """Rows of a table of nodes as the classes that go had them and those that come have them, with ``c, way``."""
        by = TABLES[table][1]
        side = lambda way: turned.where(F.col("way") == way).select(F.col("member").alias(by), "c", "way")
        gone, new = side(-1), side(1)
        return self.table(table, state, gone.select(by)).join(gone, by).unionByName(self._now(state, table, new.select(by)).join(new, by))

    def _pairs(self, state: dict) -> DataFrame:
        made, zero = self._made, F.lit(0).cast("long")
        d, dh = made["near"], made["held"]

        def rows(df: DataFrame, **sums) -> DataFrame:
            return df.select("a", "b", *(sums.get(c, zero).cast("long").alias(c) for c in TABLES["pairs"][2]))

        # every pair of neighbours, old or new, of the nodes whose edges or neighbours' classes change
        ats = d.select("at").unionByName(dh.select("at")).distinct()
        e = F.col("o") + F.col("i")
        ends = self.table("near", state, ats).select("at", e.alias("e0"), e.alias("e1")).unionByName(d.select("at", zero.alias("e0"), e.alias("e1")))
        weights = ends.groupBy("at").agg(_weight(F.sum("e0")).alias("w0"), _weight(F.sum("e1")).alias("w1"))
        # those that were twins and still are have the same neighbours: one stands for all
        was, is_ = self.table("classes", state, ats).select(F.col("id").alias("at"), F.col("c").alias("k0")), self._now(state, "classes", ats).select(F.col("id").alias("at"), F.col("c").alias("k1"))
        alike = weights.join(was, "at", "left").join(is_, "at", "left").groupBy("k0", "k1", "w0", "w1").agg(F.min("at").alias("at"), F.count("*").alias("m"))
        alike = stored(alike.select("at", (F.col("w0") * F.col("m")).alias("w0"), (F.col("w1") * F.col("m")).alias("w1"), "m"))
        some = alike.select("at")
        both = self.table("held", state, some).select("at", "c", F.col("n").alias("n0"), F.col("n").alias("n1")).unionByName(dh.join(some, "at", "left_semi").select("at", "c", zero.alias("n0"), F.col("n").alias("n1")))
        held = stored(both.groupBy("at", "c").agg((F.sum("n0") > 0).cast("long").alias("x"), (F.sum("n1") > 0).cast("long").alias("y")).join(alike, "at"))
        met = _paired(held.withColumnRenamed("c", "a"), held.select("at", F.col("c").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2")), "at", "a").where("a <= b")
        was, is_ = F.col("x") * F.col("x2"), F.col("y") * F.col("y2")
        common = met.select("a", "b", ((is_ - was) * F.col("m")).alias("c"), (is_ * F.col("w1") - was * F.col("w0")).alias("w")).where("c <> 0 OR w <> 0")
        # b's entries that a holds: sum over sources of held(a) * entries(b), by its differences
        ds = made["by_source"].select("s", "c", F.col("n").alias("dn"))
        have = self.table("by_source", state, ds.select("s").distinct())
        full = have.select("s", "c", "n", zero.alias("dn")).unionByName(ds.select("s", "c", zero.alias("n"), "dn")).groupBy("s", "c").agg(F.sum("n").alias("n"), F.sum("dn").alias("dn"))
        holds = lambda n: (n > 0).cast("long")
        full = stored(full.select("s", "c", F.col("n").alias("n0"), (F.col("n") + F.col("dn")).alias("n1"), "dn", (holds(F.col("n") + F.col("dn")) - holds(F.col("n"))).alias("dh")))
        flipped = full.where("dh <> 0").select("s", F.col("c").alias("a"), "dh")
        first = _paired(flipped, full.where("n1 <> 0").select("s", F.col("c").alias("b"), "n1"), "s", "a").select("a", "b", (F.col("dh") * F.col("n1")).alias("v"))
        moved = full.where("dn <> 0").select("s", F.col("c").alias("b"), "dn")
        second = _paired(moved, full.where("n0 > 0").select("s", F.col("c").alias("a")), "s", "b").select("a", "b", F.col("dn").alias("v"))
        shared = first.unionByName(second)
        forth, back = shared.where("a <= b"), shared.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"), "v")
        return reduce(DataFrame.unionByName, [rows(common, common=F.col("c"), aa=F.col("w")), rows(forth, sab=F.col("v")), rows(back, sba=F.col("v"))])

    # what a version says

    def relevance(self, version: int | None = None) -> DataFrame:
        """``a, b, relevance`` of every ordered pair with a link, a source or a neighbour in common, as ``graph.relevance``."""
        state = self.read(version)
        classes, nodes = self.table("classes", state).select("id", "c"), self.table("nodes", state)
        sizes = classes.join(nodes, "id").groupBy("c").agg(F.count("*").alias("m"), F.min("type").alias("type"), F.min("id").alias("id"))
        twin = F.col("m") > 1  # a node of its own is spread under its id
        sizes = stored(sizes.select("c", "m", "type", F.struct(twin.alias("twin"), F.when(twin, F.col("c")).otherwise(F.col("id")).alias("name")).alias("k")))
        members = stored(classes.join(sizes, "c").select("id", F.col("k").alias("c"), "m"))
        zero, side = F.lit(0).cast("long"), lambda a, b, n, aa, s: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), n.alias("n"), aa.alias("aa"), s.alias("s"))
        links = self.table("near", state).where("o > 0").select("at", "id").join(classes.select(F.col("id").alias("at"), F.col("c").alias("a")), "at").join(classes.withColumnRenamed("c", "b"), "id").select("a", "b").distinct()
        direct = links.select(F.explode(F.array(side("a", "b", F.lit(1), zero, zero), side("b", "a", F.lit(1), zero, zero))).alias("x"))
        there, back = side("a", "b", F.lit(0), F.col("aa"), F.col("sab")), side("b", "a", F.lit(0), F.col("aa"), F.col("sba"))
        pairs = self.table("pairs", state).select(F.explode(F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))).alias("x"))
        total = pairs.unionByName(direct).select("x.*").groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "aa", "s")))
        kind = lambda side: sizes.select(F.col("c").alias(side), F.col("k").alias(f"_{side}"), F.col("type").alias(f"_t{side}"))
        v = DIRECT * F.col("n") + COMMON_NEIGHBOUR * F.col("aa") / UNIT + SHARED_SOURCE * F.col("s")
        scores = total.join(kind("a"), "a").join(kind("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), (v + affinity(F.col("_ta"), F.col("_tb"))).alias("relevance"))
        return Twins(members, members).spread(scores)

    def degrees(self, version: int | None = None) -> DataFrame:
        near = self.table("near", self.read(version))
        return near.groupBy(F.col("at").alias("id")).agg(F.sum(F.col("o") + F.col("i")).alias("degree"))

    def compact(self) -> int:
        """One run of all, of every table; the rows stay as they are."""
        while True:
            base = self.newest()
            state, folder = self.read(base), f"runs/{uuid.uuid4().hex}"
            for name in TABLES:
                self._run(folder, name, self.table(name, state))
            try:
                return self.commit(base, {"runs": {name: [f"{folder}/{name}"] for name in TABLES}})
            except Conflict:
                super().delete(folder)
