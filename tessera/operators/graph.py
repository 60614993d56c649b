"""Link graphs: resolution, degrees, relevance, filters and communities.

Nodes: ``id, title, type, path, sources``; links: ``src, target`` (raw); edges: ``src, dst``. Relevance is worked out
for pairs that share a link, a source or a neighbour only: all other pairs score their type affinity alone, which is
at most 1.2. Shared neighbours and sources are joined on the shared value; the pairs of a value that very many nodes share
are dealt to ``SALTS`` tasks. Where only some nodes are asked for, only their pairs are made.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import link_id
from tessera.session import checkpointed, stored

#: Weights and type affinities of the relevance rule: fixed values.
DIRECT, SHARED_SOURCE, COMMON_NEIGHBOUR, OTHER_AFFINITY = 3.0, 4.0, 1.5, 0.5
AFFINITY = {
    ("entity", "concept"): 1.2, ("entity", "entity"): 0.8, ("entity", "source"): 1.0, ("entity", "synthesis"): 1.0, ("entity", "query"): 0.8,
    ("concept", "entity"): 1.2, ("concept", "concept"): 0.8, ("concept", "source"): 1.0, ("concept", "synthesis"): 1.2, ("concept", "query"): 1.0,
    ("source", "entity"): 1.0, ("source", "concept"): 1.0, ("source", "source"): 0.5, ("source", "query"): 0.8, ("source", "synthesis"): 1.0,
    ("query", "concept"): 1.0, ("query", "entity"): 0.8, ("query", "synthesis"): 1.0, ("query", "source"): 0.8, ("query", "query"): 0.5,
    ("synthesis", "concept"): 1.2, ("synthesis", "entity"): 1.0, ("synthesis", "source"): 1.0, ("synthesis", "query"): 1.0, ("synthesis", "synthesis"): 0.8,
}
STRUCTURAL = ("index", "overview", "log", "schema", "purpose")


def affinity(a: Column, b: Column) -> Column:
    out = F.lit(OTHER_AFFINITY)
    for (x, y), v in AFFINITY.items():
        out = F.when((a == x) & (b == y), v).otherwise(out)
    return out


def resolve_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose target names a page, by exact id first, else by the first page (least id) whose lower-case or
    hyphenated id equals the target's. Links to the page itself are dropped; repeats stay."""
    n = nodes.select("id")
    exact = links.join(n.withColumnRenamed("id", "_e"), F.col("target") == F.col("_e"), "left")
    forms = n.select("id", F.explode(F.array_distinct(F.array(F.lower("id"), link_id(F.col("id"))))).alias("_f"))
    first = forms.groupBy("_f").agg(F.min("id").alias("_n"))
    loose = first.select(F.col("_f").alias("_f1"), F.col("_n").alias("_n1"))
    plain = first.select(F.col("_f").alias("_f2"), F.col("_n").alias("_n2"))
    found = exact.join(loose, link_id(F.col("target")) == F.col("_f1"), "left").join(plain, F.lower("target") == F.col("_f2"), "left")
    out = found.withColumn("dst", F.coalesce("_e", F.least("_n1", "_n2"))).where("dst IS NOT NULL AND dst <> src")
    return out.drop("_e", "_f1", "_n1", "_f2", "_n2")


def link_counts(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """``id, link_count``: both ends of every resolved link, repeats included."""
    ends = resolved.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("link_count"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("link_count", F.lit(0)).alias("link_count"))


def set_degrees(resolved: DataFrame) -> DataFrame:
    """``id, degree``: distinct out-links plus distinct in-links."""
    e = resolved.select("src", "dst").distinct()
    return e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


#: A value that more than ``HOT`` nodes share is joined in ``SALTS`` parts.
HOT, SALTS = 1000, 32


def _paired(left: DataFrame, right: DataFrame, on: str, left_key: str | Column) -> DataFrame:
    """``left`` joined with ``right`` on ``on``; of a hot value each left row takes one part, and the right rows all of them."""
    parts = right.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(on, F.lit(SALTS).alias("parts"))
    known = lambda df: df.join(parts, on, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = known(left).withColumn("part", F.pmod(F.xxhash64(left_key), F.col("parts")).cast("int")).drop("parts")
    b = known(right).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return a.join(b, [on, "part"]).drop("part")


def undirected(resolved: DataFrame) -> DataFrame:
    """One edge for each linked pair, ``a < b``."""
    return resolved.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def neighbours(resolved: DataFrame) -> DataFrame:
    e = undirected(resolved)
    return e.select(F.col("a").alias("id"), F.col("b").alias("n")).union(e.select(F.col("b").alias("id"), F.col("a").alias("n")))


class Twins(NamedTuple):
    """A graph with its twins folded: nodes that are linked from and to the same nodes, and stand with the same sources and types
    in ``nodes``, score alike with all others, so pairs are worked out between classes. ``members``: ``id, c, m`` (class and its
    size); a class ``c`` is named after its least member, and marked where it has more. ``edges``: ``src, dst`` (classes)."""

    members: DataFrame
    edges: DataFrame

    def of(self, rows: DataFrame) -> DataFrame:
        """Rows with an ``id``, those of the least members alone, with their class ``c`` in its place."""
        return rows.join(self.members.where(F.col("id") == F.col("c.name")).select("id", "c"), "id").drop("id")

    def sizes(self) -> DataFrame:
        return self.members.where(F.col("id") == F.col("c.name")).select("c", "m")

    def weights(self) -> DataFrame:
        """``n, m, w``: classes with their size and the weight of one member as a common neighbour."""
        m = self.sizes()
        size = lambda end, other: self.edges.select(F.col(end).alias("n"), F.col(other).alias("c")).join(m, "c").select("n", "m")
        degree = size("src", "dst").union(size("dst", "src")).groupBy("n").agg(F.sum("m").alias("degree"))
        return degree.join(m.withColumnRenamed("c", "n"), "n").select("n", "m", (F.lit(1.0) / F.log(F.greatest(F.col("degree"), F.lit(2)).cast("double"))).alias("w"))

    def spread(self, pairs: DataFrame, ordered: bool = True, of: DataFrame | None = None) -> DataFrame:
        """Pairs of classes (``a, b`` and values) as pairs of different members: in both orders where ``ordered`` (then ``pairs``
        has both), else with ``a < b``. With ``of`` (``id``), only those whose ``a`` is among it. Members meet in blocks,
        which become rows where they are put out, so no pair of members is shuffled."""
        values = [F.col(c) for c in pairs.columns if c not in ("a", "b")]
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK)).alias("k")
        blocks = lambda ms, side: ms.groupBy(F.col("c").alias(side), block).agg(F.collect_list("id").alias(f"{side}s")).withColumnRenamed("k", f"{side}k")
        left = self.members if of is None else self.members.join(of.select("id").distinct(), "id", "left_semi")
        twins = F.col("a.twin") | F.col("b.twin")
        parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * pairs.sparkSession.sparkContext.defaultParallelism)
        met = pairs.where(twins).join(blocks(left, "a"), "a").join(blocks(self.members, "b"), "b").repartition(parts, "a", "ak", "b", "bk")
        each = met.select("a", "b", "bs", F.explode("as").alias("x"), *values).select((F.col("a") == F.col("b")).alias("own"), "x", F.explode("bs").alias("y"), *values)
        lone = pairs.where(~twins & (F.col("a") != F.col("b"))).select(F.lit(False).alias("own"), F.col("a.name").alias("x"), F.col("b.name").alias("y"), *values)
        if of is not None:
            lone = lone.join(of.select(F.col("id").alias("x")).distinct(), "x", "left_semi").select("own", "x", "y", *values)
        both = each.union(lone)
        if ordered:
            return both.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), *values)
        return both.where("NOT own OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *values)


#: Members of a class that meet others at once.
BLOCK = 256


def twins(resolved: DataFrame | None, nodes: DataFrame | None = None, types: bool = True) -> Twins:
    """The classes of a graph, by 128 bits of a hash of all that a node is known by: links, and what ``nodes`` has of it. The
    tables lie in the shared folder."""
    spark = (nodes if resolved is None else resolved).sparkSession
    e = spark.createDataFrame([], "src string, dst string") if resolved is None else stored(resolved.where("src <> dst").select("src", "dst").distinct())
    fact = lambda rows, id_, kind, x: rows.select(F.col(id_).alias("id"), F.lit(kind).alias("kind"), F.col(x).cast("string").alias("x"))
    facts = [fact(e, "src", "to", "dst"), fact(e, "dst", "from", "src")]
    if nodes is not None:
        facts += [fact(nodes.select("id", F.explode("sources").alias("s")), "id", "source", "s"), *([fact(nodes, "id", "type", "type")] * types)]
    told = reduce(DataFrame.union, facts).groupBy("id", "kind", "x").agg(F.count("*").alias("n"))
    key = told.groupBy("id").agg(*(F.bit_xor(F.xxhash64(F.lit(k), "kind", "x", "n")).alias(f"h{k}") for k in (0, 1)))
    # the least id and the size of a class are found by counting, not by gathering its members
    named = key.groupBy("h0", "h1").agg(F.min("id").alias("name"), F.count("*").alias("m"))
    members = stored(key.join(named, ["h0", "h1"]).select("id", F.struct((F.col("m") > 1).alias("twin"), "name").alias("c"), "m"))
    c = members.select("id", "c")
    folded = e.join(c.select(F.col("id").alias("src"), F.col("c").alias("_s")), "src").join(c.select(F.col("id").alias("dst"), F.col("c").alias("_d")), "dst")
    return Twins(members, stored(folded.select(F.col("_s").alias("src"), F.col("_d").alias("dst")).distinct()) if resolved is not None else folded.select(F.col("_s").alias("src"), F.col("_d").alias("dst")))


def _both_orders(pairs: DataFrame) -> DataFrame:
    """Pairs with ``a <= b``, and those of two classes the other way round too."""
    side = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    ways = F.when(F.col("a") == F.col("b"), F.array(side("a", "b"))).otherwise(F.array(side("a", "b"), side("b", "a")))
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.explode(ways).alias("_x"), *rest).select("_x.*", *rest)


def _common(t: Twins, of: DataFrame | None = None) -> DataFrame:
    """``a, b, m, w``: classes with the members of a class that is a neighbour of both and their weight, ``a <= b``, or all with
    ``a`` among ``of`` (``a``)."""
    nb = neighbours(t.edges)
    x, y = nb.join(t.weights(), "n").select("n", "m", "w", F.col("id").alias("a")), nb.select("n", F.col("id").alias("b"))
    if of is not None:
        x = x.join(of, "a", "left_semi").select("n", "m", "w", "a")
    pairs = _paired(x, y, "n", F.col("a.name")).where("a <= b" if of is None else "true")
    return pairs.where("a <> b OR a.twin").select("a", "b", "m", (F.col("m") * F.col("w")).alias("w"))


def _classes_of(t: Twins, of: DataFrame | None) -> DataFrame | None:
    return None if of is None else t.members.join(of.select("id").distinct(), "id", "left_semi").select(F.col("c").alias("a")).distinct()


def common_neighbours(resolved: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``a, b, n_common, adamic_adar`` of pairs with a neighbour in common: unordered ones (``a < b``), or all with ``a``
    among ``of`` (``id``)."""
    t = twins(resolved)
    pairs = _common(t, _classes_of(t, of)).groupBy("a", "b").agg(F.sum("m").alias("n_common"), F.sum("w").alias("adamic_adar"))
    return t.spread(pairs, of is not None, of)


def _shared(t: Twins, nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``a, b`` (classes, ordered): a row for each entry of b's sources that a's sources hold."""
    s = t.of(nodes.select("id", F.explode("sources").alias("s")))
    x = s.distinct().select("s", F.col("c").alias("a"))
    if of is not None:
        x = x.join(of, "a", "left_semi").select("s", "a")
    return _paired(x, s.select("s", F.col("c").alias("b")), "s", F.col("a.name")).where("a <> b OR a.twin").select("a", "b")


def shared_sources(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``a, b, n_shared`` (ordered pairs): entries of b's sources, repeats included, that a's sources hold; with ``of``,
    pairs whose ``a`` is one of it."""
    t = twins(None, nodes, types=False)
    return t.spread(_shared(t, nodes, _classes_of(t, of)).groupBy("a", "b").agg(F.count("*").alias("n_shared")), True, of)


def _typed(t: Twins, nodes: DataFrame, total: DataFrame) -> DataFrame:
    """``a, b, relevance`` of pairs of classes (``a, b, v``) with the affinity of their types."""
    kinds = t.of(nodes.select("id", "type"))
    typed = total.join(kinds.select(F.col("c").alias("a"), F.col("type").alias("_ta")), "a").join(kinds.select(F.col("c").alias("b"), F.col("type").alias("_tb")), "b")
    return typed.select("a", "b", (F.col("v") + affinity(F.col("_ta"), F.col("_tb"))).alias("relevance"))


def _linked(t: Twins) -> DataFrame:
    """``a, b, v``: classes by the links between a member of each, in both orders."""
    return t.edges.select("src", "dst").union(t.edges.select("dst", "src")).toDF("a", "b").withColumn("v", F.lit(DIRECT))


def _scored(t: Twins, nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``a, b, relevance`` of every ordered pair of classes, a class of twins with itself too."""
    direct = _linked(t) if of is None else _linked(t).join(of, "a", "left_semi").select("a", "b", "v")
    shared = _shared(t, nodes, of).withColumn("v", F.lit(SHARED_SOURCE))
    common = _common(t, of).select("a", "b", (COMMON_NEIGHBOUR * F.col("w")).alias("v"))
    common = _both_orders(common) if of is None else common
    return _typed(t, nodes, direct.union(shared).unionByName(common).groupBy("a", "b").agg(F.sum("v").alias("v")))


def relevance(nodes: DataFrame, resolved: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``a, b, relevance`` of every ordered pair with a link, a source or a neighbour in common, or of those whose ``a`` is one
    of ``of`` (``id``): then no other pair is made on the way."""
    t = twins(resolved, nodes)
    return t.spread(_scored(t, nodes, _classes_of(t, of)), True, of)


def relevance_between(nodes: DataFrame, resolved: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, relevance`` of the given ordered pairs alone: what their classes share is looked up from the one of fewer neighbours
    to the other, so no other pair is made."""
    t = twins(resolved, nodes)
    c = t.members.select("id", "c")
    given = stored(pairs.select("a", "b").distinct().join(c.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b"))
    p = given.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    nb = neighbours(t.edges)
    wide = nb.groupBy("id").agg(F.count("*").alias("d"))
    far = p.join(wide.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(wide.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    less = F.col("da") <= F.col("db")
    turned = far.select("a", "b", F.when(less, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("many"))
    near = turned.join(nb.select(F.col("id").alias("few"), "n"), "few").join(nb.select(F.col("id").alias("many"), "n"), ["many", "n"], "left_semi").join(t.weights(), "n")
    common = near.select("a", "b", (COMMON_NEIGHBOUR * F.col("m") * F.col("w")).alias("v"))
    s = t.of(nodes.select("id", F.explode("sources").alias("s")))
    mine, theirs = s.distinct().select(F.col("c").alias("a"), "s"), s.groupBy(F.col("c").alias("b"), "s").agg(F.count("*").alias("m"))
    shared = p.join(mine, "a").join(theirs, ["b", "s"]).select("a", "b", (SHARED_SOURCE * F.col("m")).alias("v"))
    direct = _linked(t).join(p, ["a", "b"], "left_semi").select("a", "b", "v")
    scores = _typed(t, nodes, direct.unionByName(shared).unionByName(common).groupBy("a", "b").agg(F.sum("v").alias("v")))
    return given.join(scores.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "relevance"), ["ca", "cb"]).select("a", "b", "relevance")


def most_related(nodes: DataFrame, resolved: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
    """What ``related`` finds among all pairs, ``a, b, relevance, rank``, without making them: all members of a class have the same
    best of every other class, and of their own the first ones but for themselves."""
    t = twins(resolved, nodes)
    scores = _scored(t, nodes).where(F.col("relevance") >= least)
    best = [F.desc(F.round("relevance", 9)), "b"]
    order = Window.partitionBy("c").orderBy("id")
    first = t.members.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1).select(F.col("c").alias("b"), F.col("id").alias("_b"))
    named = scores.select(F.col("a").alias("c"), "b", "relevance").join(first, "b").select("c", (F.col("c") == F.col("b")).alias("own"), F.col("_b").alias("b"), "relevance")
    # a window for each class and kind; of one's own class all first ones stay, since each member leaves itself out
    few = named.withColumn("rank", F.row_number().over(Window.partitionBy("c", "own").orderBy(*best))).where(F.col("own") | (F.col("rank") <= k))
    each = t.members.select(F.col("id").alias("a"), "c").join(few.select("c", "b", "relevance"), "c").where("a <> b")
    return related(each.select("a", "b", "relevance"), k, least)


def related(scores: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
    """The ``k`` most relevant of each node, ``rank`` from 1. Exact where ``least`` exceeds any affinity (1.2)."""
    w = Window.partitionBy("a").orderBy(F.desc(F.round("relevance", 9)), "b")
    return scores.where(F.col("relevance") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand(seeds: DataFrame, scores: DataFrame, k: int = 3, least: float = 2.0) -> DataFrame:
    """Pages related to the seeds (``id, pos``), no seed among them, each with its first seed."""
    near = related(scores, k, 0.0).where(F.col("relevance") >= least)
    hits = seeds.join(near, F.col("id") == F.col("a")).join(seeds.select(F.col("id").alias("b")), "b", "left_anti")
    first = F.min_by(F.struct("relevance", F.col("a").alias("seed")), F.struct("pos", "rank"))
    return hits.groupBy("b").agg(first.alias("x")).select(F.col("b").alias("id"), "x.relevance", "x.seed")


def display_graph(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (query pages hidden) with ``link_count`` and undirected edges with ``weight``."""
    shown = nodes.where("type <> 'query'")
    resolved = resolve_links(shown, links.join(shown.select(F.col("id").alias("src")), "src", "left_semi"))
    linked = undirected(resolved)
    edges = linked.join(relevance_between(nodes, resolve_links(nodes, links), linked), ["a", "b"], "left")
    return shown.join(link_counts(shown, resolved), "id"), edges.select("a", "b", F.coalesce("relevance", F.lit(1.0)).alias("weight"))


def is_structural(id_: Column, type_: Column, path: Column) -> Column:
    p = F.lower(F.translate(path, "\\", "/"))
    return F.lower(id_).isin(*STRUCTURAL) | (type_ == "overview") | p.rlike(r"/wiki/(index|overview|log)\.md$|/(purpose|schema)\.md$")


def filter_graph(nodes: DataFrame, edges: DataFrame, hidden_ids: list[str] = (), hidden_types: list[str] = (), hide_structural: bool = True, hide_isolated: bool = False, max_links: int | None = None) -> tuple[DataFrame, DataFrame]:
    keep = F.lit(True)
    if hidden_ids:
        keep = keep & ~F.col("id").isin(*hidden_ids)
    if hidden_types:
        keep = keep & ~F.col("type").isin(*hidden_types)
    if hide_structural:
        keep = keep & ~is_structural(F.col("id"), F.col("type"), F.col("path"))
    if hide_isolated:
        keep = keep & (F.col("link_count") > 0)
    if max_links is not None:
        keep = keep & (F.col("link_count") <= max_links)
    shown = nodes.where(keep)
    ids = shown.select("id")
    visible = edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return shown, visible.select(*edges.columns)


def has_active_filters(hidden_ids=(), hidden_types=(), hide_structural=True, hide_isolated=False, max_links=None) -> bool:
    return bool(hide_structural or hide_isolated or hidden_ids or hidden_types or max_links is not None)


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``community, n_nodes, n_edges, cohesion`` from ``id, community`` and undirected edges."""
    m = members.select("id", "community")
    a, b = m.select(F.col("id").alias("a"), F.col("community").alias("community")), m.select(F.col("id").alias("b"), F.col("community").alias("_cb"))
    inner = edges.select("a", "b").join(a, "a").join(b, "b").where(F.col("community") == F.col("_cb")).groupBy("community").agg(F.count("*").alias("n_edges"))
    sizes = m.groupBy("community").agg(F.count("*").alias("n_nodes"))
    n, e = F.col("n_nodes").cast("double"), F.coalesce("n_edges", F.lit(0))
    return sizes.join(inner, "community", "left").select("community", "n_nodes", e.alias("n_edges"), (e / F.when(n > 1, n * (n - 1) / 2).otherwise(1.0)).alias("cohesion"))


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 1000, checkpoint=None) -> DataFrame:
    """``id, community``: modularity (resolution 1) raised level by level over the whole edge table, deterministic.

    On each level nodes move between communities until no node gains by it (see ``_moved``); then each community becomes
    one node, the edges between two communities one edge, and the next level moves whole communities. The last level is
    the one that leaves as many communities as it found. Communities are named after their least member. Each round and level is kept
    through ``checkpoint`` (default: a table in the shared folder); an error is raised where ``rounds`` do not get there.
    """
    keep = checkpoint or stored
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("n"), "weight").union(edges.select(F.col("b").alias("id"), F.col("a").alias("n"), "weight"))
    both = keep(both.groupBy("id", "n").agg(F.sum("weight").alias("weight")))
    strength = both.groupBy("id").agg(F.sum("weight").alias("k"))
    known = keep(nodes.select("id").join(strength, "id", "left").na.fill(0.0, ["k"]))
    total = known.agg(F.sum("k")).first()[0] or 0.0
    member, n = nodes.select("id", F.col("id").alias("c")), known.count()
    while total:
        label = _moved(known, both, total, rounds, keep)
        fewer = label.select("c").distinct().count()
        if fewer == n:
            break
        n = fewer
        member = keep(member.join(label.select(F.col("id").alias("c"), F.col("c").alias("_to")), "c").select("id", F.col("_to").alias("c")))
        known = keep(known.join(label, "id").groupBy(F.col("c").alias("id")).agg(F.sum("k").alias("k")))
        ends = both.join(label, "id").select(F.col("c").alias("_from"), "n", "weight").join(label.select(F.col("id").alias("n"), F.col("c").alias("_to")), "n")
        both = keep(ends.where("_from <> _to").groupBy(F.col("_from").alias("id"), F.col("_to").alias("n")).agg(F.sum("weight").alias("weight")))
    names = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(names, "c").select("id", "community")


def _moved(known: DataFrame, both: DataFrame, total: float, rounds: int, keep) -> DataFrame:
    """``id, c``: communities after the moves of one level. ``known``: ``id, k`` (strength);
    ``both``: each edge in both directions.

    Each round a node looks at the communities of its neighbours and moves to the one of the largest modularity gain;
    each round some of the nodes, by a hash of id and round, have their turn: half of them at first, then fewer and fewer,
    so that nodes do not go on moving at once to where only one of them would gain. The stopping rule is that no node, on turn or not, gains by a move.
    """
    label = known.select("id", F.col("id").alias("c"))
    for r in range(rounds):
        here = label.join(known, "id")
        mass = here.groupBy("c").agg(F.sum("k").alias("m"))
        toward = both.join(label.select(F.col("id").alias("n"), "c"), "n").groupBy("id", "c").agg(F.sum("weight").alias("w"))
        mine = here.select("id", F.col("c").alias("own"), "k")
        options = toward.unionByName(here.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w")).join(mass, "c").join(mine, "id")
        left = F.col("m") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * left / total, 9)
        best = options.groupBy("id").agg(F.max(F.struct(gain.alias("g"), (F.col("c") == F.col("own")).alias("stay"), F.col("c").alias("c"))).alias("x"), F.first("own").alias("own"))
        turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2 + r // 6)) == 0
        label = keep(best.select("id", F.when(turn, F.col("x.c")).otherwise(F.col("own")).alias("c"), (F.col("x.c") != F.col("own")).alias("gains")))
        done = not label.where("gains").limit(1).count()
        label = label.select("id", "c")
        if done:
            return label
    raise RuntimeError(f"nodes still gain by moves after {rounds} rounds")


def community_table(members: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Communities by falling size, numbered from 0, with cohesion and the five members of most links.
    ``labels``: ``id, title, link_count``. Numbers come from a range sort: partitions are counted first, and only how many
    communities each has meets in one place."""
    order = Window.partitionBy("community").orderBy(F.desc("link_count"), "id")
    top = members.join(labels, "id").withColumn("r", F.row_number().over(order)).where("r <= 5").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]).alias("top_nodes"))
    sized = cohesion(members, edges).join(top, "community")
    return numbered(sized, [F.desc("n_nodes"), F.col("community")], "number")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place (from 0) in a total order, without gathering the rows in one partition."""
    laid = checkpointed(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))  # a row for each partition
    return laid.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def node_size(link_count: Column, most: Column) -> Column:
    return 8 + F.sqrt(link_count / F.greatest(most, F.lit(1))) * 20
