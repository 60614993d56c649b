"""Nodes that score alike are folded into classes: pairs against all pairs, and how many pairs of classes are made."""

import math
import random

from pyspark.sql import functions as F

from tessera.operators import graph as G


def brute(nodes, links):
    """All ordered pairs' ``relevance, n_common, n_shared``, one by one."""
    out, into = {}, {}
    for s, d in set(links):
        out.setdefault(s, set()).add(d)
        into.setdefault(d, set()).add(s)
    ids = sorted({i for i, _, _ in nodes} | set(out) | set(into))
    near = {i: out.get(i, set()) | into.get(i, set()) for i in ids}
    weight = {i: 1 / math.log(max(len(out.get(i, ())) + len(into.get(i, ())), 2)) for i in ids}
    known = {i: (t, s) for i, t, s in nodes}
    got = {}
    for a in ids:
        for b in ids:
            if a == b:
                continue
            both = near[a] & near[b]
            direct = (b in out.get(a, ())) + (a in out.get(b, ()))
            shared = sum(x in known[a][1] for x in known[b][1]) if a in known and b in known else 0
            value = 3 * direct + 4 * shared + 1.5 * sum(weight[n] for n in both)
            rel = round(value + G.AFFINITY.get((known[a][0], known[b][0]), 0.5), 6) if (value or both) and a in known and b in known else None
            got[a, b] = (rel, len(both), shared)
    return got


def test_twins_score_as_they_would_one_by_one(spark):
    rng = random.Random(3)
    nodes, links = [], []
    for i in range(36):  # twelve sites of pages that link alike, of which some have another type or a source twice
        site = i % 12
        nodes.append((f"p{i}", "source" if i % 5 else "query", [f"s{site % 4}"] * (1 + i % 2)))
        links += [(f"p{i}", t) for t in ("hub", f"t{site % 5}", f"t{site // 2}")] + [(f"p{i}", "unlisted")] * (i % 3 == 0)
    nodes += [(t, "entity", ["s0"] if t == "hub" else []) for t in ("hub", *(f"t{i}" for i in range(6)))] + [("alone", "concept", ["s9", "s1"])]
    links += [(f"t{rng.randrange(6)}", f"p{rng.randrange(36)}") for _ in range(6)]
    df = spark.createDataFrame(nodes, "id string, type string, sources array<string>")
    e = spark.createDataFrame(links, "src string, dst string").repartition(3)
    want = brute(nodes, links)
    related = {k: v[0] for k, v in want.items() if v[0] is not None}
    assert {(r.a, r.b): round(r.relevance, 6) for r in G.relevance(df, e).collect()} == related
    assert {(r.a, r.b): r.n_common for r in G.common_neighbours(e).collect()} == {k: v[1] for k, v in want.items() if v[1] and k[0] < k[1]}
    assert {(r.a, r.b): r.n_shared for r in G.shared_sources(df).collect()} == {k: v[2] for k, v in want.items() if v[2]}
    of = df.where("id IN ('p3', 'hub')").select("id")
    assert {(r.a, r.b): round(r.relevance, 6) for r in G.relevance(df, e, of).collect()} == {k: v for k, v in related.items() if k[0] in ("p3", "hub")}
    asked = spark.createDataFrame([*rng.sample(sorted(want), 80), ("hub", "p1"), ("p1", "hub")], "a string, b string")
    assert {(r.a, r.b): round(r.relevance, 6) for r in G.relevance_between(df, e, asked).collect()} == {(r.a, r.b): related[r.a, r.b] for r in asked.collect() if (r.a, r.b) in related}
    best = {}
    for (a, b), v in sorted(related.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        if v >= 2 and len(best.setdefault(a, [])) < 3:
            best[a].append((b, v))
    got = {}
    for r in G.most_related(df, e, 3, 2.0).orderBy("a", "rank").collect():
        got.setdefault(r.a, []).append((r.b, round(r.relevance, 6)))
    assert got == {a: x for a, x in best.items() if x}


def test_pairs_are_made_of_classes(spark):
    """A thousand pages of one site: as many pairs of classes as of two pages."""
    n = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("source").alias("type"), F.array(F.lit("s")).alias("sources"))
    e = n.select(F.col("id").alias("src"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("dst"))
    t = G.twins(e, n)
    assert t.members.select("c").distinct().count() == 2 and t.edges.count() == 1
    assert G._scored(t, n).count() == 1 and G._common(t).count() == 2
    top = G.most_related(n, e, 3, 2.0)
    assert top.count() == 3000 and {r.b for r in top.where("a = 'p1'").collect()} == {"p0", "p10", "p100"}
