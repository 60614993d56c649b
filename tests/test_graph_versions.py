"""A graph kept up to date against one built anew."""

import random

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators.graph_versions import GraphVersions

PAGE = "id string, type string, sources array<string>, links array<string>"


def rebuilt(spark, pages):
    rows = spark.createDataFrame([(i, i, t, f"wiki/{i}.md", s or []) for i, (t, s, _) in pages.items()], "id string, title string, type string, path string, sources array<string>")
    links = spark.createDataFrame([(i, x) for i, (_, _, ls) in pages.items() for x in ls or [] if x is not None], "src string, target string")
    return {(r.a, r.b): round(r.relevance, 6) for r in G.relevance(rows, G.resolve_links(rows, links)).collect()}


def frame(spark, pages):
    return spark.createDataFrame([(i, *p) for i, p in pages.items()], PAGE)


def test_versions_are_what_a_rebuild_gives(spark, tmp_path):
    rng = random.Random(9)
    # targets name pages as they are, in other cases and hyphenated, and some name none
    name = lambda: rng.choice(["p1", "P2", "p 3", "p-3", "P-4", "p5", "p6", "new one", "New-One", "nowhere", "p7", "p8"])
    page = lambda: (rng.choice(["entity", "concept", "source"]), [f"s{rng.randrange(3)}" for _ in range(rng.randrange(3))], [name() for _ in range(rng.randrange(5))])
    pages = {i: page() for i in ("p1", "P2", "p-3", "P-4", "p5", "p6", "p7", "p8")}
    g = GraphVersions(spark, str(tmp_path / "g"))
    assert g.relevance().collect() == []
    same = lambda: {(r.a, r.b): round(r.relevance, 6) for r in g.relevance().collect()} == rebuilt(spark, pages)
    g.advance(frame(spark, pages))
    assert same()
    # a page that others name comes, one changes, one goes, and one that never was goes too
    change = {"new-one": ("entity", ["s1", "s1"], ["p1", None]), "p6": ("source", None, None), "P2": page()}
    pages |= change
    del pages["p5"]
    g.advance(frame(spark, change), spark.createDataFrame([("p5",), ("never",), (None,)], "id string"))
    assert same()
    v = g.compact()
    assert same() and all(len(r) == 1 for r in g.read(v)["runs"].values())
    # the page comes back, and what stays the same writes nothing
    pages["p5"] = page()
    g.advance(frame(spark, {"p5": pages["p5"], "p1": pages["p1"]}))
    assert same()
    before = g.newest()
    g.advance(frame(spark, {"p1": pages["p1"]}))
    last = g.read()["runs"]
    assert g.newest() == before + 1 and same()
    assert all(spark.read.schema(g._schema(t)).parquet(f"{g.root}/{runs[-1]}").count() == 0 for t, runs in last.items())


def test_work_follows_the_change(spark, tmp_path):
    """One page of a long chain changes: the runs of that version hold what is near it alone."""
    chain = {f"n{i}": ("entity", [f"s{i // 4}"], [f"n{i + 1}"]) for i in range(200)}
    g = GraphVersions(spark, str(tmp_path / "g"))
    g.advance(frame(spark, chain))
    g.advance(frame(spark, {"n100": ("concept", ["s25"], ["n102"])}))
    sizes = {t: spark.read.schema(g._schema(t)).parquet(f"{g.root}/{runs[-1]}").count() for t, runs in g.read()["runs"].items()}
    assert 0 < sizes["pairs"] < 20 and sizes["by_source"] == 0 and sizes["forms"] == 0 and sizes["edges"] == 2
    degrees = {r.id: r.degree for r in g.degrees().collect()}
    assert degrees["n102"] == 3 and degrees["n101"] == 1 and degrees["n50"] == 2
    near = g.table("near", keys=spark.createDataFrame([("n100",)], "id string"))
    assert {r.id for r in near.where(F.col("o") + F.col("i") > 0).collect()} == {"n99", "n102"}


def test_pairs_are_kept_between_classes(spark, tmp_path):
    """Sixty pages of one site are one class: as few pairs as of two pages; some leave it, go or come, and the rest goes on as it was."""
    pages = {f"p{i:02}": ("source", ["site"], ["hub", "t"]) for i in range(60)} | {"hub": ("entity", ["h"], []), "t": ("concept", ["h"], ["p07"])}
    g = GraphVersions(spark, str(tmp_path / "g"))
    same = lambda: {(r.a, r.b): round(r.relevance, 6) for r in g.relevance().collect()} == rebuilt(spark, pages)
    g.advance(frame(spark, pages))
    assert same() and g.table("pairs").count() < 12 and g.table("marks").count() == 4
    change = {f"p{i:02}": ("source", ["other", "other"], ["hub"]) for i in (0, 1)} | {"p60": ("source", ["site"], ["hub", "t"]), "p03": ("query", ["site"], ["hub", "t"])}
    pages |= change
    del pages["p02"]
    g.advance(frame(spark, change), spark.createDataFrame([("p02",)], "id string"))
    assert same() and g.table("pairs").count() < 30 and g.table("marks").count() == 6
