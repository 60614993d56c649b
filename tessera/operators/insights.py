"""Surprising connections and knowledge gaps of a link graph.

Nodes: ``id, title, type, link_count, community``; edges: undirected ``a, b`` (and ``weight``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import cohesion

SKIPPED = ("index", "log", "overview")
DISTANT = ("source-concept", "concept-source", "source-synthesis", "synthesis-source", "query-entity", "entity-query")


def surprising(nodes: DataFrame, edges: DataFrame, limit: int = 5, least: int = 3) -> DataFrame:
    """Edges across communities, across types, from the rim to hubs, or weak: ``a, b, score, reasons, key``."""
    most = nodes.agg(F.greatest(F.max("link_count"), F.lit(1)).alias("most"))
    side = lambda p, k: nodes.where(~F.col("id").isin(*SKIPPED)).select(F.col("id").alias(k), *(F.col(c).alias(f"{p}_{c}") for c in ("type", "link_count", "community")))
    e = edges.join(side("x", "a"), "a").join(side("y", "b"), "b").join(F.broadcast(most))
    far, kinds = F.col("x_community") != F.col("y_community"), F.col("x_type") != F.col("y_type")
    distant = kinds & F.concat_ws("-", "x_type", "y_type").isin(*DISTANT)
    rim = (F.least("x_link_count", "y_link_count") <= 2) & (F.greatest("x_link_count", "y_link_count") >= 0.5 * F.col("most"))
    weak = (F.col("weight") > 0) & (F.col("weight") < 2)
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(far, 3) + points(distant, 2) + points(kinds & ~distant, 1) + points(rim, 2) + points(weak, 1)
    reasons = F.array_compact(F.array(
        F.when(far, F.lit("crosses community boundary")), F.when(distant, F.concat(F.lit("connects "), "x_type", F.lit(" to "), "y_type")),
        F.when(kinds & ~distant, F.lit("different types")), F.when(rim, F.lit("peripheral node links to hub")), F.when(weak, F.lit("weak but present connection")),
    ))
    out = e.select("a", "b", score.alias("score"), reasons.alias("reasons"), F.concat_ws(":::", F.least("a", "b"), F.greatest("a", "b")).alias("key"))
    return out.where(F.col("score") >= least).orderBy(F.desc("score"), "key").limit(limit)


def bridges(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """``id, n``: nodes whose neighbours lie in ``least`` communities or more."""
    c = nodes.select("id", "community")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("id")).union(edges.select("b", "a"))
    n = ends.join(c, "id").groupBy("node").agg(F.countDistinct("community").alias("n"))
    return n.where((F.col("n") >= least) & ~F.col("node").isin(*SKIPPED)).select(F.col("node").alias("id"), "n")


def knowledge_gaps(nodes: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """``type, key, n``: isolated pages (as one row), sparse communities, the three widest bridges, in this order."""
    alone = nodes.where((F.col("link_count") <= 1) & (F.col("type") != "overview") & ~F.col("id").isin("index", "log")).agg(F.count("*").alias("n")).where("n > 0")
    isolated = alone.select(F.lit("isolated-node").alias("type"), F.lit(0).alias("section"), F.lit("").alias("key"), "n")
    sparse = cohesion(nodes, edges).where("cohesion < 0.15D AND n_nodes >= 3").select(F.lit("sparse-community").alias("type"), F.lit(1).alias("section"), F.col("community").cast("string").alias("key"), F.col("n_nodes").alias("n"))
    wide = bridges(nodes, edges).orderBy(F.desc("n"), "id").limit(3).select(F.lit("bridge-node").alias("type"), F.lit(2).alias("section"), F.col("id").alias("key"), "n")
    order = ["section", F.when(F.col("section") == 2, -F.col("n")).otherwise(0), "key"]
    top = isolated.union(sparse.orderBy("key").limit(limit)).union(wide)
    return top.withColumn("r", F.row_number().over(Window.orderBy(*order))).where(F.col("r") <= limit)
