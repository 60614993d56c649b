"""Connected components of an edge table, distributed: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import paths_of, remove, written


#: A node of very many edges is dealt to this many tasks where its edges meet their least node.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges ``a, b`` with the ``m`` of their ``a``: each edge takes one salt by its ``b``, each ``m`` takes all."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    return salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["a", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``node, comp`` for every node of an edge (columns ``a, b``, longs): ``comp`` is the least node reachable.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round; what the
    driver sees of a round is its row count and checksum. Minima are combined before the shuffle, and the joins that
    follow are salted. Rounds grow with the logarithm of the longest path; edges that are not settled after
    ``most_rounds`` raise an error.
    """
    spark = edges.sparkSession
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges", True)
    before = _state(now)
    for _ in range(most_rounds if before[0] else 0):
        after = written(_small_star(_large_star(now)), "edges", True)
        for p in paths_of(now):
            remove(spark, p)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    else:
        if before[0]:
            raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)
