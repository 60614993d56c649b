"""The inverted-file index against brute force."""

import random

import numpy as np
import pytest

from tessera.operators import vector_index as X
from tessera.operators import vectors as V
from tessera.session import shared_dir


def table(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def nearest(vectors, ids, k):
    x = np.array(vectors, np.float32).astype(float)
    out = set()
    for i in ids:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        for rank, j in enumerate([j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]):
            out.add((i, int(j), rank + 1))
    return out


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 10)) * 5
    return np.concatenate([c + rng.normal(size=(60, 10)) for c in centres] + [centres[:1] + 0.1 * rng.normal(size=(900, 10))])


def test_index_has_all_rows_and_its_recall(spark, clusters):
    df = table(spark, clusters)
    ix = X.VectorIndex.build(shared_dir(spark, "ix"), df, lists=20)
    assert ix.rows.count() == len(clusters) and ix.rows.select("list").distinct().count() <= 20 and ix.probes < 20
    asked, ids = df.where("vec_id % 10 = 0"), range(0, len(clusters), 10)
    want = nearest(clusters, ids, 10)
    opened = X.VectorIndex(spark, ix.path)
    got = opened.search(asked, 10).collect()
    found = {(r.query_id, r.id) for r in got}
    assert len({(a, b) for a, b, _ in want} & found) >= 0.9 * len(want) and len(got) == len(want)
    assert {(r.query_id, r.id, r["rank"]) for r in opened.search(asked, 10, exact=True).collect()} == want
    # all lists and all candidates: the codes drop nothing
    assert {(r.query_id, r.id, r["rank"]) for r in opened.search(asked.limit(5), 10, probes=20, depth=5000).collect()} <= want


def test_hot_list_is_many_parts(spark, clusters, monkeypatch):
    monkeypatch.setattr(X, "PART_ROWS", 50)
    monkeypatch.setattr(X, "PART_QUERIES", 7)
    df = table(spark, clusters)
    got = X.brute_force(X.usable(df, "vec_id", "embedding"), X.usable(df.where("vec_id % 100 = 0"), "vec_id", "embedding").withColumnRenamed("id", "qid"), 5, 10)
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == nearest(clusters, range(0, len(clusters), 100), 5)


@pytest.mark.parametrize("cells", [10**9, 10])
def test_nearest_of_many_by_broadcast_and_by_blocks(spark, clusters, monkeypatch, cells):
    monkeypatch.setattr(V, "MAX_QUERY_CELLS", cells)
    df = table(spark, clusters)
    got = V.nearest_of_many(df, df.where("vec_id % 100 = 0"), 5).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == nearest(clusters, range(0, len(clusters), 100), 5)


def test_rows_that_are_no_vectors_and_repeated_ids(spark):
    rng = random.Random(2)
    good = [(i % 40, [rng.random() for _ in range(6)]) for i in range(80)]
    bad = [(None, [1.0] * 6), (50, None), (51, []), (52, [1.0] * 5), (53, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (54, [float("nan")] * 6)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    ix = X.VectorIndex.build(shared_dir(spark, "ix"), df)
    got = ix.search(df, 79, exact=True)
    assert ix.n == 80 and got.select("query_id").distinct().count() == 40
    # a query's two rows each see the 78 rows of other ids
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {79}
    empty = X.VectorIndex.build(shared_dir(spark, "ix"), df.limit(0))
    assert empty.n == 0 and empty.search(df, 3).collect() == [] and empty.search(df, 3, exact=True).collect() == []


def test_k_means_finds_planted_centres(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0, 0], [9, 0, 0, 0], [0, 9, 0, 0], [0, 0, 9, 9]], float)
    points = np.concatenate([c + 0.1 * rng.normal(size=(50, 4)) for c in centres])
    sample = X.usable(table(spark, points), "vec_id", "embedding").select("v").repartition(3)
    got = X.lloyd(sample, points[[0, 50, 100, 150]][None].copy())[0]
    assert np.abs(got - centres).max() < 0.1
