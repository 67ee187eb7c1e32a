"""Trained indexes on clustered vectors: starts, empty cells, rebuilds, and search by rotated codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import index, search
from quillon.sources import store
from quillon.sources.gallery import clustered


@pytest.fixture(scope="module")
def blobs(spark):
    return clustered(spark, 1200, dim=16, blobs=12, noise=0.1, seed=3).cache()


def test_clustered(spark, blobs):
    again = clustered(spark, 1200, dim=16, blobs=12, noise=0.1, seed=3).repartition(7)
    assert sorted(map(tuple, blobs.select("id", "blob").collect())) == sorted(map(tuple, again.select("id", "blob").collect()))
    x = np.array([r["img"] for r in blobs.collect()])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)


def test_spread_starts_find_every_cluster(blobs):
    c = index.kmeans(blobs, 12, iters=2, spread=True)
    cells = index.filed(blobs, c).groupBy("blob").agg(F.count_distinct("cell").alias("n"))
    assert [r["n"] for r in cells.collect()] == [1] * 12


def test_spread_out():
    chosen, left = index.spread_out(np.eye(4)[[0, 0, 1, 2, 1]], 3)
    assert chosen.tolist() == np.eye(4)[[0, 1, 2]].tolist() and len(left) == 2
    assert len(index.spread_out(np.eye(2), 5)[0]) == 2


def test_empty_cells_are_reseeded(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(i, [0.0, 1.0]) for i in range(30, 34)]
    items = spark.createDataFrame(rows, "id long, img array<double>")
    c = index.ivf_train(items, 2, iters=4)
    used = {r["cell"] for r in index.filed(items, c).select("cell").distinct().collect()}
    first = index.first_centroids(items, 2)
    assert (first[0] == first[1]).all(), "both start at copies, so one cell is empty at first"
    assert used == {0, 1}
    books = index.pq_train(items, 2, 2, iters=4)
    assert np.allclose(index.encode(np.eye(2), books)[1], np.eye(2))


def test_healed(spark, tmp_path, blobs):
    built = []

    def build(rows):
        built.append(1)
        return rows.select("id")

    some, folder = blobs.where("id < 100"), str(tmp_path / "i")
    assert [index.healed(rows, folder, build)[1] for rows in (some, some, blobs, blobs, some)] == [True, False, True, False, True]
    assert index.healed(some, folder, build)[0].count() == 100 and len(built) == 3


@pytest.mark.parametrize("turn", [True, False])
def test_search_by_codes(blobs, turn):
    rotation, books = index.opq_train(blobs, 4, 16, outer=2) if turn else (None, index.pq_train(blobs, 4, 16))
    asked = blobs.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("img").alias("qv"))
    x = np.array([r["img"] for r in blobs.orderBy("id").collect()])
    hits = search.search(asked, blobs, method="opq", k=10, books=books, rotation=rotation, short=100).collect()
    recall = np.mean([len({h["id"] for h in hits if h["qid"] == q} & set(np.argsort(-(x @ x[q]), kind="stable")[:10].tolist())) / 10 for q in range(0, 1200, 20)])
    assert len(hits) == 600 and recall >= 0.9


def test_zipped(spark):
    a, b = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "i int, x string"), spark.createDataFrame([(9, "z"), (8, "y")], "j int, y string")
    assert sorted((r["pos"], r["x"], r["y"]) for r in store.zipped(a, b, ["i"], ["j"]).collect()) == [(0, "a", "y"), (1, "b", "z")]
    with pytest.raises(Exception, match="different lengths"):
        store.zipped(a, b, ["i"], ["j"], strict=True).collect()
