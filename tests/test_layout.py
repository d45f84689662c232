"""Neighbour maps against PCA, and edge rows."""
import numpy as np
from pyspark.sql import functions as F

from postlens.operators import embed_topics as E
from postlens.operators import layout as LY

X = "doc_id long, embedding array<double>"


def knn(x, k):
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(far, np.inf)
    return np.argsort(far, axis=1)[:, :k]


def test_clusters_keep_their_neighbours_better_than_pca(spark):
    rng = np.random.default_rng(4)
    centers = 4 * np.eye(10, 20)
    x = np.concatenate([c + 0.4 * rng.standard_normal((40, 20)) for c in centers])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], X)
    got = {r.doc_id: r.layout for r in LY.neighbour_layout(df).collect()}
    pca = {r.doc_id: r.reduced for r in E.reduce_dims(df, k=2).collect()}
    label = np.repeat(np.arange(10), 40)
    share = {}
    for name, at in (("map", got), ("pca", pca)):
        near = knn(np.array([at[i] for i in range(len(x))]), 15)
        share[name] = (label[near] == label[:, None]).mean()
    assert share["map"] > 0.9 and share["map"] > share["pca"] + 0.2
    y = np.array([got[i] for i in range(len(x))])
    assert np.isfinite(y).all()


def test_a_curve_is_unrolled_and_measured(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.random(300)) * 9 + 3
    x = np.stack([t * np.cos(t), 4 * rng.random(300), t * np.sin(t)], axis=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], X)
    maps = {"map": LY.neighbour_layout(df), "pca": E.reduce_dims(df, k=2).withColumnRenamed("reduced", "layout")}
    got = {r["map"]: r for r in LY.preservation(df, maps).collect()}
    want = knn(x, 15)
    pca = np.array([r.layout for r in maps["pca"].orderBy("doc_id").collect()])
    share = np.mean([len(set(a) & set(b)) / 15 for a, b in zip(want, knn(pca, 15), strict=True)])
    assert got["map"].points == 300 and abs(got["pca"].share - share) < 0.02
    assert 0 < got["map"].share <= 1


def test_edge_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [5.0, 5.0]), (7, [5.0, 5.5])]
    got = {r.doc_id: r.layout for r in LY.neighbour_layout(spark.createDataFrame(rows, X), k=2, steps=3).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[4] is got[5] is None and got[1] == got[2] != got[6]
    assert all(len(v) == 2 and all(np.isfinite(v)) for v in got.values() if v is not None)
    one = LY.neighbour_layout(spark.createDataFrame([(1, [2.0, 3.0])], X)).collect()
    assert [(r.doc_id, r.layout) for r in one] == [(1, [0.0, 0.0])]
    assert LY.neighbour_layout(spark.createDataFrame([], X)).collect() == []
    thin = LY.neighbour_layout(spark.createDataFrame([(i, [float(i)]) for i in range(9)], X), k=3, steps=2)
    assert thin.filter(F.size("layout") == 2).count() == 9


def test_neighbours_are_searched_once_for_map_and_measure(spark, monkeypatch):
    import random

    from postlens.operators import layout as LY

    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame([*rows, (60, rows[0][1]), (61, None)], "doc_id long, embedding array<double>")
    calls, real = [], LY.nearest
    monkeypatch.setattr(LY, "nearest", lambda *a, **k: calls.append(1) or real(*a, **k))
    found = LY.neighbours(v, k=5)
    xy = LY.neighbour_layout(v, k=5, steps=2, found=found)
    one = LY.preservation(v, {"map": xy}, k=5, found=found).collect()
    assert len(calls) == 2          # the vectors' and the map's
    assert one == LY.preservation(v, {"map": xy}, k=5).collect() and one[0].points == 60
