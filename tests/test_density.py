"""M7: spanning forest, components and clusters against plain versions on small inputs."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import density as D
from postlens.operators import graph as G

X = "doc_id long, reduced array<double>"


def kruskal(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x
    out = set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, w))
    return out


@pytest.mark.parametrize("size", [None, 10, 1000])
def test_spanning_forest_equals_kruskal(spark, size):
    rng = random.Random(5)
    edges = {(min(a, b), max(a, b)): float(rng.randint(1, 9)) for a, b in ((rng.randint(0, 59), rng.randint(0, 59)) for _ in range(150)) if a != b}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    blocks = None if size is None else spark.createDataFrame([(n, n // size) for n in range(60)], "node long, block long")
    got = G.spanning_forest(spark.createDataFrame(rows, "a long, b long, w double"), blocks).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == kruskal(rows)


def test_components_of_several_graphs(spark):
    rows = [(1, i, i + 1) for i in range(40)] + [(1, 100, 101), (2, 5, 9), (2, 9, 7), (2, 30, 30)]
    got = {tuple(r) for r in G.components(spark.createDataFrame(rows, "g int, a long, b long"), "g").collect()}
    assert got == {(1, i, 0) for i in range(41)} | {(1, 100, 100), (1, 101, 100)} | {(2, i, 5) for i in (5, 7, 9)}


def plain_clusters(x, weight, weights_of, min_size):
    """Clusters by definition: components at every step, excess of mass by recursion."""
    n = len(x)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    order = [sorted((far[i, j], j) for j in range(n) if j != i)[:min_size] for i in range(n)]
    core = []
    for i in range(n):
        held, c = weight[i], 0.0
        for d, j in order[i]:
            if held >= min_size:
                break
            held, c = held + weight[j], d
        core.append(c)
    edges = {(min(i, j), max(i, j)): max(d, core[i], core[j], D.FLOOR) for i in range(n) for d, j in order[i]}
    tree = kruskal([(a, b, w) for (a, b), w in edges.items()])
    lad = weights_of(tree)
    lam = [1 / D.FLOOR, *[1 / w for w in lad]]
    at = []
    for s in range(len(lad) + 1):
        comp = list(range(n))
        for a, b, w in tree:
            if s and w <= lad[s - 1]:
                ca, cb = comp[a], comp[b]
                comp = [min(ca, cb) if c in (ca, cb) else c for c in comp]
        groups = {}
        for i, c in enumerate(comp):
            groups.setdefault(c, set()).add(i)
        at.append([frozenset(g) for g in groups.values() if sum(weight[i] for i in g) >= min_size])
    entry = {i: min((s for s in range(len(at)) if any(i in g for g in at[s])), default=None) for i in range(n)}

    def build(s, g):
        """(stability, [chosen]) of the cluster that ends at step s as g; and of all below it."""
        low = s
        kids = [c for c in at[low - 1] if c <= g] if low else []
        while len(kids) == 1:
            low, inner = low - 1, kids[0]
            kids = [c for c in at[low - 1] if c <= inner] if low else []
        below = [build(low - 1, k) for k in kids]
        birth = lam[s + 1] if s + 1 < len(lam) else 0.0
        own = sum(weight[i] * (lam[max(entry[i], low)] - birth) for i in g)
        return own, below, g

    def best(t):
        own, below, g = t
        kids = [best(k) for k in below]
        total = sum(k[0] for k in kids)
        return (own, [g]) if own >= total else (total, [c for k in kids for c in k[1]])
    tops = [build(len(lad), g) for g in at[-1]]
    if len(tops) == 1:
        return [c for k in tops[0][1] for c in best(k)[1]]
    return [c for t in tops for c in best(t)[1]]


def test_clusters_equal_the_plain_version(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(m, s, (n, 2)) for m, s, n in ((0, .3, 40), (1.6, .25, 30), (6, .8, 50))] + [rng.uniform(-4, 10, (20, 2))])
    copies = [x[-1].tolist()] * 7
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(copies)]
    df = spark.createDataFrame(rows, X)
    weight = [1] * (len(x) - 1) + [8]
    lad = lambda tree: D.ladder(spark.createDataFrame(sorted((a, b, float(w)) for a, b, w in tree), "a long, b long, w double"), 32)
    want = plain_clusters(x, weight, lad, 8)
    got = {}
    for r in D.cluster(df, 8).collect():
        got.setdefault(r.topic_id, set()).add(r.doc_id)
    out = got.pop(-1, set())
    last = len(x) - 1
    assert {frozenset(i for i in g if i < 1000) for g in got.values()} == set(want)
    assert out and all((1000 + i in out) == (last in out) for i in range(7))
    sizes = [len(got[t]) for t in sorted(got)]
    assert sorted(got) == list(range(len(got))) and sizes == sorted(sizes, reverse=True)


def test_planted_clusters_and_noise(spark):
    rng = np.random.default_rng(3)
    centres = rng.random((4, 5)) * 10
    parts = [c + rng.standard_normal((120, 5)) * s for c, s in zip(centres, (.3, .5, .2, .8), strict=True)]
    noise = rng.random((60, 5)) * 14 - 2
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([*parts, noise]))]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (None, [0.0] * 5)]
    got = {r.doc_id: (r.topic_id, r.strength) for r in D.cluster(spark.createDataFrame(rows + odd, X)).collect()}
    assert set(got) == set(range(540)) | {900, 901, 902}
    named = set()
    for g in range(4):
        topics = [got[i][0] for i in range(g * 120, g * 120 + 120)]
        top = max(set(topics), key=topics.count)
        assert top != -1 and topics.count(top) >= 110
        named.add(top)
    assert len(named) == 4
    assert sum(got[i][0] == -1 for i in range(480, 540)) >= 40
    assert all(got[i] == (-1, 0.0) for i in (900, 901, 902))
    assert all(0 <= s <= 1 for _, s in got.values())


def test_neighbours_are_found_across_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    nodes = D.points(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], X)).select("node", "x", "weight")
    near = {r.node: {y.other for y in r.near} for r in D.nearest(nodes, 15, block=256).collect()}
    hit = 0
    for i in range(0, 3000, 20):
        d = ((x - x[i]) ** 2).sum(1)
        hit += len(near[i] & set(np.argsort(d)[1:16].tolist()))
    assert hit / (150 * 15) >= 0.9


def test_no_rows_and_only_copies(spark):
    assert D.cluster(spark.createDataFrame([], X)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], X)
    assert {r.topic_id for r in D.cluster(same).collect()} == {-1}       # one cluster that holds everything is none
    two = spark.createDataFrame([(i, [float(i % 2), 2.0]) for i in range(60)], X)
    assert sorted(r["count"] for r in D.cluster(two).groupBy("topic_id").count().collect()) == [30, 30]
