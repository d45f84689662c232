"""The cluster hierarchy sends no table of a row a step and point to the driver, and its plans stay small."""
import random

from pyspark.sql import functions as F

from postlens.operators import density as DN
from postlens.operators import embed_topics as E
from postlens.operators import graph as G


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_steps_and_points_are_not_broadcast(spark):
    rows = [(i, [float(i % 3 * 10 + i % 7), float(i % 5)]) for i in range(90)]
    pts = DN.points(spark.createDataFrame(rows, "doc_id long, reduced array<double>"))
    nodes = pts.select("node", "x", "weight").distinct()
    near = DN.nearest(nodes, 4)
    tree = G.spanning_forest(DN.reachability(near, 4))
    steps = DN.ladder(tree, 8)
    blocks = nodes.select("node", F.lit(0).alias("block"))
    _, members = DN.hierarchy(nodes, tree, steps, 4, blocks)
    assert "BroadcastHashJoin" not in plan(members)
    every = G.nested_components(tree.select("a", "b", F.lit(1).alias("step")), 2, nodes.select("node", (F.col("node") % 2).alias("block")))
    assert "SortMergeJoin" in plan(every)


def test_a_selection_reads_each_generation_once(spark):
    rnd, rows = random.Random(1), []
    for i in range(200):                                  # a tree of 40 generations and some leaves
        rows.append((f"c{i}", None if i == 0 else f"c{max(0, i - rnd.randrange(1, 9))}", rnd.random() * (i + 1), 1.0))
    got = {r.cluster for r in DN.select(spark.createDataFrame(rows, "cluster string, parent string, stability double, densest double")).collect()}
    kids: dict = {}
    for c, p, _, _ in rows:
        kids.setdefault(p, []).append(c)
    best, want = {}, set()
    for c, p, s, _ in reversed(rows):
        below = sum(best[k] for k in kids.get(c, []))
        best[c] = max(s, below)
        if s >= below and p is not None:
            want.add(c)
    assert got == want


def test_centres_are_one_literal(spark):
    centers = [[float(i), i / 3] for i in range(50)]
    df = E.soft_membership(spark.createDataFrame([(1, [0.1, 0.2])], "doc_id long, reduced array<double>"), centers)
    assert len(df._jdf.queryExecution().logical().toString()) < 20_000
    want = [1 / (1e-9 + ((c[0] - 0.1) ** 2 + (c[1] - 0.2) ** 2) ** 0.5) for c in centers]
    assert max(abs(a - b / sum(want)) for a, b in zip(df.first().probs, want, strict=True)) < 1e-12
