"""Density clusters with outliers (M7): hierarchical DBSCAN as joins.

1. ``nearest``: k nearest neighbours.  Points are ordered along shifted Z-order
   curves and cut into overlapping blocks of a fixed number of points; each block is
   compared in one task, so no task grows with the data or with a dense spot.
   Equal vectors are one point with a weight.
2. ``reachability``: core distance = distance within which ``min_samples`` points lie;
   an edge weighs the largest of its length and its ends' core distances.
3. ``graph.spanning_forest`` (Boruvka) of those edges.
4. ``hierarchy``: the forest's components at each of a ladder of weights (quantiles,
   closer together at the heavy end).  A component of ``min_cluster_size`` points or
   more is a cluster; it lives on, upwards, until it meets another one.
5. ``select``: excess of mass.  A cluster is taken if it is at least as stable as the
   best choice below it; the one cluster that holds everything is no cluster.

Everything that is collected is the ladder (about 60 weights) and counts.  Tables of a row a
step and point are joined by merging: their files are a small part of their size, so that
the optimizer would broadcast them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import written
from .graph import components, nested_components, spanning_forest
from .ordering import numbered

BLOCK, CURVES, FLOOR = 512, 4, 1e-9
FOREST_BLOCK = 65_536
_NEAR = "array<struct<d:double,other:bigint,weight:bigint>>"


def points(vectors: DataFrame, key: str = "doc_id", col: str = "reduced") -> DataFrame:
    """``(key, node, x, weight)``: rows with a whole vector; ``node`` is the smallest key of
    the rows with that vector, ``weight`` their number."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.transform(F.col(col), lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
    whole = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = rows.filter(F.col("key").isNotNull() & F.col("x").isNotNull()).filter(whole)
    same = rows.groupBy("x").agg(F.min("key").alias("node"), F.count("*").alias("weight"))
    return written(rows.join(same, "x").select("key", "node", "x", "weight"))


def _curve_positions(low: list[float], high: list[float], curves: int, seed: int):
    """Rows (node, x, weight) -> one row a curve: its number and the point's place on it."""
    def run(batches):
        import numpy as np

        rng = np.random.default_rng(seed)
        dims = len(low)
        used = min(dims, 12)
        turn = [np.linalg.qr(rng.standard_normal((dims, dims)))[0][:, :used] for _ in range(curves)]
        shift = rng.random((curves, used))
        bits = min(60 // used, 20)
        size = max(float(np.linalg.norm(np.subtract(high, low))), FLOOR)
        middle = (np.array(low) + np.array(high)) / 2
        for b in batches:
            x = np.stack(b["x"].to_list()) if len(b) else np.empty((0, dims))
            for c in range(curves):
                u = ((x - middle) @ turn[c] / size + 0.5 + shift[c]) / 2     # within [0, 1)
                cell = np.clip((u * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
                z = np.zeros(len(x), np.int64)
                for bit in range(bits - 1, -1, -1):
                    for d in range(used):
                        z = z << 1 | (cell[:, d] >> bit & 1)
                yield pd.DataFrame({"curve": np.int32(c), "z": z, "node": b["node"], "x": b["x"], "weight": b["weight"]})
    return run


def _compare(k: int):
    """The k nearest points of each point within a block."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        block = block.sort_values(["node", "at"]).drop_duplicates("node")
        node, weight = block["node"].to_numpy(), block["weight"].to_numpy()
        x = np.stack(block["x"].to_list())
        mid = x - x.mean(axis=0)
        sq = (mid * mid).sum(axis=1)
        far = sq[:, None] + sq[None, :] - 2 * (mid @ mid.T)
        np.fill_diagonal(far, np.inf)
        n = len(node)
        m = min(k, n - 1)
        near = np.argpartition(far, m - 1, axis=1)[:, :m] if m else np.empty((n, 0), int)
        exact = np.sqrt(((x[:, None, :] - x[near]) ** 2).sum(axis=2))
        out = [[{"d": d, "other": o, "weight": w} for d, o, w in zip(*r, strict=True)]
               for r in zip(exact.tolist(), node[near].tolist(), weight[near].tolist(), strict=True)]
        return pd.DataFrame({"node": node, "at": block["at"], "near": out})
    return run


def nearest(nodes: DataFrame, k: int, block: int = BLOCK, curves: int = CURVES, seed: int = 42) -> DataFrame:
    """``(node, weight, near, at)``: up to ``k`` nearest other points of each, by distance
    (approximate: points that share a block on no curve are not compared); ``at`` is its
    place on the first curve."""
    flat = nodes.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i").collect()
    if not flat:
        return nodes.select("node", "weight", F.array().cast(_NEAR).alias("near"), F.lit(0).cast("long").alias("at"))
    dealt = nodes.select("node", "x", "weight").mapInPandas(
        _curve_positions([r.lo for r in flat], [r.hi for r in flat], curves, seed), "curve int, z long, node long, x array<double>, weight long")
    rows = numbered(dealt, [F.col("curve"), F.col("z"), F.col("node")], "at")
    half = block // 2
    both = F.explode(F.array(F.floor(F.col("at") / block) * 2, F.floor((F.col("at") + half) / block) * 2 + 1))
    near = rows.select(both.alias("block"), "node", "x", "weight", "at").groupBy("block").applyInPandas(_compare(k), f"node long, at long, near {_NEAR}")
    near = near.groupBy("node").agg(F.min("at").alias("at"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    return nodes.select("node", "weight").join(near, "node")


def reachability(near: DataFrame, min_samples: int) -> DataFrame:
    """``(a, b, w)``: mutual reachability of neighbours; copies count as neighbours at 0."""
    start = F.struct(F.col("weight").alias("held"), F.lit(0.0).alias("core"))
    core = F.aggregate("near", start, lambda acc, x: F.when(acc["held"] >= min_samples, acc).otherwise(
        F.struct((acc["held"] + x["weight"]).alias("held"), x["d"].alias("core"))))["core"]
    near = written(near.select("node", core.alias("core"), "near"))
    e = near.select(F.col("node").alias("a"), F.col("core").alias("core_a"), F.explode("near").alias("x")).select("a", "core_a", F.col("x.other").alias("b"), "x.d")
    e = e.join(near.select(F.col("node").alias("b"), F.col("core").alias("core_b")), "b")
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("d", "core_a", "core_b", F.lit(FLOOR)).alias("w")).distinct()


def ladder(tree: DataFrame, steps: int) -> list[float]:
    """Weights at even ranks of the forest's edges, then at ever closer ranks up to the
    heaviest: the last ones part even single heavy edges."""
    rows = numbered(tree, [F.col("w"), F.col("a"), F.col("b")], "at").select("w", "at")
    n = rows.count()
    if not n:
        return []
    at = {math.ceil(n * j / steps) - 1 for j in range(1, steps + 1)}
    rest = n // steps
    while rest:
        at.add(n - 1 - rest)
        rest //= 2
    wanted = sorted(x for x in at if x >= 0)
    return sorted({r.w for r in rows.filter(F.col("at").isin(wanted)).collect()})


def hierarchy(nodes: DataFrame, tree: DataFrame, weights: list[float], min_cluster_size: int, blocks: DataFrame | None = None):
    """Clusters of the forest at the ladder's steps: step 0 has no edges, step i those up
    to ``weights[i - 1]``.  ``blocks`` as in ``spanning_forest``.  Returns ``(clusters, members)``:

    * clusters ``(cluster, parent, stability, densest)``; ``parent`` is null at the top;
    * members ``(step, node, cluster)``, from a point's first step in a cluster.
    """
    top = len(weights)
    lam = F.array(*[F.lit(1 / FLOOR), *[F.lit(1 / w) for w in weights], F.lit(0.0)])
    ladder_ = F.array(*[F.lit(w) for w in weights])
    step = F.size(F.filter(ladder_, lambda w: w < F.col("w"))) + 1
    if top and blocks is not None:
        comp = nested_components(tree.select("a", "b", step.alias("step")), top, blocks)
    else:
        steps = tree.select(F.explode(F.sequence(step, F.lit(top))).alias("step"), "a", "b") if top else tree.select(F.lit(0).alias("step"), "a", "b").limit(0)
        comp = components(steps, "step")
    # A point of many copies is a cluster by itself until its first edge.
    alone = nodes.filter(F.col("weight") >= min_cluster_size).select(F.explode(F.sequence(F.lit(0), F.lit(top))).alias("step"), "node")
    alone = alone.join(comp.select("step", "node").hint("merge"), ["step", "node"], "left_anti").withColumn("comp", F.col("node"))
    comp = comp.unionByName(alone).hint("merge").join(nodes.select("node", "weight"), "node")
    big = comp.groupBy("step", "comp").agg(F.sum("weight").alias("size")).filter(F.col("size") >= min_cluster_size).select("step", "comp")
    member = written(comp.hint("merge").join(big, ["step", "comp"])).hint("merge")
    entry = member.groupBy("node").agg(F.min("step").alias("entry"))
    member = written(member.join(entry, "node")).hint("merge")
    # A cluster's anchor is its earliest point: it stays the same while the cluster only gains points.
    part = member.groupBy("step", "comp").agg(F.min(F.struct("entry", "node")).alias("f")).select("step", "comp", F.col("f.node").alias("anchor"))
    up = member.select((F.col("step") - 1).alias("step"), F.col("node").alias("anchor"), F.col("comp").alias("above"))
    part = written(part.join(up, ["step", "anchor"], "left"))
    met = part.filter("above IS NOT NULL").groupBy((F.col("step") + 1).alias("step"), F.col("above").alias("comp")).agg((F.count("*") > 1).cast("int").alias("met"))
    part = part.join(met, ["step", "comp"], "left")
    w = Window.partitionBy("anchor").orderBy("step")              # at most one row a step
    name = F.concat_ws(":", "anchor", F.sum(F.coalesce("met", F.lit(0))).over(w).cast("string"))
    part = written(part.select("step", "comp", "above", name.alias("cluster")))
    spans = part.groupBy("cluster").agg(F.min("step").alias("low"), F.max(F.struct("step", "comp", "above")).alias("t"))
    spans = spans.select("cluster", "low", F.col("t.step").alias("high"), F.col("t.comp").alias("comp"), F.col("t.above").alias("above"))
    owner = part.select((F.col("step") - 1).alias("high"), F.col("comp").alias("above"), F.col("cluster").alias("parent"))
    spans = spans.join(owner, ["high", "above"], "left")
    level = lambda i: F.element_at(lam, i + 1)
    gains = (member.select(F.col("step").alias("high"), "comp", "entry", "weight").join(spans, ["high", "comp"])
             .withColumn("l", level(F.greatest("entry", "low"))))
    birth = F.when(F.col("parent").isNull(), F.lit(0.0)).otherwise(level(F.col("high") + 1))
    clusters = gains.groupBy("cluster", "parent").agg(F.sum(F.col("weight") * (F.col("l") - birth)).alias("stability"), F.max("l").alias("densest"))
    members = member.join(part.select("step", "comp", "cluster"), ["step", "comp"]).select("step", "node", "cluster", level(F.col("entry")).alias("l"))
    return written(clusters), members


def select(clusters: DataFrame) -> DataFrame:
    """Names of the clusters to take (``cluster, densest``): bottom up, one round for each
    generation.  A single cluster at the top is the whole and is not taken itself."""
    kids = clusters.groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("kids")).filter("cluster IS NOT NULL")
    rest = clusters.join(kids, "cluster", "left").select("cluster", "parent", "stability", "densest", F.coalesce("kids", F.lit(0)).alias("kids"),
                                                         F.lit(0).cast("long").alias("ready"), F.lit(0.0).alias("below"))
    rest = written(rest)
    single = rest.filter("parent IS NULL").count() == 1
    wins = F.col("stability") >= F.col("below")
    if single:
        wins = wins & F.col("parent").isNotNull()
    taken = clusters.select("cluster", "densest").limit(0)
    while not rest.isEmpty():
        now = rest.filter("ready = kids")
        taken = taken.unionByName(now.filter(wins).select("cluster", "densest"))
        best = now.groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.greatest("stability", "below")).alias("more"), F.count("*").alias("done")).filter("cluster IS NOT NULL")
        # What its ready ones add up to goes on with a cluster, so a round reads the one before it alone.
        rest = rest.filter("ready < kids").join(best, "cluster", "left").select("cluster", "parent", "stability", "densest", "kids", (F.col("ready") + F.coalesce("done", F.lit(0))).alias("ready"),
                                                                                 (F.col("below") + F.coalesce("more", F.lit(0.0))).alias("below"))
        rest = written(rest)
    return taken


def cluster(vectors: DataFrame, min_cluster_size: int = 15, min_samples: int | None = None, steps: int = 32,
            key: str = "doc_id", col: str = "reduced") -> DataFrame:
    """M7: ``(key, topic_id, strength)`` for every row.

    Topics are numbered from 0 by size (ties: smallest key); -1 is an outlier, or a row
    without a whole vector.  ``strength`` (0 to 1) is the density at which a row joins its
    topic against the topic's densest one; 0 for outliers.  Rows with a null key are left out.
    """
    min_samples = min_samples or min_cluster_size
    rows = points(vectors, key, col)
    nodes = written(rows.groupBy("node").agg(F.first("x").alias("x"), F.first("weight").alias("weight")))
    near = written(nearest(nodes, min_samples))
    blocks = near.select("node", F.floor(F.col("at") / FOREST_BLOCK).alias("block"))
    tree = written(spanning_forest(reachability(near, min_samples), blocks))
    clusters, members = hierarchy(nodes, tree, ladder(tree, steps), min_cluster_size, blocks)
    taken = select(clusters)
    own = members.join(taken, "cluster").groupBy("node").agg(F.max(F.struct("step", "cluster", "densest", "l")).alias("m"))
    own = written(own.select("node", "m.cluster", F.least(F.col("m.l") / F.col("m.densest"), F.lit(1.0)).alias("strength")).join(nodes.select("node", "weight"), "node"))
    sizes = own.groupBy("cluster").agg(F.sum("weight").alias("n"), F.min("node").alias("low"))
    ids = numbered(sizes, [F.col("n").desc(), F.col("low")], "topic").select("cluster", F.col("topic").cast("int").alias("topic"))
    named = rows.select("key", "node").join(own.join(ids, "cluster"), "node").select(F.col("key").alias("_key"), "topic", "strength").distinct()
    out = vectors.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct().join(named, F.col(key) == F.col("_key"), "left")
    return out.select(key, F.coalesce("topic", F.lit(-1)).alias("topic_id"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
