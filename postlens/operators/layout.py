"""Neighbour maps (M6, M14): vectors to a few coordinates that keep neighbours together.

1. ``density.nearest`` joins each point with its ``k`` nearest ones (equal vectors
   are one point), no all-pairs comparison.
2. An edge weighs ``exp(-d^2 / (s_a s_b))``, ``s`` being the distance of a point's
   farthest listed neighbour, so dense and thin regions count alike.
3. The PCA coordinates are smoothed along the edges ``steps`` times: each step is one
   join with the edges and one aggregate, then the coordinates are made orthonormal
   again, and orthogonal to the graph's constant vector, by the Cholesky factor of
   their (dims + 1)^2 inner products - all that ever reaches the driver.  This is
   subspace iteration towards the leading eigenvectors of the graph's normalised
   adjacency (a Laplacian eigenmap), begun at a layout that is already right at large.

Rows without a whole vector get a null layout, rows with a null key none.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .density import FLOOR, nearest, points


def edges(near: DataFrame) -> DataFrame:
    """``(a, b, s, root)``: normalised weights of neighbour pairs, both ways round; ``root`` is
    the square root of the weights of ``a``."""
    scale = near.select("node", F.greatest(F.element_at("near", -1)["d"], F.lit(FLOOR)).alias("s"), "near").filter(F.size("near") > 0)
    one = scale.select(F.col("node").alias("a"), F.col("s").alias("s_a"), F.explode("near").alias("n")).select("a", "s_a", F.col("n.other").alias("b"), "n.d")
    one = one.join(scale.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")
    one = one.select("a", "b", F.exp(-F.col("d") * F.col("d") / (F.col("s_a") * F.col("s_b"))).alias("w"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = written(both.groupBy("a", "b").agg(F.max("w").alias("w")))
    root = written(both.groupBy("a").agg(F.sqrt(F.sum("w")).alias("root")))
    out = both.join(root, "a").join(root.select(F.col("a").alias("b"), F.col("root").alias("root_b")), "b")
    return written(out.select("a", "b", (F.col("w") / (F.col("root") * F.col("root_b"))).alias("s"), "root"))


def _orthonormal(z: DataFrame, dims: int) -> DataFrame:
    """``z`` (node, root, y) with ``y`` orthonormal, and orthogonal to ``root``, over all nodes."""
    import numpy as np

    cols = [F.col("root"), *[F.col("y")[i] for i in range(dims)]]
    pairs = [(i, j) for i in range(dims + 1) for j in range(i, dims + 1)]
    sums = z.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((dims + 1, dims + 1))
    for i, j in pairs:
        g[i, j] = g[j, i] = sums[f"g{i}_{j}"] or 0.0
    if g[0, 0] <= 0:
        return z
    along = g[0, 1:] / g[0, 0]
    rest = g[1:, 1:] - g[0, 0] * np.outer(along, along)
    # Coordinates that say nothing (fewer directions than dims) shrink to 0 instead of noise.
    rest += np.eye(dims) * max(float(np.trace(rest)) * 1e-10, 1e-300)
    mix = np.linalg.inv(np.linalg.cholesky(rest))
    free = [F.col("y")[i] - F.lit(float(along[i])) * F.col("root") for i in range(dims)]
    new = [sum((F.lit(float(mix[r, c])) * free[c] for c in range(1, r + 1)), F.lit(float(mix[r, 0])) * free[0]) for r in range(dims)]
    return z.withColumn("y", F.array(*new))


def neighbours(vectors: DataFrame, key: str = "doc_id", col: str = "embedding", k: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' points, the distinct ones, and the ``k`` nearest of each: what a map of the
    vectors and its measure both need."""
    rows = points(vectors, key, col)
    nodes = written(rows.groupBy("node").agg(F.first("x").alias("x"), F.first("weight").alias("weight")))
    return rows, nodes, written(nearest(nodes, k))


def neighbour_layout(vectors: DataFrame, key: str = "doc_id", col: str = "embedding", dims: int = 2, k: int = 15, steps: int = 12, found=None) -> DataFrame:
    """``(key, layout ARRAY<DOUBLE>)``, one row a distinct key and vector;
    ``found`` as of ``neighbours``."""
    rows, nodes, near = found or neighbours(vectors, key, col, k)
    count, size = nodes.agg(F.count("*"), F.min(F.size("x"))).first()
    keys = vectors.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct()
    if count < 2:                                 # no directions to tell apart
        placed = rows.select(F.col("key").alias("_key"), F.array_repeat(F.lit(0.0), dims).alias("layout")).distinct()
        return keys.join(placed, F.col(key) == F.col("_key"), "left").select(key, "layout")
    used = min(dims, size)
    e = edges(near)
    roots = e.select(F.col("a").alias("node"), "root").distinct()
    fitted = PCA(k=used, inputCol="v", outputCol="r").fit(nodes.select(array_to_vector("x").alias("v")))
    start = fitted.transform(nodes.select("node", array_to_vector("x").alias("v"))).select("node", vector_to_array("r").alias("y"))
    pad = F.concat("y", F.array_repeat(F.lit(0.0), dims - used)) if used < dims else F.col("y")
    z = start.join(roots, "node", "left").select("node", F.coalesce("root", F.lit(0.0)).alias("root"), pad.alias("y"))
    # Eigenvectors of the symmetric form are the coordinates times the root.
    z = z.withColumn("y", F.transform("y", lambda v: v * F.col("root")))
    z = _orthonormal(written(z), dims)
    for _ in range(steps):
        moved = e.select("a", "b", "s").join(z.select(F.col("node").alias("b"), "y"), "b")
        moved = moved.groupBy("a").agg(F.array(*[F.sum(F.col("s") * F.col("y")[i]) for i in range(dims)]).alias("m"))
        half = F.zip_with("y", F.coalesce("m", F.col("y")), lambda a, b: (a + b) / 2)
        z = written(z.join(moved, F.col("node") == F.col("a"), "left").select("node", "root", half.alias("y")))
        z = _orthonormal(z, dims)
    total = z.agg(F.sqrt(F.sum(F.col("root") * F.col("root")))).first()[0] or 0.0
    placed = z.select("node", F.transform("y", lambda v: F.when(F.col("root") > 0, v / F.col("root") * F.lit(total)).otherwise(F.lit(0.0))).alias("layout"))
    named = rows.select(F.col("key").alias("_key"), "node").distinct().join(placed, "node")
    return keys.join(named, F.col(key) == F.col("_key"), "left").select(key, "layout")


def preservation(vectors: DataFrame, maps: dict[str, DataFrame], key: str = "doc_id", col: str = "embedding", k: int = 15, layout: str = "layout",
                 found=None) -> DataFrame:
    """``(map, points, share)``: of each point's ``k`` nearest in the vectors, the share that is
    among its ``k`` nearest in each map (equal vectors are one point); ``found`` as of
    ``neighbours``."""
    def others(near):
        return near.select("node", F.transform("near", lambda n: n["other"]).alias("others"))
    true = others((found or neighbours(vectors, key, col, k))[2])
    out = None
    for name, df in maps.items():
        own = others(neighbours(df.join(true.select(F.col("node").alias(key)), key, "left_semi"), key, layout, k)[2]).withColumnRenamed("others", "mapped")
        share = F.size(F.array_intersect("others", "mapped")) / F.size("others")
        one = true.filter(F.size("others") > 0).join(own, "node", "left").agg(F.count("*").alias("points"), F.avg(F.coalesce(share, F.lit(0.0))).alias("share"))
        one = one.select(F.lit(name).alias("map"), "points", "share")
        out = one if out is None else out.unionByName(one)
    return out
