"""Connected components by alternating large and small stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): the smallest node it reaches.

    Each round links neighbours to the smallest node of their star, so depth
    falls geometrically; a node's edges are only joined with one row of it,
    and minima are combined before the shuffle.  Joins are merge joins: a round
    is many small ones, and broadcasts would pile up on the driver."""
    e = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        # Done when no node has two parents, or a parent and children.
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(0).alias("up")), F.struct(F.col("b").alias("n"), F.lit(1).alias("up")))).alias("x"))
        if ends.groupBy("x.n").agg(F.sum("x.up").alias("up"), F.min("x.up").alias("top")).filter("up > 1 OR (up = 1 AND top = 0)").isEmpty():
            return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(e.select("a", "a").distinct())
        both = _either(e, ("a", "b"), ("b", "a"))  # (a: node, b: neighbour)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low.hint("merge"), F.col("a") == F.col("n")).filter("b > a").select(F.col("m").alias("a"), "b")
        least = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m")
        small = large.join(least.hint("merge"), F.col("b") == F.col("n"))
        e = cut_lineage(_either(small, ("m", "b"), ("m", "a")).filter("a <> b").distinct())


def _either(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Each row once for each of ``pairs`` of its columns, as (a, b); a union would make ``rows`` again."""
    each = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs]))
    return rows.select(each.alias("x")).select("x.a", "x.b")
