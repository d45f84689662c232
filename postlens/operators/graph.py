"""Graphs as edge tables: minimum spanning forest and connected components.

Both work in rounds of joins and groupings that shrink the graph; each round is
written as a table, and the driver sees a count a round.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import written


def _roots(picked: DataFrame) -> DataFrame:
    """(c, p): the root of each chain of picks.  Two that pick each other are the only
    cycle; the smaller one is the root.  One doubling step a round."""
    ptr = picked
    while True:
        to = ptr.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        new = F.when(F.col("pp") == F.col("c"), F.least("c", "p")).otherwise(F.col("pp"))
        ptr = written(ptr.join(to, "p").select("c", new.alias("p"), (new != F.col("p")).alias("moved")))
        if ptr.filter("moved").isEmpty():
            return ptr.select("c", "p")
        ptr = ptr.select("c", "p")


def _contract(e: DataFrame, to: DataFrame) -> DataFrame:
    """The lightest edge between each two of the components ``to`` (c, p) that ``e`` joins."""
    a, b = to.select(F.col("c").alias("ca"), F.col("p").alias("pa")), to.select(F.col("c").alias("cb"), F.col("p").alias("pb"))
    return (e.join(a, "ca").join(b, "cb").filter("pa <> pb")
            .groupBy(F.least("pa", "pb").alias("ca"), F.greatest("pa", "pb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("m")).select("ca", "cb", "m.*"))


def _both_ends(e: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("o")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("o"))))
    return e.select(ends.alias("x"), "w", "a", "b").select("x.c", "x.o", "w", "a", "b")


def _local_forest(block: pd.DataFrame) -> pd.DataFrame:
    """Boruvka's rounds within a block.  A row without ``b`` is the lightest edge of node
    ``a`` that leaves the block; a component whose lightest edge leaves it picks none."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([block["a"], block["b"].dropna().astype("int64")]), return_inverse=True)
    block = block.assign(u=at[:len(block)])
    block["v"] = -1
    block.loc[block["b"].notna(), "v"] = at[len(block):]
    block = block.sort_values(["w", "lo", "hi"], kind="stable")
    u, v = block["u"].to_numpy(), block["v"].to_numpy()
    row = np.arange(len(block))
    comp, taken = np.arange(len(nodes)), []
    while True:
        cu, cv = comp[u], np.where(v >= 0, comp[v], -1)
        live = cu != cv
        u, v, row, cu, cv = u[live], v[live], row[live], cu[live], cv[live]
        back = cv >= 0
        who = np.concatenate([cu, cv[back]])
        first = np.full(len(nodes), len(row))                     # each component's lightest row
        np.minimum.at(first, who, np.concatenate([np.arange(len(row)), np.flatnonzero(back)]))
        c = np.flatnonzero(first < len(row))
        c = c[cv[first[c]] >= 0]
        if not len(c):
            break
        e = first[c]
        taken.append(np.unique(row[e]))
        ptr = np.arange(len(nodes))
        ptr[c] = cu[e] + cv[e] - c
        twin = ptr[ptr] == np.arange(len(nodes))
        ptr = np.where(twin, np.minimum(ptr, np.arange(len(nodes))), ptr)
        while (ptr[ptr] != ptr).any():
            ptr = ptr[ptr]
        comp = ptr[comp]
    picked = block.iloc[np.concatenate(taken)] if taken else block.iloc[:0]
    tree = pd.DataFrame({"tree": True, "a": picked["lo"], "b": picked["hi"], "w": picked["w"]})
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, comp, nodes)
    return pd.concat([tree, pd.DataFrame({"tree": False, "a": nodes, "b": low[comp], "w": 0.0})])


def spanning_forest(edges: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Boruvka's minimum spanning forest of ``(a, b, w)``: its edges, each once.

    A round picks the lightest edge that leaves each component (ties by the
    endpoints, so the choice has no cycles), joins the picked components by pointer
    jumping, and keeps the lightest edge of each pair of components: at most log2(n)
    rounds.  Picking is a partial aggregation, so a component with a third of all
    edges is pre-aggregated in every task.

    ``blocks`` ``(node, block)``, of a bounded number of nearby nodes each, shortens this:
    first every block runs its own rounds in one task, with the edges inside it and each
    node's lightest edge that leaves it.  The result is the same.
    """
    e = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    e = written(e.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"))
    found = e.select("a", "b", "w").limit(0)
    if blocks is not None:
        at = lambda n: blocks.select(F.col("node").alias(f"c{n}"), F.col("block").alias(f"block_{n}"))
        dealt = written(e.join(at("a"), "ca").join(at("b"), "cb"))
        inside = dealt.filter("block_a = block_b").select(F.col("block_a").alias("block"), "a", "b", "w", F.col("a").alias("lo"), F.col("b").alias("hi"))
        ends = F.explode(F.array(F.struct(F.col("block_a").alias("block"), F.col("a").alias("own")), F.struct(F.col("block_b").alias("block"), F.col("b").alias("own"))))
        leaving = (dealt.filter("block_a <> block_b").select(ends.alias("x"), "w", "a", "b").groupBy("x.block", "x.own").agg(F.min(F.struct("w", "a", "b")).alias("m"))
                   .select("block", F.col("own").alias("a"), F.lit(None).cast("long").alias("b"), "m.w", F.col("m.a").alias("lo"), F.col("m.b").alias("hi")))
        local = written(inside.unionByName(leaving).groupBy("block").applyInPandas(_local_forest, "tree boolean, a long, b long, w double"))
        found = local.filter("tree").select("a", "b", "w")
        e = written(_contract(e, local.filter("NOT tree").select(F.col("a").alias("c"), F.col("b").alias("p"))))
    while not e.isEmpty():
        pick = written(_both_ends(e).groupBy("c").agg(F.min(F.struct("w", "a", "b", "o")).alias("m")).select("c", "m.*"))
        found = found.unionByName(pick.select("a", "b", "w").distinct())
        e = written(_contract(e, _roots(pick.select("c", F.col("o").alias("p")))))
    return found


def components(edges: DataFrame, scope: str) -> DataFrame:
    """``(scope, node, comp)``: connected components of ``(scope, a, b)`` for all values
    of ``scope`` at once; ``comp`` is the smallest node.  Large-star and small-star
    rounds (Kiveris et al. 2014): each node hands its larger neighbours, then all its
    smaller ones, to its smallest one."""
    # Merged, not broadcast: with many values of ``scope`` the files are a small part of the table's size.
    e = written(edges.filter("a <> b").select(scope, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()).hint("merge")
    state = None
    while True:
        both = e.select(scope, F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("s")).select(scope, "s.*")
        low = both.groupBy(scope, "x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(low, [scope, "x"]).select(scope, F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(scope, "u").agg(F.min("v").alias("m"))
        moved = large.join(low, [scope, "u"]).filter("v <> m").select(scope, F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(moved.unionByName(low.withColumnRenamed("m", "v")).distinct()).hint("merge")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64(scope, "u", "v"))).first())
        if now == state:
            leaves = e.select(scope, F.col("u").alias("node"), F.col("v").alias("comp"))
            return leaves.unionByName(e.select(scope, F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        state = now


def _local_components(top: int):
    """Components of a block's edges ``(a, b, step)`` as they grow from step to step: a row
    for each node and range of steps ``low`` to ``high`` in which its component keeps its
    smallest node ``comp``; from the node's first edge on."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        nodes, at = np.unique(np.concatenate([block["a"], block["b"]]), return_inverse=True)
        u, v, step = at[:len(block)], at[len(block):], block["step"].to_numpy()
        up = np.arange(len(nodes))
        label, since, out = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64), []
        seen = np.zeros(len(nodes), bool)
        for s in np.unique(step):
            now = step == s
            x, y = u[now], v[now]
            seen[x] = seen[y] = True
            while True:                                   # hook the larger root to the smaller one, then flatten
                x, y = up[x], up[y]
                apart = x != y
                if not apart.any():
                    break
                x, y = x[apart], y[apart]
                np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
                while (up[up] != up).any():
                    up = up[up]
            moved = np.flatnonzero(seen & (label != up))
            old = moved[label[moved] >= 0]
            out.append((since[old], np.full(len(old), s - 1), nodes[old], nodes[label[old]]))
            label[moved], since[moved] = up[moved], s
        out.append((since, np.full(len(nodes), top), nodes, nodes[label]))
        return pd.DataFrame(dict(zip(["low", "high", "node", "comp"], (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))
    return run


def nested_components(edges: DataFrame, top: int, blocks: DataFrame) -> DataFrame:
    """``components`` of ``(a, b, step)`` for all steps up to ``top`` at once, where an edge
    of a step is one of all later steps too: ``(step, node, comp)``.

    ``blocks`` as in ``spanning_forest``: each block follows its own edges in one task, and
    only the edges between blocks go round by ``components``, a row a step.
    """
    at = lambda n: blocks.select(F.col("node").alias(n), F.col("block").alias(f"block_{n}"))
    dealt = written(edges.filter("a <> b").join(at("a"), "a").join(at("b"), "b"))
    local = dealt.filter("block_a = block_b").select(F.col("block_a").alias("block"), "a", "b", "step").groupBy("block").applyInPandas(
        _local_components(top), "low int, high int, node long, comp long")
    local = written(local)
    every = local.select(F.explode(F.sequence("low", "high")).alias("step"), "node", "comp").hint("merge")     # a row a step and node
    across = dealt.filter("block_a <> block_b").select(F.explode(F.sequence("step", F.lit(top))).alias("step"), "a", "b")
    if across.isEmpty():
        return every
    ends = across.select("step", F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = written(ends.join(every, ["step", "node"], "left").select("step", "node", "comp"))
    mine = lambda n: ends.select("step", F.col("node").alias(n), F.coalesce("comp", "node").alias(f"c{n}"))
    joined = across.join(mine("a"), ["step", "a"]).join(mine("b"), ["step", "b"]).select("step", F.col("ca").alias("a"), F.col("cb").alias("b"))
    whole = components(joined, "step").select("step", F.col("node").alias("comp"), F.col("comp").alias("whole"))
    alone = ends.filter("comp IS NULL").select("step", "node", F.col("node").alias("comp"))
    return every.unionByName(alone).hint("merge").join(whole, ["step", "comp"], "left").select("step", "node", F.coalesce("whole", "comp").alias("comp"))
