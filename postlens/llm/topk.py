"""Exact top-k search by no-random-access aggregation (operator 2).

A score is the inner product of integer vectors, so it aggregates one list per
dimension: all candidates ordered by that component, read from the top where
the query's component is positive and from the bottom where it is negative.
Lists are read in growing steps, never by candidate.  After a step each
candidate has a lower bound (unread entries at their list's far end) and an
upper bound (unread entries at the last value read).  A candidate whose upper
bound is under the k-th largest lower bound cannot qualify; reading stops when
few candidates remain, and their final scores are resolved.

The query set is a stated one.  Candidates are dealt by id into shards of about
``shard_rows`` and queries into groups of ``group_rows``; every (group, shard)
pair is one bounded task, whose k best per query meet in a second, small step.

Vectors that are null or hold null or non-finite components take no part.  A
component beyond a vector's length counts as 0.  Rows that repeat (id, vector)
count once; candidates with the query's own id are left out.  Ties go to the
smaller id.  Scores beyond the range of a long are cut to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_RESULT = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x): components as floor(scale * component), kept as doubles."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return (rows.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & whole)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", lambda x: F.rint(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))).alias("x")))


def _matrix(table):
    import numpy as np

    lists = table.column("x").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return table.column("vec_id").to_numpy(), out


def nra(ids, x, query_ids, q, k: int, enough: int = 64):
    """k best candidates of each query: (row of q, row of x, score) arrays."""
    import numpy as np

    n, dims = x.shape
    found = []
    if not n or not len(q):
        return found
    order = np.argsort(-x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(x, order, axis=0)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    left = np.arange(len(q))
    depths = [d for d in (n // 8, n // 4, n // 2) if d >= 1] + [n]
    for depth in depths:
        top, bottom = rank < depth, rank >= n - depth
        # Bounds of the unread entries of each list, by direction of reading.
        last_top, last_bottom = lists[depth - 1], lists[n - depth]
        upper = up[left] @ np.where(top, x, last_top).T + down[left] @ np.where(bottom, x, last_bottom).T
        lower = up[left] @ np.where(top, x, lists[-1]).T + down[left] @ np.where(bottom, x, lists[0]).T
        own = query_ids[left][:, None] == ids[None, :]
        lower[own] = upper[own] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(left), -np.inf)
        can = (upper >= bar[:, None]) & ~own
        count = can.sum(axis=1)
        done = (count <= max(enough, k)) if depth < n else np.ones(len(left), bool)
        for i in np.flatnonzero(done):
            rows = np.flatnonzero(can[i])
            score = x[rows] @ q[left[i]]  # the rest of the survivors' entries
            best = np.lexsort((ids[rows], -score))[:k]
            found.append((left[i], rows[best], score[best]))
        left = left[~done]
        if not len(left):
            break
    return found


def _search(k: int, block: int = 256):
    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        ids, x = _matrix(left)
        query_ids, q = _matrix(right)
        dims = max(x.shape[1], q.shape[1])
        x = np.pad(x, ((0, 0), (0, dims - x.shape[1])))
        q = np.pad(q, ((0, 0), (0, dims - q.shape[1])))
        out = [[], [], []]
        if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(dims, 1) < 2.0 ** 53:
            for at in range(0, len(q), block):
                for i, rows, score in nra(ids, x, query_ids[at:at + block], q[at:at + block], k):
                    out[0] += [query_ids[at + i]] * len(rows)
                    out[1] += ids[rows].tolist()
                    out[2] += score.astype(np.int64).tolist()
        else:  # beyond exact doubles: whole numbers of any size, every list read to its end
            exact = [[int(v) for v in r] for r in x.tolist()]
            for i, r in zip(query_ids.tolist(), q.tolist(), strict=True):
                own = [int(v) for v in r]
                pairs = [(-sum(a * b for a, b in zip(own, c, strict=True)), j) for j, c in zip(ids.tolist(), exact, strict=True) if j != i]
                for score, j in sorted(pairs)[:k]:
                    out[0].append(i)
                    out[1].append(j)
                    out[2].append(min(max(-score, -(1 << 63)), (1 << 63) - 1))
        return pa.table([pa.array(o, pa.int64()) for o in out], ["query_id", "vec_id", "score"])
    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = 4096, group_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each query row."""
    vectors = integer_vectors(rows, scale).distinct()
    queries = vectors.filter(is_query)
    n, nq = vectors.count(), queries.count()
    shards, groups = max(1, -(-n // shard_rows)), max(1, -(-nq // group_rows))
    left = (vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
            .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    right = (queries.withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    best = left.groupBy("grp", "shard").cogroup(right.groupBy("grp", "shard")).applyInArrow(_search(k), _RESULT)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
