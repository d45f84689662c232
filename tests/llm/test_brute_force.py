"""Operators on the small driver tables against brute force."""

import collections

from postlens.llm import queries, suffix, topk, toxicity
from postlens.llm.common import documents, table

SF_SMALL = "/root/testdata/sf0.001"


def test_components_equal_all_pairs(spark):
    rows = documents(spark, SF_SMALL).select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, s in sets.items():
        for j, t in sets.items():
            if j < i and s & t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op10_setsketch(spark, SF_SMALL).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_every_long_repeat_is_found(spark):
    docs = documents(spark, SF_SMALL)
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    seen = collections.defaultdict(list)
    for i, w in words.items():
        for p in range(len(w) - 49):
            seen[tuple(w[p:p + 50])].append((i, p))
    need = collections.defaultdict(set)
    for places in seen.values():
        first = min(places)
        for i, p in places:
            if (i, p) != first and (i != first[0] or p >= first[1] + 50):
                need[i].update(range(p, p + 50))
    got = collections.defaultdict(set)
    for r in suffix.passages(docs).filter("removed").collect():
        got[r.doc_id].update(range(r.start, r.stop))
        assert r.stop - r.start >= 42 and r.stop <= len(words[r.doc_id])
    assert need and all(need[i] <= got[i] for i in need)


def test_long_repeats_over_the_edges_of_others(spark):
    import random

    rnd, rows = random.Random(7), []
    for k in range(40):
        def new(n):
            return [f"v{rnd.randrange(10**9)}" for _ in range(n)]
        p, x, y = new(50), new(1 + k % 8), new(k % 5)
        a, b = [*new(9), *p, *new(9)], [*x, *p, *y]
        for i, w in enumerate((a, [*new(20), *b, *new(7)], [*new(3), *b, *new(30)])):
            rows.append((3 * k + i, " ".join(w)))
    words = {i: t.split() for i, t in rows}
    seen, need, got = {}, collections.defaultdict(set), collections.defaultdict(set)
    for i, w in sorted(words.items()):
        for p in range(len(w) - 49):
            if seen.setdefault(tuple(w[p:p + 50]), (i, p)) != (i, p):
                need[i].update(range(p, p + 50))
    for r in suffix.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert words[r.doc_id][r.start:r.stop] == words[r.first_doc][r.first_start:r.first_stop]
        assert (r.first_doc, r.first_start) < (r.doc_id, r.start)
        got[r.doc_id].update(range(r.start, r.stop))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in need.items()}


def test_top_k_equals_sorting(spark):
    rows = table(spark, SF_SMALL, "embeddings")
    import numpy as np

    got = rows.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in got]), np.floor(256 * np.array([r.embedding for r in got], float))
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        best = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        want += [(ids[q], k, ids[i], int(s[i])) for k, i in enumerate(best, 1)]
    small = topk.top_k(rows, rows.vec_id % 50 == 0, shard_rows=64, group_rows=4)
    assert [tuple(r) for r in small.orderBy("query_id", "rank").collect()] == want


def test_mixing_reaches_its_targets(spark):
    from postlens.llm import mixing

    by = collections.defaultdict(lambda: [0.0, 0, 0])
    for r in mixing.mixture(documents(spark, SF_SMALL), block=16).collect():
        by[r.source][0], by[r.source][1] = r.target, r.source_size
        by[r.source][2] += r.taken
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * sum(s for _, s, _ in by.values())) < 1e-3
    assert all(t <= 2 * s + 1e-6 and abs(n - t) <= 0.02 * t + 32 for t, s, n in by.values())


def test_toxicity_is_learnt(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.scores(documents(spark, sf), table(spark, sf, "labels")).collect()}
    marks = [(got[r.doc_id].score, r.toxic) for r in table(spark, sf, "labels").collect() if got[r.doc_id].held_out]
    right = sum((s >= 0.5) == (t == 1) for s, t in marks) / len(marks)
    assert right >= 0.95
