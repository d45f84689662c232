"""Operators 11 to 13: odd rows, empty tables, brute force, small groups and shards."""
import hashlib
import math
import random
import re
from itertools import permutations

import pytest

from postlens.llm import audit, decontaminate, fmindex, queries, ranked
from postlens.plans.oracle_check import compare
from sample_paths import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, score double, rank int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.fixture(scope="session")
def items(spark):
    """Null, empty, repeated, short and long items, two texts of one id, ids shared by phrases."""
    run = " ".join(f"word{i}" for i in range(40, 60))
    texts = [(1, run), (1, run), (2, "Beta, GAMMA: delta"), (3, None), (4, ""), (None, "alpha beta"), (5, "été x"), (6, run + " tail one two"),
             (7, "one"), (7, "two words"), (10, " ".join(f"long{i % 97}" for i in range(3000)))]
    return spark.createDataFrame([(i, t, 9, 0.5, 3) for i, t in texts], ITEMS)


def grouped(items):
    out = {}
    for i, t in sorted({(r.item_id, r.text or "") for r in items.collect() if r.item_id is not None}):
        out.setdefault(i, []).append(words(t))
    return out


def brute_search(docs, items, k=10):
    held = [(r.doc_id, words(r.text)) for r in docs.collect()]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    out = []
    for i, texts in grouped(items).items():
        rows = []
        for d, w in held:
            score = 0
            for t in (t for x in texts for t in x):
                tf, df = w.count(t), sum(t in x for _, x in held)
                if tf:
                    m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score:
                rows.append((-score, d is None, d or 0))
        out += [(i, n + 1, None if null else d, -s) for n, (s, null, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("most_chars", [4_000_000, 60])
def test_search_equals_brute_force(edges, items, most_chars):
    few = items.filter("item_id < 10 OR item_id IS NULL")
    got = ranked.search(edges, few, 3, most_chars)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(edges, few, 3)


def brute_leaks(docs, items, size=10):
    phrases = {}
    for i, texts in grouped(items).items():
        for w in texts:
            for a in range(max(len(w) - size + 1, min(len(w), 1))):
                phrases.setdefault(tuple(w[a:a + size]), set()).add(i)
    out = []
    for r in docs.collect():
        w, hit, found = words(r.text), set(), set()
        for n in {len(p) for p in phrases}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in phrases:
                    hit |= set(range(a, a + n))
                    found |= phrases[tuple(w[a:a + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((r.doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_chars,shard", [(4_000_000, 1_000_000), (60, 64)])
def test_leaks_equal_brute_force(edges, items, most_chars, shard):
    found = decontaminate.leaks(edges, items, 10, shard, most_chars).collect()
    want = brute_leaks(edges, items)
    got = sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), len(r.items),
                   hashlib.sha256(",".join(sorted(map(str, r.items))).encode()).hexdigest(), bool(r.spans)) for r in found), key=str)
    assert got == want
    assert sorted((tuple(r) for r in decontaminate.contamination(edges, items).collect()), key=str) == want


def test_leaks_are_cut_and_clean_rows_stay(spark, edges, items):
    docs = spark.createDataFrame([(1, "Keep this. beta gamma delta; and this", "x"), (2, "BETA gamma delta", None), (3, None, None), (4, "", None), (5, "clean  text.", None)],
                                 "doc_id long, text string, _text string")
    got = {r.doc_id: (r.text, r._text) for r in decontaminate.without_leaks(docs, items).collect()}
    assert got == {1: ("Keep this. ; and this", "x"), 3: (None, None), 4: ("", None), 5: ("clean  text.", None)}
    assert decontaminate.without_leaks(edges, items).columns == edges.columns


def test_suffix_order_and_locate():
    import numpy as np

    rng = random.Random(3)
    for n, top in ((1, 1), (50, 1), (300, 2), (300, 50)):
        s = np.array([rng.randint(1, top) for _ in range(n)] + [0])
        assert fmindex.suffix_order(s).tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        index = fmindex.FMIndex(s, 4)
        low, high = index.search(np.array([[1, 1], [0, 1], [1, top + 1]]), np.array([2, 1, 2]))
        pairs = [i for i in range(n) if s[i] == 1 and s[i + 1] == 1]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == pairs and high[2] <= low[2]


def brute_audit(docs, labels):
    def fails(d, t, rows):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        return {c for c, bad in zip("ABCDE", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                                              bool(re.search("[#$%&*|]", t)), d is not None and any(x is not None and x < d and y == t for x, y in rows)], strict=True) if bad}
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    held = [(p, fails(d, t, [(x, y) for x, y, _ in rows]), d) for d, t, p in rows]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1 and r.doc_id is not None}
    out, total = [], {}
    for part in {p for p, _, _ in held}:
        mine = [(f, d) for p, f, d in held if p == part]
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                alive = [(f, d) for f, d in mine if not f & set(order[:k])]
                gone = [(f, d) for f, d in alive if c in f]
                total[part, c] = total.get((part, c), 0) + len(gone)
                out.append((part, "".join(order), k + 1, len(alive) - len(gone), len(gone), sum(c in f for f, _ in mine) - len(gone), sum(f == {c} for f, _ in mine),
                            sum(d in good for _, d in gone), sum(d in toxic for _, d in gone)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_brute_force(spark, edges, labels):
    more = spark.createDataFrame([(20 + i, t, "", "h", 1, 0.1, 1, 1) for i, t in enumerate(["ABC # x", "abc", "abc", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " $"])], edges.schema)
    docs = edges.unionByName(more)
    assert sorted(tuple(r) for r in audit.audit(docs, labels).collect()) == brute_audit(docs, labels)


def test_lattice_counts_all_orders():
    for n in (1, 3, 5):
        paths = audit.lattice(n)
        assert len(paths) == n * 2 ** (n - 1)
        for size in range(n):
            assert sum(p for s, _, p in paths if s.bit_count() == size) == math.factorial(n)


def test_empty_tables(nothing, items, labels, edges):
    no_items = items.filter("item_id > 99")
    assert ranked.search(nothing, items).count() == 0 and ranked.search(edges, no_items).count() == 0
    assert decontaminate.contamination(nothing, items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(edges, no_items).collect()} == {0}
    assert audit.audit(nothing, labels).count() == 0 and audit.audit(edges, labels.filter("doc_id > 99")).count() == 600 * 5


@pytest.mark.parametrize("name", ["op11_ranked", "op12_decontaminate", "op13_audit"])
def test_queries_match_sql(spark, duck_small, name):
    ok, message = compare(queries.QUERIES[name](spark, SF_SMALL), queries.ORACLES[name], SF_SMALL, duck_small)
    assert ok, message
