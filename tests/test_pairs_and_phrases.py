"""Phrase merge = greedy loop; prefix-filter join = brute force; offsets = naive."""
import itertools
import random

from pyspark.sql import functions as F

from postlens.operators import dedup as DD
from postlens.operators import docs as D
from postlens.operators import phrases as P
from postlens.operators import suspicion as SU


def greedy(tokens, phrases):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in phrases:
            out.append(tokens[i] + "_" + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_apply_phrases_equals_greedy(spark):
    rng = random.Random(7)
    vocab = list("abcde")
    rows = [(i, [rng.choice(vocab) for _ in range(rng.randint(0, 12))]) for i in range(300)]
    phr = {("a", "b"), ("b", "a"), ("c", "c"), ("d", "e")}
    tok = spark.createDataFrame(rows, "post_id long, tokens array<string>")
    pdf = spark.createDataFrame([(a, b, a + "_" + b, 99.0) for a, b in phr], "a string, b string, phrase string, score double")
    got = {r.post_id: r.tokens for r in P.apply_phrases(tok, pdf).collect()}
    for pid, toks in rows:
        assert got[pid] == greedy(toks, phr)
        assert "".join(got[pid]).replace("_", "") == "".join(toks)   # underlying tokens unchanged


def test_learn_phrases_score(spark):
    rows = [(i, ["new", "york", "city"]) for i in range(8)] + [(100 + i, ["new", "car"]) for i in range(3)]
    tok = spark.createDataFrame(rows, "post_id long, tokens array<string>")
    got = {(r.a, r.b): r.score for r in P.learn_phrases(tok, min_count=5, threshold=0.0).collect()}
    v = 4 + 3   # unigrams new york city car + bigrams new_york york_city new_car
    assert abs(got[("new", "york")] - (8 - 5) / (11 * 8) * v) < 1e-12
    assert ("new", "car") not in got   # 3 - 5 < 0


def brute_ratio(rows, t=0.8):
    by_user = {}
    for u, p, toks in rows:
        s = set(toks)
        if s:
            by_user.setdefault(u, []).append(s)
    out = {}
    for u, sets in by_user.items():
        sim = sum(1 for a, b in itertools.combinations(sets, 2) if len(a & b) / len(a | b) >= t)
        n = len(sets)
        out[u] = (n, sim, sim / max(1, n * (n - 1) / 2))
    return out


def test_duplicate_ratio_equals_brute_force_with_skew(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = []
    pid = 0
    for u in range(6):
        n = 150 if u == 0 else rng.randint(1, 12)   # user 0 is hot and full of copies
        for _ in range(n):
            k = rng.randint(0, 6)
            toks = rng.sample(words, k) if u else ["w0", "w1", "w2", "w3", "w4"][: rng.randint(4, 5)]
            rows.append((str(u), pid, toks))
            pid += 1
    tok = spark.createDataFrame(rows, "user_id string, post_id long, tokens array<string>")
    got = {r.user_id: (r.n_posts, r.similar_pairs, r.duplicate_post_ratio) for r in DD.duplicate_ratios(tok).collect()}
    exp = brute_ratio(rows)
    assert set(got) == set(exp)
    for u in exp:
        assert got[u][0] == exp[u][0] and got[u][1] == exp[u][1]
        assert abs(got[u][2] - exp[u][2]) < 1e-12


def test_offsets_skewed_document(spark):
    rng = random.Random(5)
    rows = []
    for pid in range(400):
        doc = "hot" if pid < 300 else f"d{pid % 7}"
        rows.append((pid, doc, f"2024-01-01 00:{pid % 60:02d}:00", ["x"] * rng.randint(1, 5)))
    df = spark.createDataFrame(rows, "post_id long, doc_id string, ts string, tokens array<string>") \
              .withColumn("timestamp", F.to_timestamp("ts")).drop("ts")
    got = {r.post_id: r.offset for r in D.post_offsets(df, n_parts=16).collect()}
    by_doc = {}
    for pid, doc, ts, toks in rows:
        by_doc.setdefault(doc, []).append((ts, pid, len(toks)))
    for doc, items in by_doc.items():
        acc = 0
        for ts, pid, n in sorted(items):
            assert got[pid] == acc
            acc += n


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    a = rng.integers(0, 5, 3000).astype(float)
    b = rng.random(3000)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    for q in (0.0, 0.0095, 0.5, 0.95, 1.0):
        ga, gb = SU.exact_quantiles(df, [("a", q), ("b", q)], accuracy=50)
        assert abs(ga - np.percentile(a, q * 100)) < 1e-12
        assert abs(gb - np.percentile(b, q * 100)) < 1e-12


def brute_phrases(sentences, min_count, threshold):
    """String-keyed vocabulary scoring, stated directly."""
    from collections import Counter
    vocab = Counter()
    for s in sentences:
        vocab.update(s)
        vocab.update(a + "_" + b for a, b in zip(s, s[1:]))
    v = len(vocab)
    out = {}
    for s in sentences:
        for a, b in zip(s, s[1:]):
            sc = (vocab[a + "_" + b] - min_count) / (vocab[a] * vocab[b]) * v
            if sc > threshold:
                out[(a, b)] = sc
    return out


def test_learn_phrases_string_keyed_with_underscores(spark):
    rng = random.Random(9)
    words = ["x", "y", "z", "x_y", "y_z", "q"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(0, 9))]) for i in range(400)]
    tok = spark.createDataFrame(rows, "post_id long, tokens array<string>")
    for mc, th in [(5, 10.0), (2, 0.5), (0, -1.0)]:
        got = {(r.a, r.b): r.score for r in P.learn_phrases(tok, min_count=mc, threshold=th).collect()}
        exp = brute_phrases([t for _, t in rows], mc, th)
        assert set(got) == set(exp), (mc, th)
        for k in exp:
            assert abs(got[k] - exp[k]) < 1e-9


def test_hot_user_is_dealt_over_blocks(spark):
    rng = random.Random(2)
    rows = [("hot", i, sorted({"same", *(f"t{rng.randint(0, 11)}" for _ in range(4))})) for i in range(400)]
    rows += [("other", 1000 + i, ["same", "x", f"y{i % 3}"]) for i in range(9)]
    sets = DD.token_sets(spark.createDataFrame(rows, "user_id string, post_id long, tokens array<string>"))
    pref = sets.select("user_id", F.lit("same").alias("token"), "h1", "h2", "n", F.lit(0).alias("r"), F.lit(True).alias("idx"))
    keys = ["user_id", "token", "row", "line"]
    for side in DD.grid(pref, budget=20):
        assert side.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 40      # parts are dealt by hash
    a, b = DD.grid(pref, budget=20)
    n = {r.user_id: r["count"] for r in pref.groupBy("user_id").count().collect()}
    met = a.alias("a").join(b.alias("b"), keys).groupBy("user_id").agg(F.count("*").alias("all"), F.countDistinct("a.h1", "a.h2", "b.h1", "b.h2").alias("pairs"))
    assert {r.user_id: (r["all"], r.pairs) for r in met.collect()} == {u: (m * m, m * m) for u, m in n.items()}
    whole = sorted(map(tuple, DD.similar_set_pairs(sets, 0.8).select("user_id", "post_a", "post_b", "weight").collect()))
    assert whole and whole == sorted(map(tuple, DD.similar_set_pairs(sets, 0.8, budget=20).select("user_id", "post_a", "post_b", "weight").collect()))


def test_pairs_that_only_share_tokens_are_not_written(spark):
    """Sets that share their rarest token and little else make no candidate rows."""
    rng = random.Random(5)
    rows = [("u", i, ["rare", *(f"w{rng.randint(0, 5000)}" for _ in range(60))]) for i in range(60)]
    rows += [("u", 100 + i, ["rare", *(f"c{j}" for j in range(40)), f"own{i}"]) for i in range(5)] + [(None, 200 + i, rows[0][2]) for i in range(2)]
    sets = DD.token_sets(spark.createDataFrame(rows, "user_id string, post_id long, tokens array<string>"))
    got = {(r.post_a, r.post_b) for r in DD.similar_set_pairs(sets, 0.8).collect()}
    own = [(p, set(t)) for u, p, t in rows if u]
    assert {tuple(sorted(x)) for x in got} == {(p, q) for (p, a), (q, b) in itertools.combinations(own, 2) if len(a & b) / len(a | b) >= 0.8}
    few = DD.prefixes(sets.filter("user_id IS NOT NULL"), 0.8)
    assert few.count() == sum(n - (4 * n + 4) // 5 + 1 for n in (len(t) for _, t in own))
    plan = DD.similar_set_pairs(sets, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in x and "bit_count" in x for x in plan.split("\n"))       # tested inside the join
