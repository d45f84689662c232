"""Components of nested edge sets, and expressions that lambdas must not make anew."""
import numpy as np
from pyspark.sql import functions as F

from postlens.operators import embed_topics as E
from postlens.operators import graph as G
from postlens.operators import vectors as VX


def test_nested_components_as_the_plain_rounds(spark):
    rng = np.random.default_rng(3)
    edges, top = [], 9
    for n in range(1, 120):
        if n % 17:                                # a forest of several trees
            edges.append((n * 3, int(rng.integers(n - n % 17, n)) * 3, int(rng.integers(1, top + 1))))
    e = spark.createDataFrame(edges, "a long, b long, step int")
    nodes = spark.createDataFrame([(n * 3, n % 4) for n in range(120)], "node long, block long")
    every = e.select(F.explode(F.sequence("step", F.lit(top))).alias("step"), "a", "b")
    want = sorted(map(tuple, G.components(every, "step").collect()))
    for blocks in (nodes, nodes.withColumn("block", F.lit(0).cast("long")), nodes.withColumn("block", F.col("node"))):
        assert sorted(map(tuple, G.nested_components(e, top, blocks).collect())) == want


def _lambdas_with_aggregates(df):
    """Aggregates that stand inside the lambda of another function of arrays."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    deep = 0
    for line in plan.splitlines():
        at = line.find("transform(")
        while at >= 0:
            depth = 0
            for end in range(at + 9, len(line)):
                depth += {"(": 1, ")": -1}.get(line[end], 0)
                if not depth:
                    break
            body = line[line.find("lambdafunction(", at, end):end]
            deep += body.count("aggregate(") if "lambdafunction(" in line[at:end] else 0
            at = line.find("transform(", at + 1)
    return deep


def test_sums_are_not_made_for_each_entry(spark):
    reduced = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 4.0])], "doc_id long, reduced array<double>")
    soft = E.soft_membership(reduced, [[0.0, 0.0], [3.0, 4.0], [6.0, 8.0]])
    rows = {r.doc_id: r.probs for r in soft.collect()}
    inv = [1 / (1e-9 + d) for d in (1.0, 18 ** 0.5, (36 + 49) ** 0.5)]
    assert np.allclose(rows[1], np.array(inv) / sum(inv)) and np.isclose(rows[2][1], 1.0)
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "")], "doc_id long, processed_text string")
    hashed = VX.hashed_tfidf(docs)
    assert np.isclose(sum(v * v for r in hashed.collect() for v in r["values"]), 1.0)
    assert _lambdas_with_aggregates(hashed) == 0
    assert "aggregate(" not in soft._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]


def test_class_terms_are_counted_row_by_row(spark):
    from collections import Counter

    from postlens.operators.embed_topics import class_terms

    rows = [(1, "red red blue"), (2, "blue green blue"), (3, ""), (None, "red"), (4, None), (5, "green")]
    assigned = [(1, 0), (2, 1), (3, 1), (4, 0), (5, 0), (None, 0)]
    for more, again in (([], []), ([(1, "red pink"), (5, "green")], [(1, 0), (5, 1)])):
        docs = spark.createDataFrame(rows + more, "doc_id long, processed_text string")
        got = class_terms(docs, spark.createDataFrame(assigned + again, "doc_id long, topic_id int"), stopwords=["pink"])
        want = Counter((i, w) for i, t in rows + more if i is not None for w in (t or "").split() if w != "pink")
        assert Counter(map(tuple, got.collect())) == Counter((i, c, w, n) for (i, w), n in want.items() for j, c in assigned + again if i == j)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert bool(more) == any("Aggregate" in x and "term" in x for x in plan.split("\n"))
