"""M1 - M3: priors' special functions, properties of fits, recovery of planted topics."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import lda as L


@pytest.fixture(scope="module")
def planted(spark):
    """120 documents, each of one of three topics of ten terms with a little of the others."""
    rng = random.Random(4)
    rows, topic = [], {}
    for d in range(120):
        topic[f"d{d}"] = d % 3
        counts = {}
        for _ in range(60):
            t = d % 3 if rng.random() < 0.9 else rng.randrange(3)
            w = t * 10 + rng.randrange(10)
            counts[w] = counts.get(w, 0) + 1
        rows += [(f"d{d}", w, c) for w, c in counts.items()]
    return spark.createDataFrame(rows, "doc_id string, term_index int, tf long"), topic


def test_special_functions():
    for x in (0.01, 0.3, 1.0, 2.5, 40.0):
        h = 1e-4 * max(x, 0.05)
        slope = (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
        assert abs(L._digamma(np.float64(x)) - slope) < 1e-4 * max(1, abs(slope))
        second = (L._digamma(np.float64(x + h)) - L._digamma(np.float64(x - h))) / (2 * h)
        assert abs(L._trigamma(np.float64(x)) - second) < 1e-3 * second
    assert abs(L._digamma(1.0) + 0.5772156649) < 1e-8 and abs(L._trigamma(1.0) - math.pi ** 2 / 6) < 1e-7


@pytest.mark.parametrize("batch_docs", [100_000, 50])
def test_planted_topics_are_found(spark, planted, batch_docs):
    bow, topic = planted
    model = L.fit_lda(bow, k=3, passes=8 if batch_docs > 120 else 4, batch_docs=batch_docs)
    vocab = spark.createDataFrame([(i, f"w{i}") for i in range(30)], "term_index int, term string")
    words = L.topic_words(model, vocab, 10).collect()
    tops = {}
    for r in words:
        tops.setdefault(r.topic_id, set()).add(int(r.word[1:]) // 10)
        assert 0 < r.weight < 1
    assert sorted(len(v) for v in tops.values()) == [1, 1, 1] and set.union(*tops.values()) == {0, 1, 2}
    assert sorted(r["rank"] for r in words if r.topic_id == 0) == list(range(1, 11))
    right = 0
    for r in L.document_topics(model, bow).collect():
        assert len(r.probs) == 3 and abs(sum(r.probs) - 1) < 1e-9 and min(r.probs) >= 0
        right += tops[r.probs.index(max(r.probs))] == {topic[r.doc_id]}
    assert right == 120
    sums = [model.topics.agg(F.sum(F.col("lam")[i])).first()[0] for i in range(3)]
    assert np.allclose(sums, model.totals) and model.topics.filter(F.exists("lam", lambda x: x <= 0) | (F.col("eta") <= 0)).count() == 0
    assert all(a > 0 for a in model.alpha)


def test_fit_does_not_depend_on_partitions_and_learns_priors(spark, planted):
    bow, _ = planted
    one, many = L.fit_lda(bow.coalesce(1), k=3, passes=3), L.fit_lda(bow.repartition(7), k=3, passes=3)
    table = lambda m: np.array([r.lam for r in m.topics.orderBy("term_index").collect()])
    assert np.allclose(table(one), table(many), rtol=1e-6) and np.allclose(one.alpha, many.alpha)
    assert one.topics.agg(F.countDistinct("eta")).first()[0] > 1
    fixed = L.fit_lda(bow, k=3, passes=2, learn_priors=False)
    assert fixed.alpha == [1 / 3] * 3 and fixed.topics.agg(F.countDistinct("eta")).first()[0] == 1
    other = L.fit_lda(bow, k=3, passes=1, seed=7)
    assert not np.allclose(table(other), table(L.fit_lda(bow, k=3, passes=1)))


def test_no_documents(spark):
    model = L.fit_lda(spark.createDataFrame([], "doc_id string, term_index int, tf long"), k=3)
    assert model.k == 3 and model.topics.count() == 0
