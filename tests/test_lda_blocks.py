"""The fit sends a block of documents each of its terms once, and a pass is one job; its numbers are those of single documents."""
import numpy as np
from pyspark.sql import functions as F

from postlens.operators import lda as L


def _bow(spark):
    r = np.random.default_rng(1)
    rows = [(f"d{d}", int(t) * 50, float(1 + r.integers(3))) for d in range(40) for t in r.choice(30, 12, replace=False)]
    return spark.createDataFrame(rows, "doc_id string, term_index int, tf double")


def test_documents_fitted_together_equal_single_ones():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 30, 25)
    ends, a = np.cumsum(sizes), np.full(4, 0.2)
    words, n = r.gamma(0.5, 1, (ends[-1], 4)) + 1e-6, r.integers(1, 5, ends[-1]).astype(float)
    got = L._fit(words, n, ends, a)
    for d, (lo, hi) in enumerate(zip(ends - sizes, ends, strict=True)):
        gamma = a + n[lo:hi].sum() / 4
        for _ in range(100):
            theta = np.exp(L._digamma(gamma) - L._digamma(gamma.sum()))
            new = a + theta * ((n[lo:hi] / (words[lo:hi] @ theta)) @ words[lo:hi])
            close = np.abs(new - gamma).mean() < 1e-3
            gamma = new
            if close:
                break
        assert np.allclose(got[d], gamma, rtol=1e-9)


def test_blocks_do_not_change_the_fit(spark, monkeypatch):
    bow = _bow(spark)
    table = lambda m: np.array([[*r.lam, r.eta] for r in m.topics.orderBy("term_index").collect()])
    fits = []
    for block, once in ((L.BLOCK, L.AT_ONCE), (7, 5)):
        monkeypatch.setattr(L, "BLOCK", block)
        monkeypatch.setattr(L, "AT_ONCE", once)
        fits.append(L.fit_lda(bow, k=3, passes=2))
        probs = {r.doc_id: r.probs for r in L.document_topics(fits[-1], bow).collect()}
        assert len(probs) == 40
    assert np.allclose(table(fits[0]), table(fits[1]), rtol=1e-6) and np.allclose(fits[0].alpha, fits[1].alpha)


def test_a_block_asks_for_each_of_its_terms_once(spark):
    bow = _bow(spark)
    docs, tasks = L._packed(bow, "doc_id")
    shares = docs.select("block", F.explode("terms").alias("t")).distinct()
    dealt = L._dealt(docs, tasks, shares.select("block", F.array("t").alias("terms"), F.array(F.lit(0.5)).alias("share")))
    assert dealt.filter("fit = 0").count() == shares.count() < bow.count() and dealt.filter("fit = 1").count() == 40
