"""Toxicity by non-negative positive-unlabelled learning (operator 4).

Confirmed toxic documents (P) and unlabelled documents (U) train a linear
classifier in numpy.  With the class prior pi and logistic loss l the risk is

    pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)])

and where the second part turns negative its gradient is reversed, which keeps
a flexible model from explaining U as all negative.

Features are words and their first 3 to 5 letters, hashed: whether one is there,
and whether a 64th or a 16th of the text's distinct words have it (a rare
mention in a long text is not a toxic text).  Those whose frequency differs
between P and U by ``Z`` standard errors are kept, of those that P has.

Training reads at most ``max_positive`` and ``max_unlabelled`` documents (a
stated bound, drawn by a hash of the id), never rows whose crc32(id as text)
mod 5 is 0; the prior is the share of toxic rows among labelled training rows.
Scoring reads every whole text.  Null or empty text has no features and gets
the model's bias; without a confirmed toxic document every score is 0.  Null
toxic labels are left out; a document labelled twice is toxic if either says
so.  Repeated rows and null ids each come back.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import unused

_BITS = 22
_STRIP = ".,;:!?\"'()[]{}<>|*_-…«»„“”‘’"
#: Standard errors by which a kept feature's frequencies differ.
Z = 4.0


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Features(dict):
    """Hashed marks of a raw token, kept for a block's tokens; with ``only``,
    those that a model has.  Mark m makes the features 4 m (it is there),
    4 m + 1 and 4 m + 2 (a 64th, a 16th of the words have it)."""

    def __init__(self, only=None, most: int = 300_000):
        super().__init__()
        self.only, self.most = only, most

    def __missing__(self, token):
        from zlib import crc32

        if len(self) > self.most:
            self.clear()
        word = token.strip(_STRIP)
        names = [f"w{word}", *(f"{n}{word[:n]}" for n in (3, 4, 5) if len(word) >= n)] if word else []
        got = {crc32(x.encode()) & ((1 << (_BITS - 2)) - 1) for x in names}
        self[token] = got = tuple(got if self.only is None else got & self.only)
        return got

    def of(self, text: str | None) -> list[int]:
        from collections import Counter
        from itertools import chain

        words = set((text or "").lower().split())
        n, out = len(words), []
        for m, k in Counter(chain.from_iterable(map(self.__getitem__, words))).items():
            out.append(4 * m)
            if 64 * k >= n:
                out.append(4 * m + 1)
                if 16 * k >= n:
                    out.append(4 * m + 2)
        return out


def _sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int):
    """(P, U, prior): lists of feature arrays, on the driver within the stated bounds."""
    import numpy as np

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return [], [], 0.0
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    positive = marks.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(max_positive).withColumn("p", F.lit(1))
    rest = docs.select("doc_id").filter(~held_out() & F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64(F.lit("unlabelled"), "doc_id"), "doc_id").limit(max_unlabelled)
    chosen = positive.unionByName(rest.withColumn("p", F.lit(0)))

    def run(batches):
        import pyarrow as pa

        features = Features()
        for b in batches:
            ids = [np.array(features.of(t), np.int32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["p", "ids"])
    # One text an id (the greatest), so that repeated rows do not pass the bounds.
    drawn = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "p").agg(F.max("text").alias("text"))
    got = drawn.select("p", "text").mapInArrow(run, "p int, ids binary").toArrow()
    mark = got.column(0).to_numpy()
    ids = [np.frombuffer(x, np.int32) for x in got.column(1).to_pylist()]
    del got
    return [x for x, p in zip(ids, mark, strict=True) if p], [x for x, p in zip(ids, mark, strict=True) if not p], toxic / n


def fit(positive: list, unlabelled: list, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 3e-3, beta: float = 0.0):
    """(features, weights, bias) minimising the non-negative risk by Adam."""
    import numpy as np

    if not positive or not unlabelled:
        return np.empty(0, np.int32), np.empty(0), -np.inf

    def share(rows):
        return np.unique(np.concatenate(rows), return_counts=True)
    (names, counts), (other, more) = share(positive), share(unlabelled)
    p, u = counts / len(positive), np.zeros(len(names))
    _, i, j = np.intersect1d(names, other, assume_unique=True, return_indices=True)
    u[i] = more[j] / len(unlabelled)
    mean = (p + u) / 2
    z = np.abs(p - u) / np.sqrt(mean * (1 - mean) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-12)
    kept = names[(z > Z) & (mean * len(positive) >= 3)].astype(np.int32)
    place = np.full(1 << _BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def sparse(rows):
        rows = [place[r] for r in rows]
        rows = [r[r >= 0] for r in rows]
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)
    sides = sparse(positive), sparse(unlabelled)
    w = np.zeros(len(kept) + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, steps + 1):
        f = [np.bincount(r, w[c], n) + w[-1] for c, r, n in sides]
        rest = np.log1p(np.exp(np.clip(f[1], -30, 30))).mean() - prior * np.log1p(np.exp(np.clip(f[0], -30, 30))).mean()
        # Derivatives of the loss of being positive on P, negative on U and on P.
        up, un, pn = -sigmoid(-f[0]) / len(f[0]), sigmoid(f[1]) / len(f[1]), sigmoid(f[0]) / len(f[0])
        on_p, on_u = (prior * (up - pn), un) if rest >= -beta else (prior * pn, -un)
        g = np.zeros_like(w)
        for (c, r, _), d in zip(sides, (on_p, on_u), strict=True):
            g[:-1] += np.bincount(c, d[r], len(kept))
            g[-1] += d.sum()
        g[:-1] += decay * prior * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return kept, w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 10000):
    model = fit(*_sample(docs, labels, max_positive, max_unlabelled))
    _give_back()
    return model


def _give_back() -> None:
    """Return the freed sample to the system: glibc keeps it, and the driver lives on."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def scorer(model):
    """A column function: the score of a whole text, 0 to 1."""
    kept, weights, bias = model
    table = dict(zip(kept.tolist(), weights.tolist(), strict=True))

    def score(texts):
        import math

        import pandas as pd

        features = Features(frozenset(i // 4 for i in table))
        for t in texts:
            raw = [bias + sum([table.get(i, 0.0) for i in features.of(x)]) for x in t]
            yield pd.Series([1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in raw], dtype=float)
    from collections.abc import Iterator

    import pandas as pd

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def scores(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    score = scorer(train(docs, labels, **bounds))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    score = scorer(train(docs, labels, **bounds))
    (name,) = unused(docs, "_toxicity")
    return docs.withColumn(name, score(F.col("text"))).filter(F.col(name) < 0.5).select(*docs.columns)
