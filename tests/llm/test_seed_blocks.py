"""Texts hashed together keep their own seeds."""
import random

import numpy as np

from postlens.llm import seeds, shingles


def _horner(words, k):
    h = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:i + len(h)]
    return shingles.mix64(h)


def test_windows_are_the_same_polynomial():
    w = np.random.default_rng(0).integers(0, 2**63, 90).astype(np.uint64)
    for k in range(1, 95):
        assert (shingles.windows(w, k) == _horner(w, k)).all() and len(shingles.windows(w, k)) == max(91 - k, 0)


def test_texts_hashed_together_keep_their_minimisers():
    r = np.random.default_rng(1)
    for _ in range(30):
        texts = [r.integers(0, 9, int(n)).astype(np.uint64) for n in r.integers(0, 90, 12)]
        sizes = np.array([len(x) for x in texts])
        stops = np.cumsum(sizes)
        got = seeds.minimisers(np.concatenate(texts), 5, 9, np.repeat(stops, sizes)).tolist()
        assert got == [p + e - n for t, n, e in zip(texts, sizes, stops, strict=True) for p in seeds.minimisers(t, 5, 9).tolist()]


def test_seed_rows_of_many_texts(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 3, 41, 42, 60, 200])))) for i in range(300)]
    got = {tuple(x) for x in seeds.seed_rows(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 42, 5, 9).collect()}
    want, hashes = set(), shingles.WordHashes()
    for i, t in rows:
        w = hashes.of(t)
        names = _horner(w, 42).view(np.int64).tolist()
        want |= {(names[p], i, p) for p in seeds.minimisers(w, 5, 9).tolist() if p < len(names)}
    assert got == want and got
