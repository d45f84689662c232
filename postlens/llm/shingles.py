"""Word hashes and shingles of whole texts; runs in Python workers, no Spark code.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z in
lower case: ``bytes.lower`` and ``bytes.split`` do exactly that in UTF-8.
"""

from __future__ import annotations


def mix64(x):
    """Finaliser that spreads 64-bit values (array of uint64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, kept for the words of a block."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        import xxhash

        self.most, self.digest = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word):
        if len(self) > self.most:
            self.clear()
        self[word] = h = self.digest(word)
        return h

    def of(self, text: str | None):
        import numpy as np

        words = (text or "").encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(words, k: int):
    """Hash of every run of k words: a polynomial, made from those of half as many words."""
    import numpy as np

    if len(words) < k:
        return np.empty(0, np.uint64)
    base, h, m = 0x9E3779B97F4A7C15, words, 1
    for odd in bin(k)[3:]:
        h, m = h[:-m] * np.uint64(pow(base, m, 1 << 64)) + h[m:], 2 * m
        if odd == "1":
            h, m = h[:-1] * np.uint64(base) + words[m:], m + 1
    return mix64(h)


def shingle_set(words, k: int):
    """Sorted distinct k-word shingles; a shorter sequence counts as one."""
    import numpy as np

    return np.unique(windows(words, k if len(words) >= k else max(len(words), 1)))
