"""FM-index over a sequence of symbols; numpy only, runs in Python workers.

Rows are the suffixes in order; ``last`` is the symbol before each (Burrows-Wheeler
transform), kept as a wavelet tree: one bit vector a level, stored level by level,
with counts of ones so that a rank is two lookups a level.  All operations take
arrays, so that many patterns or rows move one step at a time together.
"""

from __future__ import annotations


def suffix_order(s):
    """Suffix array of ``s`` (non-negative ints, its last one the only 0): ranks by
    runs of 2^k packed symbols, each round sorting only what is still tied."""
    import numpy as np

    n = len(s)
    bits = max(int(s.max()).bit_length(), 1)
    width = max(62 // bits, 1)
    key = np.zeros(n, np.int64)
    for i in range(width):               # the first ``width`` symbols in one number
        key <<= bits
        if i < n:
            key[:n - i] |= s[i:]
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=fresh[1:])
    heads = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(heads, append=n))
    k = width
    while len(heads) < n:
        sizes = np.diff(heads, append=n)
        tied = np.repeat(sizes > 1, sizes)
        rows = np.flatnonzero(tied)
        pos = order[rows]
        ahead = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)], -1)
        sub = np.lexsort((ahead, rank[pos]))
        pos, ahead = pos[sub], ahead[sub]
        group = rank[pos]
        order[rows] = pos
        split = np.empty(len(rows), bool)
        split[0] = True
        split[1:] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        fresh[rows] = split
        heads = np.flatnonzero(fresh)
        rank[order] = np.repeat(heads, np.diff(heads, append=n))
        k *= 2
    return order


class Bits:
    """Bit vector with ranks: ones before a block of 256, ones before it in its block."""

    def __init__(self, bits):
        import numpy as np

        n = len(bits)
        ones = np.zeros(n + 1, np.int32)
        np.cumsum(bits, out=ones[1:])
        self.block = ones[::256].copy()
        self.inside = (ones - np.repeat(self.block, 256)[:n + 1]).astype(np.uint8)
        self.bits, self.zeros = bits, n - int(ones[-1])

    def ones(self, i):
        """Ones among the first i bits."""
        return self.block[i >> 8] + self.inside[i]


class FMIndex:
    """Index of ``s``; as for ``suffix_order``.  Every ``sample``-th text position is kept."""

    def __init__(self, s, sample: int = 16):
        import numpy as np

        order = suffix_order(s)
        self.n, top = len(s), int(s.max()) + 1
        self.before = np.zeros(top + 1, np.int64)          # suffixes that start with a smaller symbol
        np.cumsum(np.bincount(s, minlength=top), out=self.before[1:])
        last = s[order - 1]                                # order 0 reads the final 0
        self.levels: list[Bits] = []
        rest = last
        for b in range(max(int(top - 1).bit_length(), 1) - 1, -1, -1):
            bit = (rest >> b & 1).astype(bool)
            self.levels.append(Bits(bit))
            rest = np.concatenate([rest[~bit], rest[bit]])
        self.start = self._down(np.arange(top), np.zeros(top, np.int64))   # where each symbol's run starts at the bottom
        kept = order % sample == 0
        self.kept, self.places = Bits(kept), order[kept]

    def _down(self, symbols, i):
        """Place of boundary ``i`` after all levels, following each symbol's bits."""
        import numpy as np

        for level, b in zip(self.levels, range(len(self.levels) - 1, -1, -1), strict=True):
            ones = level.ones(i)
            i = np.where(symbols >> b & 1, level.zeros + ones, i - ones)
        return i

    def rank(self, symbols, i):
        """How often each symbol stands in the first i entries of ``last``."""
        return self._down(symbols, i) - self.start[symbols]

    def search(self, patterns, lengths):
        """[low, high) rows of each pattern, right-aligned in its row of ``patterns``."""
        import numpy as np

        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width, top = patterns.shape[1], len(self.start)
        for k in range(1, width + 1):
            live = np.flatnonzero((lengths >= k) & (low < high))
            if not len(live):
                break
            c = patterns[live, width - k]
            known = c < top                                # symbols past the last one of this text
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            base = self.before[c]
            low[live], high[live] = base + self.rank(c, low[live]), base + self.rank(c, high[live])
        return low, high

    def locate(self, rows):
        """Text position of each row: step back through the text up to a kept position."""
        import numpy as np

        out, rows, who = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(who):
            done = self.kept.bits[rows]
            out[who[done]] = self.places[self.kept.ones(rows[done])] + steps
            rows, who = rows[~done], who[~done]
            i, c = rows, np.zeros(len(rows), np.int64)
            for level in self.levels:
                bit, ones = level.bits[i], level.ones(i)
                c = c << 1 | bit
                i = np.where(bit, level.zeros + ones, i - ones)
            rows = self.before[c] + i - self.start[c]
            steps += 1
        return out
