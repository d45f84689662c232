"""Document fingerprints by locally consistent parsing (operator 9).

A text's code points are parsed into phrases, the phrases' names into longer
phrases, and so on.  On each level runs of one symbol become one symbol; then
deterministic coin tossing gives each symbol a label from its lowest bit that
differs from its left neighbour's, four times, which leaves six labels at most;
phrases begin at the labels' local maxima.  A boundary depends on few symbols
around it, so equal substrings get equal phrases inside, whatever their offset.

The signature is the set of phrase names of level ``FROM`` and above (of the
last level in shorter texts); the fingerprint holds ``REGISTERS`` minima of it in
hexadecimal, and the likeness of two is their share of equal minima.  The empty
text has the empty fingerprint, like itself only.

Null text counts as empty.  Documents follow one another by id, null ids last,
rows of one id by their text's hash; a document alone is its own successor.  Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from postlens.session import written

from .common import plain_text
from .shingles import mix64

REGISTERS, LEVELS, FROM = 64, 6, 2


def _tosses():
    """Next label of (label, left label), both under 128."""
    import numpy as np

    a, b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    low = np.zeros_like(a)
    for bit in range(6, -1, -1):
        low = np.where(((a ^ b) >> bit) & 1, bit, low)
    return (2 * low + ((a >> low) & 1)).astype(np.uint8).ravel()


def phrases(x, doc, table):
    """One level: (names, doc of each) of the phrases of symbols ``x``, where
    ``doc`` tells the text of each symbol; ``table`` is ``_tosses()``."""
    import numpy as np

    one = np.uint64(1)
    # Runs of one symbol.
    head = np.ones(len(x), bool)
    head[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    length = np.diff(at, append=len(x))
    x, doc = x[at], doc[at]
    runs = length > 1
    x[runs] = mix64(x[runs] * np.uint64(0x9E3779B97F4A7C15) + length[runs].astype(np.uint64))
    first = np.ones(len(x), bool)
    first[1:] = doc[1:] != doc[:-1]
    # Two different runs may get one name; then the lowest bit counts.
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]
    d = x ^ left
    # The exponent of the double that holds the lowest bit set.
    low = ((d & (~d + one)).astype(float).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)
    low[d == 0] = 0
    label = (2 * low + ((x >> low) & one)).astype(np.uint8)
    for _ in range(3):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ 1
        label = table[(label.astype(np.int32) << 7) + left]
    begin = first.copy()
    begin[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    start = np.flatnonzero(begin)
    place = np.arange(len(x)) - np.repeat(start, np.diff(start, append=len(x)))
    names = np.add.reduceat(mix64(x + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start)
    return mix64(names), doc[start]


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text."""
    import numpy as np

    out = [""] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    x = np.frombuffer("".join([texts[i] for i in full]).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    doc = np.repeat(np.arange(len(full), dtype=np.int32), [len(texts[i]) for i in full])
    names, docs, done, table = [], [], np.zeros(len(full), bool), _tosses()
    for level in range(1, LEVELS + 1):
        x, doc = phrases(x, doc, table)
        count = np.bincount(doc, minlength=len(full))
        if level >= FROM:
            keep = slice(None)
        else:  # texts that end below the first level of the signature
            keep = (count == 1)[doc] & ~done[doc]
        names.append(x[keep])
        docs.append(doc[keep])
        done |= count == 1
        more = (count > 1)[doc]
        x, doc = x[more], doc[more]
        if not len(x):
            break
    names, docs = np.concatenate(names), np.concatenate(docs)
    order = np.argsort(docs, kind="stable")
    names, starts = names[order], np.searchsorted(docs[order], np.arange(len(full)))
    rng = np.random.Generator(np.random.PCG64(9))
    mask, odd = (rng.integers(1 << 63, size=REGISTERS, dtype=np.uint64) * np.uint64(2) + one for one in (np.uint64(0), np.uint64(1)))
    low = np.empty((len(full), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        low[:, i] = np.minimum.reduceat((names ^ mask[i]) * odd[i], starts)
    low = (mix64(low) >> np.uint64(48)).astype(">u2")
    for row, i in zip(low, full, strict=True):
        out[i] = row.tobytes().hex()
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal minima of two fingerprints."""
    if not a or not b:
        return float(a == b)
    return sum(a[i:i + 4] == b[i:i + 4] for i in range(0, len(a), 4)) / REGISTERS


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compared(pairs: list, more: dict | None = None):
    """Record batch of ``SCHEMA`` for (doc_id, text, next text), then the columns ``more``
    (name -> type), all null."""
    import hashlib

    import pyarrow as pa

    ids, texts, others = zip(*pairs, strict=True)
    edited = [t[:len(t) - len(t) // 2] + o[:len(t) // 2] for t, o in zip(texts, others, strict=True)]
    whole = list(dict.fromkeys([*texts, *others, *edited]))
    of = dict(zip(whole, fingerprints(whole), strict=True))
    own, new, near = ([of[t] for t in x] for x in (texts, edited, others))
    more = more or {}
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
         pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(own), pa.array(new),
         pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)]), pa.array([likeness(a, b) for a, b in zip(own, near, strict=True)]),
         *[pa.nulls(len(ids), kind) for kind in more.values()]],
        [*[x.split()[0] for x in SCHEMA.split(", ")], *more])


def _pairs_of(rows, flush: int = 400_000):
    """Lists of pairs (doc_id, text, next text) of some ``flush`` characters."""
    pairs, size = [], 0
    for i, t, other in rows:
        pairs.append((i, t, other))
        size += 2 * len(t)
        if size > flush:
            yield pairs
            pairs, size = [], 0
    if pairs:
        yield pairs


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next): each text against itself with its last half replaced by the start
    of the next document, and against that document.

    Rows are dealt by ranges of Spark's own counted bounds over (id, text's hash, place),
    so neither outlying ids nor a null or repeated id gather in one task.  A range compares its rows
    with one another and hands out its first and last one; the last is compared with
    the first of the next range that holds rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    rows = rows.withColumn("name", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("name"), F.col("place")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(order[0], order[1], "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def within(batches):
        import pyarrow as pa

        edges = {"part": pa.int32(), "edge": pa.string(), "text": pa.string()}
        names = [*[x.split()[0] for x in SCHEMA.split(", ")], *edges]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), *edges.values()]
        ends: dict = {}

        def following():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for i, t, part in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                        if "tail" in ends:
                            yield ends["tail"][0], ends["tail"][1], t
                        else:
                            ends["head"] = (i, t, part)
                        ends["tail"] = (i, t, part)
        for pairs in _pairs_of(following()):
            yield compared(pairs, edges)
        if ends:
            cells = [[r[0] for r in ends.values()], *[[None] * len(ends)] * 6, [r[2] for r in ends.values()], list(ends), [r[1] for r in ends.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names)

    def across(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for pairs in _pairs_of(zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)):
                    yield compared(pairs)
    found = written(rows.mapInArrow(within, SCHEMA + ", part int, edge string, text string"))
    heads = found.filter("edge = 'head'").select(F.col("part").alias("next"), F.col("text").alias("other"))
    # One number a range.
    follows = F.coalesce(F.lead("next").over(W.orderBy("next")), F.min("next").over(W.partitionBy()))
    follows = heads.select("next").select(F.col("next").alias("part"), follows.alias("next"))
    tails = found.filter("edge = 'tail'").select("part", "doc_id", "text").join(follows, "part").join(heads, "next")
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    return found.filter("edge IS NULL").select(columns).union(tails.select("doc_id", "text", "other").mapInArrow(across, SCHEMA))
