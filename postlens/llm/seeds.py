"""Content-selected positions of whole texts, for the two substring operators.

Words as in ``shingles``.  A position is a minimiser if its ``order``-word hash
is the smallest of some ``window`` consecutive ones (of equal ones the last), so
equal runs of words select equal positions wherever they stand.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from postlens.session import written

from .shingles import WordHashes, mix64, windows

#: Places of a block of documents, and the least it has if there are more blocks than these need.
HOT, SMALL = 1 << 18, 1 << 12


def minimisers(words, order: int, window: int, ends=None):
    """Positions selected in one text (array of word hashes), or in several that stand one
    after the other: ``ends`` has for each word where its text ends."""
    import numpy as np

    h = mix64(windows(words, order) ^ np.uint64(0x5851F42D4C957F2D))
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = h[:n].copy()
    at = np.arange(n)
    for i in range(1, window):
        smaller = h[i:i + n] <= low
        np.copyto(low, h[i:i + n], where=smaller)
        np.copyto(at, np.arange(i, i + n), where=smaller)
    if ends is not None:
        at = at[np.arange(n) + (window + order - 1) <= ends[:n]]
    return at[np.diff(at, prepend=-1) > 0]      # places never go back


#: Words of a block of texts that are hashed together.
_BLOCK = 1 << 16


def seed_rows(docs: DataFrame, depth: int, order: int, window: int, lengths: bool = False) -> DataFrame:
    """(seed, doc_id, pos): the name of the ``depth`` words at each minimiser; with ``lengths``
    also a row without a seed for each text, where ``pos`` is the number of its words."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()

        def block(ids, texts):
            sizes = np.array([len(w) for w in texts])
            w, ends = np.concatenate(texts), np.repeat(np.cumsum(sizes), sizes)
            h, p = windows(w, depth), minimisers(w, order, window, ends)
            p = p[p + depth <= ends[p]]
            places = p - (ends - np.repeat(sizes, sizes))[p]
            seed, owner = h[p].view(np.int64), np.repeat(np.array(ids, np.int64), sizes)[p]
            named = np.ones(len(p), bool)
            if lengths:
                seed, owner, places = np.append(seed, np.zeros(len(ids), np.int64)), np.append(owner, np.array(ids, np.int64)), np.append(places, sizes)
                named = np.append(named, np.zeros(len(ids), bool))
            return pa.RecordBatch.from_arrays([pa.array(seed, mask=~named), pa.array(owner), pa.array(places.astype(np.int32))], ["seed", "doc_id", "pos"])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids, texts, held = [], [], 0
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(hashes.of(t))
                    held += len(texts[-1])
                    if held > _BLOCK:
                        yield block(ids, texts)
                        ids, texts, held = [], [], 0
                if ids:
                    yield block(ids, texts)
    return docs.mapInArrow(run, "seed long, doc_id long, pos int")


def shared_seeds(docs: DataFrame, depth: int, order: int, window: int) -> DataFrame:
    """(seed, doc_id, pos, first_doc, first_pos, many): seeds that stand in two places
    or more, each with the seed's first place (smallest id, then position); ``many``
    if there are three or more.  The first place comes from a combined aggregate and a join that Spark may split,
    so a seed of any frequency needs no task of its own."""
    rows = seed_rows(docs, depth, order, window)
    place = F.struct("doc_id", "pos")
    first = (rows.groupBy("seed").agg(F.min(place).alias("f"), F.count("*").alias("c")).filter("c > 1")
             .select("seed", F.col("f.doc_id").alias("first_doc"), F.col("f.pos").alias("first_pos"), (F.col("c") > 2).alias("many")))
    return rows.join(first, "seed").filter("doc_id <> first_doc OR pos <> first_pos")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, first_doc): documents whose every text is that of ``first_doc``, the
    smallest id that has it."""
    texts = docs.select("doc_id", F.md5("text").alias("t"))
    first = texts.groupBy("t").agg(F.min("doc_id").alias("first_doc"))
    both = texts.join(first, "t").groupBy("doc_id").agg(F.min("first_doc").alias("first_doc"), F.max("first_doc").alias("last"))
    return both.filter("first_doc = last AND first_doc <> doc_id").select("doc_id", "first_doc")


def linked_seeds(docs: DataFrame, depth: int, order: int, window: int) -> tuple[DataFrame, DataFrame, int]:
    """``(own, cells, parts)``.  ``own`` (doc_id, first_doc, words, seeds, low, high): each copy of a whole
    text, with the first document that has it, and its size and seeds.  ``cells`` (cell, alike, side, seed,
    docs, places): every place of the seeds that other documents share, dealt over a grid of blocks of
    about ``HOT`` places each.  A cell has two blocks (``side`` 0 and 1) or, ``alike``, one, and
    all places in them of seeds that they share; any two documents meet in one cell.  ``parts``: the
    partitions to deal cells over."""
    rows = written(seed_rows(docs, depth, order, window, lengths=True))
    same = written(copies(docs))
    place = F.when(F.col("seed").isNotNull(), F.col("pos"))
    own = rows.join(same, "doc_id").groupBy("doc_id", "first_doc").agg(
        F.max(F.when(F.col("seed").isNull(), F.col("pos"))).alias("words"), F.size(F.collect_set(place)).alias("seeds"), F.min(place).alias("low"), F.max(place).alias("high"))
    rows = rows.filter("seed IS NOT NULL").join(same, "doc_id", "left_anti")
    several = rows.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("seed")
    shared = written(rows.join(several, "seed"))
    n, tasks = shared.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # More blocks than the places need only so that every task has some cells.
    blocks = max(1, -(-n // HOT), min(n // SMALL, math.isqrt(4 * tasks)))
    listed = shared.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).groupBy("seed", "block").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "pos"))).alias("s"), (F.min("doc_id") < F.max("doc_id")).alias("many"))
    listed = listed.join(listed.groupBy("seed").agg(F.collect_list("block").alias("all")), "seed")
    others = F.explode(F.filter("all", lambda b: (b != F.col("block")) | F.col("many")))
    cells = listed.select("seed", "block", F.transform("s", lambda x: x["doc_id"]).alias("docs"), F.transform("s", lambda x: x["pos"]).alias("places"), others.alias("other"))
    cells = cells.select((F.least("block", "other") * blocks + F.greatest("block", "other")).alias("cell"), (F.col("block") == F.col("other")).alias("alike"),
                         (F.col("block") > F.col("other")).cast("int").alias("side"), "seed", "docs", "places")
    return own, cells, max(tasks, min(blocks * (blocks + 1) // 2, 4 * tasks))


def contexts(docs: DataFrame, places: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over (doc_id, text, places) with the distinct places asked of each
    document: at most one a word, so a row is bounded by its text."""
    asked = places.groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    texts = docs.select("doc_id", "text").join(asked, "doc_id")
    return texts.select("doc_id", "text", "places").mapInArrow(run, schema)
