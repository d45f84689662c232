"""Ranked lexical search by an Aho-Corasick scan of the documents (operator 11).

1. The distinct terms of the items form one automaton, each term guarded by a blank
   on both sides; a text's separators become blanks, so that a match is a whole term.
2. Each task streams its documents through the automaton: a document's length and the
   occurrences of the terms come straight from its text, with no index of documents.
3. Document counts of the terms, N and L fix the weights; each term hands its weight to
   the items that it stands in, and a task keeps its ``k`` best documents of each item.
   Only those are shuffled, and they are ranked in two steps.

The items are broadcast in groups of about ``phrases.MOST_CHARS`` characters, each with
a scan of its own: the ranking of an item needs no other item.

All arithmetic after the logarithm is on 64-bit integers.  Null texts have no terms.  A
repeated row is a document of its own; a row with a null doc_id ranks behind equal
scores.  ``phrases.item_groups`` says what an item is.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial
from operator import itemgetter

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut_lineage
from .phrases import MOST_CHARS, folded, item_groups

K, SALTS = 10, 64


def _scan(batches, terms, block: int = 512):
    """(doc_id, n, term, tf): length of each document and the item terms it holds."""
    import ahocorasick
    import pyarrow as pa

    machine = ahocorasick.Automaton()
    for i, t in enumerate(terms.value):
        machine.add_word(f" {t} ", i)
    machine.make_automaton()
    output = itemgetter(1)
    for whole in batches:
        for lo in range(0, whole.num_rows, block):
            b = whole.slice(lo, block)
            n, term, tf, ends = [], [], [], [0]
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                text = folded(raw)
                n.append(len(text.split()))
                if n[-1] and terms.value:
                    found = Counter(map(output, machine.iter(f" {text.decode()} ")))
                    term += found.keys()
                    tf += found.values()
                ends.append(len(term))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], ["doc_id", "n", "term", "tf"])


class _Best:
    """The k best (score, then smallest doc_id, null last) of each item so far."""

    def __init__(self, items: int, k: int):
        import numpy as np

        self.k, self.bar = k, np.ones(items, np.int64)     # a score below an item's bar is out
        self.item, self.score, self.doc, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores, docs, nulls):
        """``scores``: documents x items."""
        import numpy as np

        row, item = np.nonzero(scores >= self.bar)
        if not len(row):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[row, item[len(self.item):]]])
        doc, null = np.concatenate([self.doc, docs[row]]), np.concatenate([self.null, nulls[row]])
        order = np.lexsort((doc, null, -score, item))
        first = np.flatnonzero(np.append(True, np.diff(item[order]) != 0))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
        order = order[rank < self.k]
        last = rank[rank < self.k] == self.k - 1
        self.item, self.score, self.doc, self.null = item[order], score[order], doc[order], null[order]
        self.bar[self.item[last]] = self.score[last]       # equal scores may still win by their id


def _rank(batches, model, k: int, cells: int = 2_000_000):
    """(item_id, doc_id, score): the k best documents of each item in this task."""
    import numpy as np
    import pyarrow as pa

    ids, weight, first, owner, times, n_docs, n_terms = model.value
    best = _Best(len(ids), k)
    block = max(cells // max(len(ids), 1), 1)
    for whole in batches:
        for lo in range(0, whole.num_rows, block):
            b = whole.slice(lo, block)
            flat, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            held = b.column(2).value_lengths().to_numpy()
            n = b.column(1).to_numpy()
            m = 25 + (75 * n * n_docs) // n_terms
            row = np.repeat(np.arange(len(n)), held)
            part = weight[flat] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            many = first[flat + 1] - first[flat]
            at = np.repeat(first[flat] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            scores = np.zeros(len(n) * len(ids), np.int64)
            np.add.at(scores, np.repeat(row * len(ids), many) + owner[at], np.repeat(part, many) * times[at])
            doc = b.column(0)
            best.add(scores.reshape(len(n), len(ids)), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False))
    yield pa.RecordBatch.from_arrays([pa.array(ids[best.item], pa.int64()), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())],
                                     ["item_id", "doc_id", "score"])


def _model(items: dict[int, list[list[bytes]]], place: dict[str, int], df: dict[int, int], n_docs: int, n_terms: int):
    """Arrays of the weights of the terms and of the items that each stands in."""
    import numpy as np

    ids = sorted(items)
    owners: list[list[tuple[int, int]]] = [[] for _ in place]
    for o, i in enumerate(ids):
        for t, c in Counter(w.decode() for words in items[i] for w in words).items():
            owners[place[t]].append((o, c))
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(place))]
    return (np.array(ids, np.int64), np.array(weight, np.int64), np.cumsum([0, *map(len, owners)]),
            np.array([o for x in owners for o, _ in x], np.int64), np.array([c for x in owners for _, c in x], np.int64), n_docs, max(n_terms, 1))


def search(docs: DataFrame, items: DataFrame, k: int = K, most_chars: int = MOST_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0
    of each item, all if fewer; equal scores by doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, sizes = None, None
    for group, _ in item_groups(items, most_chars):
        terms = sorted({w.decode() for texts in group.values() for words in texts for w in words})
        scan = docs.mapInArrow(partial(_scan, terms=spark.sparkContext.broadcast(terms)), "doc_id long, n long, term array<int>, tf array<bigint>")
        scan = cut_lineage(scan)
        if sizes is None:
            sizes = scan.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("terms")).first()
        df = dict(scan.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*")).collect())   # one row a term of the group
        model = spark.sparkContext.broadcast(_model(group, {t: i for i, t in enumerate(terms)}, df, sizes["docs"] or 0, sizes["terms"] or 0))
        best = scan.filter(F.size("term") > 0).mapInArrow(partial(_rank, model=model, k=k), "item_id long, doc_id long, score long")
        out = best if out is None else out.unionByName(best)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    out = (out.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order)))
           .filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k))
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
