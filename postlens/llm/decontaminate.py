"""Benchmark passages in documents by FM-indexes (operator 12).

1. Phrases: every run of ``size`` words of an item; an item of fewer words is one
   phrase.  Their words are the alphabet.
2. Each task indexes its documents shard by shard.  A word that stands in no phrase
   parts the text, and a run of phrase words shorter than the shortest phrase cannot
   hold one: such stretches are one separator in the shard's sequence.  All other words
   are indexed, of whole texts; a run longer than a shard goes on in the next one, over
   ``size - 1`` words of both.
3. All phrases are searched backwards at once through the wavelet tree's ranks; the
   rows found are located by stepping back to sampled suffix positions.
4. Occurrences of a document are merged into removal spans; phrases map to items.

Rows are independent: no shuffle, and a lost executor repeats only its own tasks.  Items
beyond ``phrases.MOST_CHARS`` characters are taken group by group, and each group's
spans are added to the rows of the one before, with the rows written in between.

Null texts have no words.  Rows with a null or repeated doc_id are documents of their
own.  ``phrases.item_groups`` says what an item is.
"""

from __future__ import annotations

from functools import partial
from itertools import repeat

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage
from .phrases import MOST_CHARS, folded, item_groups

SIZE, SHARD = 10, 1_000_000
_SPANS = "array<struct<start:int,stop:int>>"


class Phrases:
    """Distinct phrases of a group of items as symbols (0: end, 1: separator)."""

    def __init__(self, items: dict[int, list[list[bytes]]], size: int):
        import numpy as np

        self.size = size
        self.symbol: dict[bytes, int] = {}
        self.items: list[int] = sorted(items)
        owners: dict[tuple, set[int]] = {}
        for o, i in enumerate(self.items):
            for words in items[i]:
                w = [self.symbol.setdefault(x, len(self.symbol) + 2) for x in words]
                for at in range(max(len(w) - size + 1, min(len(w), 1))):
                    owners.setdefault(tuple(w[at:at + size]), set()).add(o)
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.patterns = np.zeros((len(owners), size), np.int64)
        for row, p in zip(self.patterns, owners, strict=True):
            row[size - len(p):] = p
        self.first = np.cumsum([0, *(len(o) for o in owners.values())])
        self.owner = np.array([x for o in owners.values() for x in sorted(o)], np.int64)
        self.shortest = int(self.lengths.min()) if len(owners) else 0

    def runs(self, symbols):
        """[start, stop) of the runs of phrase words that can hold a phrase."""
        import numpy as np

        edge = np.flatnonzero(np.diff(symbols > 1, prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        long = stop - start >= self.shortest
        return start[long], stop[long]


def occurrences(symbols, phrases: Phrases, shard: int = SHARD):
    """(place, phrase) of every occurrence of a phrase in ``symbols``, by one FM-index a shard."""
    import numpy as np

    from .fmindex import FMIndex

    start, stop = phrases.runs(symbols)
    if (stop - start > shard).any():                       # go on in the next shard, over size - 1 words of both
        step = max(shard - phrases.size + 1, 1)
        start, stop = np.array([(a, min(a + step + phrases.size - 1, e)) for s, e in zip(start.tolist(), stop.tolist(), strict=True)
                                for a in range(s, e, step) if a == s or a + phrases.size - 1 < e]).T
    places, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ends = np.cumsum(stop - start + 1)
    lo = 0
    while lo < len(start):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + shard, side="right")), lo + 1)
        a, size = start[lo:hi], (stop - start)[lo:hi]
        lo = hi
        at = np.cumsum(size + 1) - size - 1                # where each run stands in the shard
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        parted = np.ones(at[-1] + size[-1] + 1, np.int64)
        parted[np.repeat(at, size) + inside] = symbols[np.repeat(a, size) + inside]
        parted[-1] = 0
        index = FMIndex(parted)
        low, high = index.search(phrases.patterns, phrases.lengths)
        many = np.maximum(high - low, 0)
        rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        where = index.locate(rows)
        run = np.searchsorted(at, where, side="right") - 1
        places.append(where - at[run] + a[run])
        found.append(np.repeat(np.arange(len(many)), many))
    return np.concatenate(places), np.concatenate(found)


def merged(doc, start, stop):
    """Union of the spans of each document, in order: (doc, start, stop)."""
    import numpy as np

    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    far = int(stop.max()) + 2                              # keeps documents apart
    reach = np.maximum.accumulate(stop + doc * far)
    fresh = np.append(True, (start[1:] + doc[1:] * far > reach[:-1]) | (doc[1:] != doc[:-1]))
    head = np.flatnonzero(fresh)
    return doc[head], start[head], reach[np.append(head[1:], len(doc)) - 1] - doc[head] * far


def _scan(batches, phrases, shard: int, last: bool, block: int = 2048, most_words: int = 4_000_000):
    """Adds the spans and items of a group of items to rows (text, n_words, spans, items)."""
    import numpy as np
    import pyarrow as pa

    p = phrases.value

    def done(counts, symbols):
        """Spans and items of some rows; their words follow one another, with a separator after each row."""
        first = np.cumsum([0, *(c + 1 for c in counts)])
        place, phrase = occurrences(np.concatenate(symbols), p, shard)
        row = np.searchsorted(first, place, side="right") - 1
        spans = merged(row, place - first[row], place - first[row] + p.lengths[phrase])
        pair = np.unique(row * len(p.lengths) + phrase)    # a phrase of many items counts once a document
        row, phrase = pair // max(len(p.lengths), 1), pair % max(len(p.lengths), 1)
        many = p.first[phrase + 1] - p.first[phrase]
        owner = p.owner[np.repeat(p.first[phrase] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        pair = np.unique(np.repeat(row, many) * max(len(p.items), 1) + owner)
        out = [([], []) for _ in counts]
        for d, a, e in zip(*(x.tolist() for x in spans), strict=True):
            out[d][0].append({"start": a, "stop": e})
        for x in pair.tolist():
            out[x // len(p.items)][1].append(p.items[x % len(p.items)])
        return out

    for whole in batches:
        names = whole.schema.names
        at = {c: names.index(c) for c in ("_text", "_spans", "_items")}
        for lo in range(0, whole.num_rows, block):
            b = whole.slice(lo, block)
            texts = b.column(at["_text"]).cast(pa.binary()).to_pylist()
            counts, symbols, held, results, size = [], [], [], [], 0
            for t in texts:
                words = folded(t).split()
                s = np.fromiter(map(p.symbol.get, words, repeat(1)), np.int32, len(words))
                counts.append(len(words))
                held.append(len(words))
                symbols += [s, np.ones(1, np.int32)]
                size += len(words)
                if size >= most_words:
                    results += done(held, symbols)
                    symbols, held, size = [], [], 0
            if held:
                results += done(held, symbols)
            spans = [(a or []) + n for a, (n, _) in zip(b.column(at["_spans"]).to_pylist(), results, strict=True)]
            items = [(a or []) + n for a, (_, n) in zip(b.column(at["_items"]).to_pylist(), results, strict=True)]
            cols = dict(zip(names, b.columns, strict=True))
            cols["_words"] = pa.array(counts, pa.int64())
            if last:
                cols["_text"] = pa.nulls(b.num_rows, pa.string())
            cols["_spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            cols["_items"] = pa.array(items, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)


def _found(docs: DataFrame, keep: list[str], items: DataFrame, size: int, shard: int, most_chars: int) -> DataFrame:
    """(_row, _text, _words, _spans, _items): some columns of a row and what was found in it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("text").alias("_text"), F.lit(0).cast("long").alias("_words"),
                       F.lit(None).cast(_SPANS).alias("_spans"), F.lit(None).cast("array<bigint>").alias("_items"))
    first = True
    for group, last in item_groups(items, most_chars):
        if not first:
            rows = cut_lineage(rows)
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(group, size))
        rows = rows.mapInArrow(partial(_scan, phrases=sent, shard=shard, last=last), rows.schema)
        first = False
    return rows


def leaks(docs: DataFrame, items: DataFrame, size: int = SIZE, shard: int = SHARD, most_chars: int = MOST_CHARS) -> DataFrame:
    """(doc_id, n_words, spans, items): the words of each document that stand in an
    occurrence of a phrase, as merged [start, stop) word spans, and the items (ascending)
    whose phrases occur."""
    found = _found(docs, ["doc_id"], items, size, shard, most_chars)
    return found.select("_row.doc_id", F.col("_words").alias("n_words"), _union("_spans").alias("spans"),
                        F.array_sort(F.coalesce("_items", F.array().cast("array<bigint>"))).alias("items"))


def _union(col: str):
    """Sorted spans as disjoint ones (those of several groups of items may overlap)."""
    spans = F.array_sort(F.coalesce(F.col(col), F.array().cast(_SPANS)))

    def add(acc, x):
        top = F.element_at(acc, -1)
        return (F.when((F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["stop"]),
                       F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["start"].alias("start"), F.greatest(top["stop"], x["stop"]).alias("stop")))))
                .otherwise(F.concat(acc, F.array(x))))
    return F.when(F.size(F.col(col)) > 1, F.aggregate(spans, F.array().cast(_SPANS), add)).otherwise(spans)


def without_leaks(docs: DataFrame, items: DataFrame, size: int = SIZE, shard: int = SHARD, most_chars: int = MOST_CHARS) -> DataFrame:
    """``docs`` with the words of all removal spans cut from the texts; ``n_chars``, if
    there, is counted anew.  A document of nothing else goes; others stay as they are."""
    found = _found(docs, docs.columns, items, size, shard, most_chars)
    kinds = dict(docs.dtypes)

    def cut(batches):
        import re

        import pyarrow as pa

        word = re.compile(rb"[^\x20]+")
        for b in batches:
            row, spans = b.column(0), b.column(1).to_pylist()
            out = []
            for t, s in zip(row.field("text").cast(pa.binary()).to_pylist(), spans, strict=True):
                if s:
                    at, kept, last = [m.span() for m in word.finditer(folded(t))], [], 0
                    for x in sorted(s, key=lambda x: x["start"]):
                        kept.append(t[last:max(at[x["start"]][0], last)])
                        last = max(at[x["stop"] - 1][1], last)
                    t = b"".join([*kept, t[last:]]).strip()
                out.append(t)
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.binary()).cast(pa.string()), pa.array([bool(s) for s in spans])], ["_row", "_text", "_cut"])
    done = found.select("_row", "_spans").mapInArrow(cut, found.select("_row", "_text", F.lit(True).alias("_cut")).schema)
    new = {"text": F.col("_text")}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(F.col("_cut"), F.length("_text").cast(kinds["n_chars"])).otherwise(F.col("_row.n_chars"))
    return done.filter("NOT _cut OR _text <> ''").select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The digest columns of ``leaks``: doc_id, n_words, n_hit, n_items, items_sha256
    (of the ids, sorted as strings, comma-joined; of nothing: of the empty string), contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return (leaks(docs, items, size)
            .select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")))
