"""Repeated passages by a sparse suffix array (operator 6).

1. Suffixes are kept at minimiser positions only.  With windows of ``window``
   positions, a passage of ``min_words`` words holds one whose next
   ``depth = min_words - window + 1`` words lie in it.
2. Suffixes are ordered by the name of their first ``depth`` words, so that
   equal prefixes are neighbours; each stands with its run's first suffix
   (smallest doc_id, then position).
3. Agreements on one diagonal that overlap are one match; a match is extended
   word by word to the left and to the right, as far as both texts agree.
4. A passage of ``min_words`` whose suffix lies in a match but which leaves it stands
   less than ``window`` words over one of its edges, and all its places leave the
   matches of their texts at the same word.  So the runs of ``min_words`` words over
   the edges of all matches are named whole, and equal ones stand with their first.

Every run of ``min_words`` words or more that stands in two places is found, and
all that is reported stands in two places and has ``depth`` words at least.

Words are compared with A-Z in lower case.  Null or short texts hold nothing; rows
with a null doc_id take no part; rows that share a doc_id are compared by their
greatest text.  A match within one text counts unless it overlaps itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import counted_anew, cut_lineage, plain_text, unused
from .seeds import contexts, shared_seeds
from .shingles import WordHashes, windows

MIN_WORDS, WINDOW, ORDER = 50, 9, 5


def _matches(docs: DataFrame, min_words: int, window: int) -> DataFrame:
    """(doc_id, start, stop, first_doc, first_start, many): overlapping agreements
    merged; ``many`` if a suffix of them stands in three places or more.  Those that
    overlap themselves are kept, for their edges."""
    depth = min_words - window + 1
    rows = shared_seeds(docs, depth, ORDER, window)
    rows = rows.select("doc_id", "pos", "first_doc", (F.col("pos") - F.col("first_pos")).alias("diagonal"), "many")
    w = W.partitionBy("doc_id", "first_doc", "diagonal").orderBy("pos")
    fresh = F.coalesce(F.col("pos") > F.lag("pos").over(w) + depth, F.lit(True)).cast("int")
    return (rows.withColumn("fresh", fresh).withColumn("match", F.sum("fresh").over(w))
            .groupBy("doc_id", "first_doc", "diagonal", "match").agg(F.min("pos").alias("start"), (F.max("pos") + depth).alias("stop"), F.max("many").alias("many"))
            .select("doc_id", "start", "stop", "first_doc", (F.col("start") - F.col("diagonal")).alias("first_start"), "many"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, stop, first_doc, first_start, first_stop): words [start, stop)
    of a document stand before in words [first_start, first_stop) of ``first_doc``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text")).filter("doc_id IS NOT NULL")
    depth = min_words - window + 1
    found = cut_lineage(_matches(docs, min_words, window))

    def asks(doc: str, start, own) -> DataFrame:
        stop = start + F.col("stop") - F.col("start")
        place = F.array(F.struct(start.alias("at"), F.lit(True).alias("before"), own.alias("runs")), F.struct(stop.alias("at"), F.lit(False).alias("before"), own.alias("runs")))
        return found.select(F.col(doc).alias("doc_id"), F.explode(place).alias("at"))
    ends = asks("doc_id", F.col("start"), F.col("many")).union(asks("first_doc", F.col("first_start"), F.lit(False)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                out = [[], [], [], [], []]
                for i, t, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    h = hashes.of(t)
                    w, runs = h.view(np.int64).tolist(), None
                    for x in places:
                        p, names = x["at"], None
                        if x["runs"]:
                            runs = windows(h, min_words).view(np.int64).tolist() if runs is None else runs
                            low = p - window + 1 if x["before"] else p - min_words + 1
                            names = [runs[s] if 0 <= s < len(runs) else None for s in range(low, low + window - 1)]
                        for o, v in zip(out, (i, p, x["before"], w[max(p - window, 0):p][::-1] if x["before"] else w[p:p + window], names), strict=True):
                            o.append(v)
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["doc_id", "at", "before", "words", "runs"])
    around = cut_lineage(contexts(docs, ends, run, "doc_id long, at int, before boolean, words array<long>, runs array<long>")
                         .groupBy("doc_id", "at", "before").agg(F.max(F.struct("words", "runs")).alias("c")))

    def side(rows: DataFrame, doc: str, at, name: str, before: bool) -> DataFrame:
        c = around.filter(F.col("before") == before).select(F.col("doc_id").alias("cd"), F.col("at").alias("ca"), F.col("c").alias(name))
        return rows.join(c, (F.col(doc) == F.col("cd")) & (at == F.col("ca"))).drop("cd", "ca")
    first_stop = F.col("first_start") + F.col("stop") - F.col("start")
    for doc, at, name, before in (("doc_id", F.col("start"), "l1", True), ("first_doc", F.col("first_start"), "l2", True),
                                  ("doc_id", F.col("stop"), "r1", False), ("first_doc", first_stop, "r2", False)):
        found = side(found, doc, at, name, before)

    def agree(a: str, b: str):
        same = F.zip_with(f"{a}.words", f"{b}.words", lambda x, y: F.coalesce(x == y, F.lit(False)))
        stop = F.array_position(same, F.lit(False))
        return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")
    found = cut_lineage(found.select("doc_id", "start", "stop", "first_doc", "first_start", first_stop.alias("first_stop"), "many",
                                     agree("l1", "l2").alias("grow_l"), agree("r1", "r2").alias("grow_r"), F.col("l1.runs").alias("runs_l"), F.col("r1.runs").alias("runs_r")))
    whole = (found.filter(f"doc_id <> first_doc OR start >= first_start + {depth}")
             .select("doc_id", (F.col("start") - F.col("grow_l")).alias("start"), (F.col("stop") + F.col("grow_r")).alias("stop"),
                     "first_doc", (F.col("first_start") - F.col("grow_l")).alias("first_start"), (F.col("first_stop") + F.col("grow_r")).alias("first_stop")))
    return whole.union(_over_edges(found.filter("many"), min_words, window)).distinct()


def _over_edges(found: DataFrame, min_words: int, window: int) -> DataFrame:
    """Rows as of ``repeats``: runs of ``min_words`` words over an edge of a match, each
    with the run's first place among them."""
    def runs(names: str, low, over) -> DataFrame:
        return (found.select("doc_id", low.alias("low"), over.alias("over"), F.posexplode(names).alias("i", "run"))
                .filter("run IS NOT NULL").filter("over[0] <= i AND i < over[1]").select("run", "doc_id", (F.col("low") + F.col("i")).alias("start")))
    none, most = F.lit(0), F.lit(window - 1)
    left = runs("runs_l", F.col("start") - window + 1, F.array(none, most - F.col("grow_l")))
    right = runs("runs_r", F.col("stop") - min_words + 1, F.array(F.col("grow_r"), most))
    rows = cut_lineage(left.union(right).distinct())
    first = (rows.groupBy("run").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("c")).filter("c > 1")
             .select("run", F.col("f.doc_id").alias("first_doc"), F.col("f.start").alias("first_start")))
    return (rows.join(first, "run").filter(f"doc_id <> first_doc OR start >= first_start + {min_words}")
            .select("doc_id", "start", (F.col("start") + min_words).alias("stop"), "first_doc", "first_start", (F.col("first_start") + min_words).alias("first_stop")))


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, start, stop): the union of (doc_id, start, stop) as disjoint spans."""
    w = W.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > before, F.lit(True)).cast("int")
    return (spans.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(w))
            .groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("span"))


def passages(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, stop, removed): the repeated words of each document as
    disjoint spans; ``removed`` ones stand before in the order of ids and
    positions, the others are the first occurrence of a passage."""
    found = cut_lineage(repeats(docs, min_words, window))
    again = merged_spans(found.select("doc_id", "start", "stop")).withColumn("removed", F.lit(True))
    first = merged_spans(found.select(F.col("first_doc").alias("doc_id"), F.col("first_start").alias("start"), F.col("first_stop").alias("stop")).distinct())
    return again.unionByName(first.withColumn("removed", F.lit(False)))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that stand before elsewhere; ``n_chars`` is
    counted anew.  A document of nothing else goes; texts without repeats stay
    as they are."""
    spans = merged_spans(repeats(docs, min_words, window).select("doc_id", "start", "stop"))
    own, at = unused(docs, "_id", "_spans")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias(at)).withColumnRenamed("doc_id", own)

    def cut(texts, spans):
        import re

        import pandas as pd

        word = re.compile(r"[^\x20\x09-\x0D]+")
        out = []
        for t, s in zip(texts, spans, strict=True):
            if s is None or t is None:
                out.append(t)
                continue
            at = [m.span() for m in word.finditer(t)]
            kept, last = [], 0
            for x in sorted(s, key=lambda x: x["start"]):
                if x["start"] < len(at):
                    kept.append(t[last:at[x["start"]][0]])
                    last = at[min(x["stop"], len(at)) - 1][1]
            out.append("".join([*kept, t[last:]]).strip())
        return pd.Series(out, dtype=object)
    import pandas as pd

    cut.__annotations__ = {"texts": pd.Series, "spans": pd.Series, "return": pd.Series}
    out = docs.join(spans, F.col("doc_id") == F.col(own), "left")
    out = out.withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(F.pandas_udf(cut, "string")("text", at)))
    out = out.filter(F.col(at).isNull() | (F.col("text") != ""))
    return counted_anew(out, F.col(at).isNotNull()).select(*docs.columns)
