"""Audit of how filters interact, by path counting on the subset lattice (operator 13).

A state is the set of filters applied so far; an edge adds one filter.  The rows
that fail a filter and none of the state before it are the edge's removals, so a
table of failure patterns (one row a part and pattern) gives all edges at once.

* forward(S): orders that reach S from the empty set; backward(S): orders that
  leave S for the full set; both by one pass over the states.
* An edge lies on forward(S) * backward(S + f) orders: so weighted, its removals add
  up to a filter's Shapley total.
* Step k of an order is the edge from its first k - 1 filters, so each order's steps
  are read from the same edges.

Only DataFrame functions touch the rows.  Equal texts are found by SHA-256.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, plain_text

#: The filters of the query in the order of their bits; E is the one across rows.
NAMES = "ABCDE"
_BLANKS = r"[\x20\x09-\x0D]+"


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, bit, paths) of each edge: ``paths`` of the n! orders take it."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for s in range(full + 1):            # a subset has a smaller number than its supersets
        for b in range(n):
            if not s >> b & 1:
                forward[s | 1 << b] += forward[s]
    for s in range(full, -1, -1):
        for b in range(n):
            if not s >> b & 1:
                backward[s] += backward[s | 1 << b]
    return [(s, b, forward[s] * backward[s | 1 << b]) for s in range(full + 1) for b in range(n) if not s >> b & 1]


def edges(patterns: DataFrame, n: int, lost: tuple[str, ...] = ()) -> DataFrame:
    """(part, state, bit, paths, arriving, removed, <lost>...) for every part and edge.

    ``patterns``: (part, failed, n, <lost>...), where bit b of ``failed`` is set if the
    rows fail filter b, ``n`` counts them and each ``lost`` column counts some of them.
    At most 2^n rows a part reach the grouping from each task.
    """
    every = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(b).alias("bit"), F.lit(p).cast("long").alias("paths")) for s, b, p in lattice(n)])
    rows = patterns.select("part", "failed", "n", *lost, F.explode(every).alias("e")).select("*", "e.*")
    arrives = F.col("failed").bitwiseAND(F.col("state")) == 0
    fails = F.expr("shiftright(failed, bit) & 1") == 1

    def total(when: Column, col: str) -> Column:
        return F.sum(F.when(when, F.col(col)).otherwise(0))
    return rows.groupBy("part", "state", "bit", "paths").agg(
        total(arrives, "n").alias("arriving"), total(arrives & fails, "n").alias("removed"),
        *[total(arrives & fails, c).alias(c) for c in lost])


def order_steps(found: DataFrame, names: str, lost: tuple[str, ...] = ()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <lost>...,
    shapley): every order of the filters and each of its steps, read from ``edges``."""
    n = len(names)
    full = (1 << n) - 1
    table = [("".join(names[b] for b in order), k + 1, sum(1 << b for b in order[:k]), b)
             for order in permutations(range(n)) for k, b in enumerate(order)]
    steps = found.sparkSession.createDataFrame(table, "filter_order string, step int, state int, bit int")   # n * n! rows
    whole = found.groupBy("part", "bit").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("state") == F.lit(full) - F.expr("shiftleft(1, bit)"), F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("paths") * F.col("removed")).alias("shapley"))
    return (found.join(whole, ["part", "bit"]).join(F.broadcast(steps), ["state", "bit"])
            .select("part", "filter_order", "step", (F.col("arriving") - F.col("removed")).alias("kept"), "removed",
                    (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley"))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, failed): which of the filters A to D each text fails."""
    text = plain_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       text.alias("text"), F.array_remove(F.split(text, _BLANKS), "").alias("words"))
    words = F.size("words").cast("long")
    bits = [words < 50,
            100 * F.size(F.array_distinct("words")).cast("long") < 65 * words,
            100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 5 * F.length("text").cast("long"),
            F.col("text").rlike("[#$%&*|]")]
    failed = sum((F.when(b, F.lit(1 << i)).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed.cast("int").alias("failed"))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good_lost, toxic_lost): rows by failure pattern, and how many
    of them are labelled quality = 1 and toxic = 1.

    Repeated rows are folded first.  A text's first document is joined by (text, id) and
    the labels by id, so no group of copies comes together in one task.  A row without an
    id is no copy of another and has no label; several labels of an id count if any is 1.
    """
    rows = cut_lineage(failures(docs).groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n")))
    known = rows.filter("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL")
             .groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic")))
    known = (known.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
             .select("part", (F.col("failed") + F.when(F.col("first"), 0).otherwise(16)).alias("failed"), "n",
                     F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    nameless = rows.filter("doc_id IS NULL").select("part", "failed", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good_lost"), F.sum(F.col("n") * F.col("toxic")).alias("toxic_lost"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``order_steps`` of the five filters over all documents, by source.

    Null text: empty; null source: ''.  An empty table has no parts, so no rows.
    """
    lost = ("good_lost", "toxic_lost")
    return order_steps(cut_lineage(edges(patterns(docs, labels), len(NAMES), lost)), NAMES, lost)
