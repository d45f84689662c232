"""CSV with line breaks inside quoted fields, read by splits.

A file is read as lines, split by split.  Whether a split starts inside a quoted field
depends on all text before it, so the first pass finds, for both possible starts, how
each split ends (one row a split); composing these in file order says how each really
starts.  The second pass joins the lines of each record; a record that crosses a border
leaves one fragment in each split, and only fragments are shuffled.

A quote opens a field only at the field's start; a stray one elsewhere is text.  Line
breaks inside fields come back as ``\\n``.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_CLOSE = re.compile(r'(?:[^"]|"")*"(?!")')
_FIELD = re.compile(r'(?:"(?:[^"]|"")*"(?!")[^,]*|(?!")[^,]*)(?:,|$)')


def ends_inside(line: str, inside: bool) -> bool:
    """Is a quoted field open after ``line``, if one is (or is not) before it?"""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        closed = _CLOSE.match(line)
        if not closed:
            return True
        at = line.find(",", closed.end())
        if at < 0:
            return False
        at += 1
    while at < len(line):
        field = _FIELD.match(line, at)
        if not field:
            return True
        at = field.end()
    return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _walk(batches):
    """(file, split, lines) of the splits of a task, in order, batch by batch."""
    import itertools

    for b in batches:
        rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
        for (file, split), group in itertools.groupby(rows, key=lambda r: (r[1], r[2])):
            yield file, split, [r[0] for r in group]


def _ends(batches, heads: dict, skip: int):
    """One row a split: its lines, and how it ends from either start."""
    import pyarrow as pa

    done: dict = {}
    for file, split, lines in _walk(batches):
        n, out, inside = done.get((file, split), (heads.get((file, split), skip), False, True))
        for line in lines:
            if n >= skip:
                out, inside = ends_inside(line, out), ends_inside(line, inside)
            n += 1
        done[file, split] = n, out, inside
    rows = [(f, s, n - heads.get((f, s), skip), o, i) for (f, s), (n, o, i) in done.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
        zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], ["file", "split", "lines", "out", "inside"])


def _records(batches, odd: set, heads: dict, skip: int, most: int = 10_000):
    """(file, split, part, first, text): whole records (part 0) and, in file order within a
    split, the end of one begun before (1), a piece of one (2), the start of one (3)."""
    import pyarrow as pa

    rows = []
    now, buf, inside, early, n, first = None, [], False, False, 0, False

    def batch():
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["file", "split", "part", "first", "text"])
        rows.clear()
        return out

    def close(part):
        nonlocal first
        rows.append((*now, part, first, "\n".join(buf)))
        buf.clear()
        first = False
    for file, split, lines in _walk(batches):
        if now != (file, split):
            if buf:
                close(2 if early else 3)
            now = file, split
            inside = early = now in odd
            n, first = heads.get(now, skip), split == 0
        for line in lines:
            n += 1
            if n <= skip:
                continue
            buf.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                close(1 if early else 0)
                early = False
        if len(rows) >= most:
            yield batch()
    if buf:
        close(2 if early else 3)
    yield batch()


def csv_records(spark: SparkSession, path: str, skip_lines: int = 0) -> DataFrame:
    """``(first, text)``: the records of all files, without the first ``skip_lines`` lines of
    each; ``first`` marks the record at a file's very start (its header).

    The driver holds the splits that start inside a field, and for ``skip_lines`` the
    first splits of each file.
    """
    lines = _lines(spark, path)
    heads: dict = {}
    if skip_lines:
        order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        counts = lines.groupBy("file", "split").agg(F.count("*").alias("n"))
        before = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("before") < skip_lines)
        heads = {(r.file, r.split): r.before for r in before.collect()}
    ends = lines.mapInArrow(partial(_ends, heads=heads, skip=skip_lines), "file string, split long, lines long, out boolean, inside boolean")
    # How each split starts: fold the splits of a file in order (one small row each).
    files = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("split", "out", "inside"))).alias("s"))
    start = F.struct(F.lit(False).alias("now"), F.array().cast("array<bigint>").alias("odd"))
    fold = F.aggregate("s", start, lambda a, x: F.struct(F.when(a["now"], x["inside"]).otherwise(x["out"]).alias("now"),
                                                         F.when(a["now"], F.concat(a["odd"], F.array(x["split"]))).otherwise(a["odd"]).alias("odd")))
    odd = {(r.file, r.split) for r in files.select("file", F.explode(fold["odd"]).alias("split")).collect()}
    rows = lines.mapInArrow(partial(_records, odd=odd, heads=heads, skip=skip_lines), "file string, split long, part int, first boolean, text string")
    order = Window.partitionBy("file").orderBy("split", "part")          # at most two fragments a split
    pieces = rows.filter("part > 0").withColumn("record", F.sum((F.col("part") == 3).cast("int")).over(order))
    joined = pieces.groupBy("file", "record").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("split", "part", "text"))).alias("t"))
    joined = joined.select("first", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
    return rows.filter("part = 0").select("first", "text").unionByName(joined)
