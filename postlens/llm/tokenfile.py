"""Token-id files in Arrow's IPC file format (operator 8).

Every file holds whole documents of one ascending doc_id range: their ids, each
document followed by the end id, packed into sequences of equal length

    ids:  fixed_size_list<uint16 or uint32>[length]
    mask: fixed_size_list<bool>[length]   true where an id stands; the file's
                                          last sequence is padded
    doc_id: list<int64>, at: list<int32>  documents that begin in the sequence

in record batches of ``BATCH`` sequences.  Buffers are not compressed, so a
mapped file gives any sequence and its mask without a copy (``TokenFile``).
Files end after the first document with which they hold ``file_tokens`` ids or
more: bounded by that and one document.

Files are written by Spark's own text writer, one record a file, so its commit
protocol covers lost executors and any Hadoop path: the record is the file but
its last six bytes, and the line separator is those bytes, Arrow's closing magic.

Null text counts as empty (the end id alone).  Null ids come first; repeated
rows keep their multiplicity and stand side by side.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import cut_lineage, plain_text
from .units import Encoder, blocks

#: Arrow's closing magic (fixed value).
MAGIC = "ARROW1"
BATCH = 128


class TokenFile:
    """Random access to a file's bytes (or memory map)."""

    def __init__(self, buffer):
        import pyarrow as pa

        self.reader = pa.ipc.open_file(pa.BufferReader(buffer))
        meta = self.reader.schema.metadata
        self.part, self.number, self.tokens = (int(meta[k]) for k in (b"part", b"number", b"tokens"))
        self.length = self.reader.schema.field("ids").type.list_size
        self._batches: dict = {}

    def batch(self, i: int):
        if i not in self._batches:
            self._batches[i] = self.reader.get_batch(i)
        return self._batches[i]

    def sequence(self, i: int):
        """(ids, mask) of sequence i; ids are a view of the file's buffer."""
        b, at = self.batch(i // BATCH), i % BATCH * self.length
        return b.column("ids").values.to_numpy(zero_copy_only=True)[at:at + self.length], b.column("mask").values.slice(at, self.length)

    def documents(self):
        """(doc_id, start in this file, ids) of each document in order."""
        import numpy as np

        batches = [self.batch(i) for i in range(self.reader.num_record_batches)]
        ids = np.concatenate([b.column("ids").values.to_numpy(zero_copy_only=True) for b in batches])
        docs = [d for b in batches for d in b.column("doc_id").values.to_pylist()]
        counts = np.concatenate([b.column("doc_id").value_lengths().to_numpy() for b in batches])
        at = np.concatenate([b.column("at").values.to_numpy() for b in batches]) + np.repeat(np.arange(len(counts)) * self.length, counts)
        ends = [*at[1:].tolist(), self.tokens]
        return [(d, s, ids[s:e]) for d, s, e in zip(docs, at.tolist(), ends, strict=True)]


def file_bytes(docs: list, ids, part: int, number: int, length: int, dtype: str) -> bytes:
    """One file: ``docs`` as (doc_id, start), ``ids`` a flat array."""
    import numpy as np
    import pyarrow as pa

    n = -(-len(ids) // length)
    flat = np.zeros(n * length, dtype)
    flat[:len(ids)] = ids
    mask = np.arange(n * length) < len(ids)
    starts = np.array([s for _, s in docs], np.int64)
    cuts = np.searchsorted(starts, np.arange(n + 1) * length).astype(np.int32)
    columns = [
        pa.FixedSizeListArray.from_arrays(pa.array(flat), length),
        pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
        pa.ListArray.from_arrays(pa.array(cuts), pa.array([d for d, _ in docs], pa.int64())),
        pa.ListArray.from_arrays(pa.array(cuts), pa.array((starts % length).astype(np.int32))),
    ]
    whole = pa.Table.from_arrays(columns, ["ids", "mask", "doc_id", "at"]).replace_schema_metadata(
        {"part": str(part), "number": str(number), "tokens": str(len(ids))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, whole.schema) as w:
        for i in range(0, n, BATCH):  # combined, so that a batch holds no more than its own rows
            w.write_table(whole.slice(i, BATCH).combine_chunks())
    return sink.getvalue().to_pybytes()


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, length: int = 2048, file_tokens: int = 1 << 21) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write the files."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, number = Encoder(path), TaskContext.get().partitionId(), 0
        dtype = "<u2" if max(len(enc.sizes), end_id + 1) <= 1 << 16 else "<u4"
        held, parts, tokens = [], [], 0
        end = np.array([end_id], dtype)

        def out():
            data = file_bytes(held, np.concatenate(parts), part, number, length, dtype)
            return pa.RecordBatch.from_arrays([pa.array([data[:-len(MAGIC)]], pa.binary())], ["value"])
        for b in batches:
            for docs, texts in blocks(b):
                for d, raw in zip(docs, enc.ids(texts), strict=True):
                    held.append((d, tokens))
                    parts += [np.frombuffer(raw, "<u4").astype(dtype), end]
                    tokens += len(raw) // 4 + 1
                    if tokens >= file_tokens:
                        yield out()
                        held, parts, tokens, number = [], [], 0, number + 1
        if held:
            yield out()

    (rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", MAGIC).option("maxRecordsPerFile", 1).option("compression", "none").text(folder))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part) of every document, from the files."""
    files = spark.read.format("binaryFile").load(folder).filter(F.col("length") > len(MAGIC)).select("content")

    def run(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            for raw in b.column(0):
                f = TokenFile(raw.as_buffer())
                got = f.documents()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _, _ in got], pa.int64()), pa.array([s for _, s, _ in got], pa.int64()),
                     pa.array([len(x) for _, _, x in got], pa.int64()),
                     pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, _, x in got], pa.int64()),
                     pa.array([f.part] * len(got), pa.int64()), pa.array([f.number] * len(got), pa.int64())],
                    ["doc_id", "at", "n_tokens", "ids_crc32", "part", "number"])

    rows = cut_lineage(files.mapInArrow(run, "doc_id long, at long, n_tokens long, ids_crc32 long, part long, number long"))
    files = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    # Ids before a file: files of its partition before it, then whole partitions
    # before that (one row a partition, so the last window is small).
    inner = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    outer = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("whole"))
    base = (files.select("part", "number", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("before"))
            .join(parts, "part").select("part", "number", (F.col("before") + F.col("whole")).alias("base")))
    return rows.join(base, ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write the files of ``docs`` and read them back (``read_tokens``)."""
    write_tokens(docs, path, folder, end_id)
    return read_tokens(docs.sparkSession, folder)
