"""BPE encoding and decoding over a table of distinct words (operator 5).

1. Words (``units.split_units``) are counted into a table of distinct words;
   a word enters it when one block of texts holds it twice or more.
2. Each word of the table is encoded once.
3. Ids are joined back by position.  The ``hot_words`` most frequent words of at
   most ``HOT_CHARS`` characters form a dictionary of proven size, which is
   broadcast.  The long tail, words of the table's end and those that stand
   once in their block, is encoded where it stands, each distinct word once a
   block: joining it by shuffle moved more than the texts themselves (README).
4. Decoding looks the ids up in the broadcast id-to-piece table (one row per vocabulary
   id, so bounded) and concatenates the pieces in order.

Null text counts as empty and gives no ids.  Rows keep their multiplicity:
repeated rows and null ids each give one row.  Extra columns are ignored.
Words of any length are allowed; a text without spaces is one word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import plain_text
from .units import Encoder, blocks, encode_units, fine_parts, load_tokenizer, parts_finely, piece_table, split_units

HOT_CHARS = 48
#: Distinct words of a block held in a worker before they are handed on.
_FLUSH = 500_000


def word_table(texts: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): distinct words that a block of ``texts.text`` repeats,
    with the count over those blocks and the ids."""
    fine = parts_finely(load_tokenizer(path))

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        def out(units):
            seen = units
            if fine:
                seen = Counter()
                while units:
                    w, n = units.popitem()
                    for x in fine_parts(w):
                        seen[x] += n
            again = [(w, n) for w, n in seen.items() if n > 1 and len(w) <= HOT_CHARS]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in again], pa.string()), pa.array([n for _, n in again], pa.int64())], ["word", "n"])
        seen = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(split_units(t, fine))
                if len(seen) > _FLUSH:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        tok = load_tokenizer(path)
        sizes = np.array([len(x) for x in piece_table(tok)])
        for b in batches:
            ids = encode_units(tok, b.column(0).to_pylist(), sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    words = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(encode, "word string, n long, ids binary")


def hot_dictionary(words: DataFrame, size: int):
    """Arrow table (word, ids) of the ``size`` most frequent words, on the driver: no
    object a word, there or in the workers."""
    return words.orderBy(F.desc("n"), "word").limit(size).select("word", "ids").toArrow().combine_chunks()


def encode_decode(docs: DataFrame, path: str, hot_words: int = 1 << 19, digests: bool = False) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text).

    Returns (doc_id, n_tokens, ids, decoded): ids as little-endian unsigned
    32-bit integers.  With ``digests``, (doc_id, n_tokens, ids_sha256,
    decoded_sha256) instead, so that no text leaves the task.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    hot = spark.sparkContext.broadcast(hot_dictionary(word_table(docs.select("text"), path), hot_words))
    pieces = spark.sparkContext.broadcast(piece_table(load_tokenizer(path)))
    last = ("ids_sha256 string", "decoded_sha256 string") if digests else ("ids binary", "decoded string")

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        enc, table = Encoder(path, hot.value), pieces.value
        for b in batches:
            n, first, second = [], [], []
            for _, texts in blocks(b):
                for ids in enc.ids(texts):
                    n.append(len(ids) // 4)
                    shown = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
                    first.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                    second.append(hashlib.sha256(shown.encode()).hexdigest() if digests else shown)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.binary()), pa.array(second, pa.string())],
                ["doc_id", "n_tokens", *(x.split()[0] for x in last)])

    return docs.mapInArrow(run, ", ".join(("doc_id long, n_tokens long", *last)))
