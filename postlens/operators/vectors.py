"""Document vectors for every document (M5), without a language model.

``hashed_tfidf`` folds TF-IDF weights into a fixed number of slots by a signed hash of
the term (feature hashing): inner products keep their expectation, a document's vector
is bounded by ``dims``, and no vocabulary is needed.  ``plugged`` runs any encoder of
the caller on Arrow batches instead.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..session import written
from .clean import fence, once
from .lda import sparse_vector
from .vocab import doc_terms, document_frequency


def hashed_tfidf(docs: DataFrame, dims: int = 256, key: str = "doc_id", text_col: str = "processed_text", stopwords=None) -> DataFrame:
    """``(key, slots ARRAY<INT>, values ARRAY<DOUBLE>)``, one row a document: slots ascending,
    values of length 1 together; a document without terms has empty arrays.

    Terms are runs of two or more word characters, in lower case, without stop words;
    weight tf * (ln((1 + n) / (1 + df)) + 1).  The first 32 bits h of a term's MD5 give its
    slot h mod dims and its sign (odd h div dims: minus).
    """
    stops = sorted(set(stopwords if stopwords is not None else T.ENGLISH_STOPWORDS))
    toks = fence(docs.select(key, T.drop_stopwords(T.tokenize_words(F.lower(F.col(text_col)), 2), stops).alias("tokens")), "tokens")
    n = docs.agg(F.count("*").cast("double")).scalar()
    terms = written(doc_terms(toks, key))
    h = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    idf = document_frequency(terms, key).select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"),
                                                (h % dims).cast("int").alias("slot"), (1 - 2 * (F.floor(h / dims) % 2)).alias("sign"))
    parts = terms.join(idf, "term").groupBy(key, "slot").agg(F.sum(F.col("tf") * F.col("idf") * F.col("sign")).alias("v"))
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", "v"))).alias("e"))      # at most dims entries
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))
    rows = once(rows, norm=norm)                # not anew for each entry
    unit = F.transform("e", lambda x: F.when(F.col("norm") > 0, x["v"] / F.col("norm")).otherwise(0.0))
    rows = rows.select(key, F.transform("e", lambda x: x["slot"]).alias("slots"), unit.alias("values"))
    return (docs.select(key).distinct().join(rows, key, "left")
            .select(key, F.coalesce("slots", F.array().cast("array<int>")).alias("slots"), F.coalesce("values", F.array().cast("array<double>")).alias("values")))


def features(hashed: DataFrame, dims: int = 256, key: str = "doc_id") -> DataFrame:
    """``(key, embedding)``: ``hashed_tfidf`` rows as vectors for ``spark.ml``."""
    return hashed.select(key, sparse_vector(F.lit(dims), F.col("slots"), F.col("values")).alias("embedding"))


def plugged(docs: DataFrame, encode: Callable, key: str = "doc_id", text_col: str = "processed_text") -> DataFrame:
    """``(key, embedding ARRAY<DOUBLE>)`` by the caller's ``encode(list of texts) -> list of
    vectors``, called on the batches of a task (so a model is loaded once a worker if
    ``encode`` keeps it)."""
    def run(batches):
        for b in batches:
            vectors = encode(b["text"].fillna("").tolist())
            yield pd.DataFrame({key: b[key], "embedding": [[float(x) for x in v] for v in vectors]})
    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text_col).alias("text")).mapInPandas(run, f"`{key}` {kind}, embedding array<double>")
