"""Dictionary, document frequency, bag of words, TF-IDF (V5 - V8).

All in long form ``(doc_id, term, tf)``: counting is ``groupBy`` with
map-side partial aggregation, so a document (or term) holding a third of
all tokens is pre-aggregated on every executor before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..session import cut_lineage, written
from .clean import fence


def doc_terms(tokens: DataFrame, key: str = "doc_id", col: str = "tokens") -> DataFrame:
    """V7 (long form): ``(key, term, tf)``."""
    return (tokens.select(key, F.explode(col).alias("term"))
                  .groupBy(key, "term").agg(F.count("*").alias("tf")))


def document_frequency(dterms: DataFrame, key: str = "doc_id") -> DataFrame:
    """V5: ``(term, df)`` = number of documents containing the term."""
    return dterms.groupBy("term").agg(F.count(key).alias("df"))


def filter_extremes(dfreq: DataFrame, n_docs, no_below: int = 3, no_above: float = 0.6,
                    keep_n: int | None = None) -> DataFrame:
    """V6: keep ``no_below <= df <= int(no_above * N)``, then the ``keep_n``
    most frequent (df desc, term asc), indexed 0..n-1 in that order.

    ``keep_n`` is off unless asked for.  Terms are dealt by ranges of that order
    and numbered range by range, so no task sees the whole vocabulary.
    """
    no_above_abs = F.floor(F.lit(no_above) * n_docs)   # n_docs: int or scalar-subquery Column
    kept = dfreq.filter((F.col("df") >= no_below) & (F.col("df") <= no_above_abs))
    order = [F.col("df").desc(), F.col("term")]
    if keep_n is not None:
        kept = kept.orderBy(*order).limit(keep_n)
    kept = written(kept)                       # dealing by ranges reads it twice
    ranged = cut_lineage(kept.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)   # one row a range
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_part").orderBy(*order)
    return (ranged.join(parts, "_part")
            .withColumn("term_index", (F.col("_base") + F.row_number().over(inner) - 1).cast("int"))
            .drop("_part", "_base"))


def bag_of_words(dterms: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """V7 + F6: ``(key, term, term_index, tf)``; documents left without a
    vocabulary term simply have no rows (inner join), ids are not renumbered."""
    return dterms.join(vocab.select("term", "term_index"), "term")


def tfidf(docs: DataFrame, key: str = "doc_id", text_col: str = "text",
          max_df: float = 0.95, min_df: int = 2) -> DataFrame:
    """V8: ``TfidfVectorizer(max_df, min_df, lowercase=False)`` semantics.

    Tokens are runs of >= 2 word characters; idf = ln((1+n)/(1+df)) + 1;
    weights L2-normalised per document. Returns ``(key, term, weight)``.
    """
    n = docs.agg(F.count("*").cast("double")).scalar()
    toks = fence(docs.select(key, T.tokenize_words(text_col, 2).alias("tokens")), "tokens")
    dt = written(doc_terms(toks, key))         # read for df, weights and norms: the texts only once
    dfreq = document_frequency(dt, key)
    keep = dfreq.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    w = dt.join(keep, "term").withColumn(
        "w", F.col("tf") * (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0))
    # One shuffle by key for norms and weights; rows without a key have no document.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.filter(F.col(key).isNotNull()).select(key, "term", (F.col("w") / norm).alias("weight"))
