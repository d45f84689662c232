"""Registered queries: sinks / loads (K1, S1, S12) and streaming ingest."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ensure_checkpoint_dir, table_path
from ..sources import files as FS
from ..sources import fixtures as FX
from ..streaming import ingest as ST
from . import sinks as K
from . import sqlpipe as SP
from . import sqltext as S

QUERIES = {}
SQL = {}

STOPS = T.stopword_set()


def _reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def scratch(spark, name):
    """A fresh folder under the shared checkpoint dir (never machine-local on a cluster)."""
    return os.path.join(ensure_checkpoint_dir(spark), "postlens-results", f"{name}-{uuid.uuid4().hex[:8]}")


@_reg("sink_roundtrip_posts_csv", """
SELECT CAST(e.user_id AS VARCHAR) AS user_id, e.ts AS timestamp, d.text AS post_content
FROM documents d JOIN events e ON e.event_id = d.doc_id
""")
def q_sink_roundtrip_posts_csv(spark, sf):
    """K1 -> S1: processed posts written as CSV (quotes, newlines) and read back."""
    path = scratch(spark, "posts-csv")
    K.write_posts(FX.posts(spark, sf), path, fmt="csv")
    back = FS.to_posts(FS.read_csv(spark, path), id_col=None)
    return back.select("user_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "post_content")


@_reg("stream_tokens_documents", f"""
WITH t AS (SELECT doc_id, {S.lda_tokens('text', STOPS)} AS tokens FROM documents)
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS token_text
FROM t WHERE len(tokens) >= 3
""")
def q_stream_tokens_documents(spark, sf):
    """Structured Streaming over the documents file: incremental tokenisation
    (availableNow trigger), written per micro-batch and read back."""
    # The table is one file or a folder of files; only a pattern may name either to a stream.
    schema = FX.table(spark, sf, "documents").schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(table_path(sf, "document[s]"))
    from ..operators import clean as C
    stream = C.lda_tokenize(src, text_col="text").select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), T.join_tokens("tokens").alias("token_text"))
    out = scratch(spark, "stream-out")
    q = ST.run_to_table(stream, out, scratch(spark, "stream-ckpt"))
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


ROWS_ONLY = {"clean_chain_pages_demojize"}


@_reg("clean_chain_pages_demojize")
def q_clean_chain_pages_demojize(spark, sf):
    """T9 inside the cleaning chain: emoji -> :name: instead of removal."""
    from ..operators import clean as C
    opts = C.CleanOptions(emoji="demojize")
    return C.clean_chain(FX.table(spark, sf, "pages"), "html", opts).select("page_id", "cleaned_html")


@_reg("drop_counters_posts", f"""
WITH {SP.tokens_ctes()}
SELECT (SELECT COUNT(*) FROM posts) AS posts_in, (SELECT COUNT(*) FROM tok1) AS after_min_tokens,
       (SELECT COUNT(*) FROM tok) AS after_phrases
""")
def q_drop_counters_posts(spark, sf):
    """Rows kept per step, gathered with ``observe`` in a single pass."""
    from ..operators import clean as C
    from ..operators import phrases as P
    posts, o1 = C.observed_counts(FX.posts(spark, sf), "posts_in")
    tok, o2 = C.observed_counts(C.lda_tokenize(posts).drop("post_content"), "after_min_tokens")
    phr = P.learn_phrases(FX.posts(spark, sf).transform(lambda d: C.lda_tokenize(d).drop("post_content")))
    out, o3 = C.observed_counts(P.apply_phrases(tok, phr).filter(F.size("tokens") >= 3), "after_phrases")
    out.write.format("noop").mode("overwrite").save()
    row = (o1.get["posts_in"], o2.get["after_min_tokens"], o3.get["after_phrases"])
    return spark.createDataFrame([row], "posts_in long, after_min_tokens long, after_phrases long")
