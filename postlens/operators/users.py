"""User topic distributions and narrowness scores.

Inputs follow the long-first contract:
* ``docs(doc_id, user_id, ...)``
* ``doc_topics(doc_id, probs ARRAY<DOUBLE>)`` - all k entries per document.

Every aggregation is ``groupBy`` with map-side partial aggregation, so a
user holding a third of all documents is summed in parallel before the
shuffle; per-user vectors are bounded by k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import metrics as M
from ..functions.timebins import time_bin


def doc_topics_long(doc_topics: DataFrame, *keep: str) -> DataFrame:
    """``(doc_id, probs[])`` -> ``(doc_id, topic_id, prob)``, with the columns ``keep``."""
    return doc_topics.select("doc_id", *keep, F.posexplode("probs").alias("topic_id", "prob"))


def _dense(entries_col: str, k: int):
    # The map is a lambda's argument, so that it is made once and not for each topic.
    return F.get(F.transform(F.array(F.map_from_entries(F.col(entries_col))), lambda m: F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))), F.lit(0))


def user_topics(doc_topics: DataFrame, docs: DataFrame, k: int,
                keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Element-wise mean of document vectors per ``keys``.

    Returns ``keys + (n_docs, probs ARRAY<DOUBLE>)``.
    """
    j = doc_topics_long(doc_topics.join(docs.select("doc_id", *keys), "doc_id"), *keys)   # one row a document until joined
    per_topic = j.groupBy(*keys, "topic_id").agg(F.sum("prob").alias("s"), F.count("*").alias("n"))
    vec = per_topic.groupBy(*keys).agg(
        F.max("n").alias("n_docs"),
        F.collect_list(F.struct(F.col("topic_id").cast("int"), (F.col("s") / F.col("n")).alias("p"))).alias("_e"))
    return vec.select(*keys, "n_docs", _dense("_e", k).alias("probs"))


def user_scores(user_vec: DataFrame, docs: DataFrame | None = None,
                posts: DataFrame | None = None) -> DataFrame:
    """A2 - A6 + F9: one row per user.

    ``post_count`` counts documents (user-bins in combine mode), as the
    reference does; ``raw_post_count`` counts posts when ``posts`` is given.
    """
    out = user_vec.select(
        "user_id",
        F.col("n_docs").cast("long").alias("post_count"),
        M.gini("probs").alias("gini_coefficient"),
        M.entropy_bits("probs").alias("shannon_entropy"),
        M.top_n_ratio("probs", 1).alias("top1_ratio"),
        M.top_n_ratio("probs", 2).alias("top2_ratio"),
        M.first_argmax("probs").alias("dominant_topic"),
        "probs",
    )
    if docs is not None:
        cnt = docs.groupBy("user_id").agg(F.count("*").cast("long").alias("_dc"))
        out = out.join(cnt, "user_id", "left").withColumn(
            "post_count", F.coalesce("_dc", F.lit(0)).cast("long")).drop("_dc")
    if posts is not None:
        pc = posts.groupBy("user_id").agg(F.count("*").cast("long").alias("raw_post_count"))
        out = out.join(pc, "user_id", "left")
    return out


def sort_scores(scores: DataFrame) -> DataFrame:
    """A6 order: Gini descending, undefined last."""
    return scores.orderBy(F.col("gini_coefficient").desc_nulls_last(), "user_id")


def user_temporal(doc_topics: DataFrame, docs: DataFrame, k: int, tb: str = "week",
                  week_anchor: str = "tuesday", bin_col: str | None = None) -> DataFrame:
    """Mean vector per user x time bin, long form ``(user_id, time_bin, topic_id, prob)``.

    ``bin_col`` reuses a bin already on ``docs`` (combine mode); otherwise
    each document's ``ts`` is binned (W-MON weeks by default, as the
    reference's temporal step does).
    """
    d = docs if bin_col else docs.withColumn("time_bin", time_bin("ts", tb, week_anchor))
    if bin_col and bin_col != "time_bin":
        d = d.withColumnRenamed(bin_col, "time_bin")
    d = d.filter(F.col("time_bin").isNotNull())
    vec = user_topics(doc_topics, d, k, keys=("user_id", "time_bin"))
    return vec.select("user_id", "time_bin", F.posexplode("probs").alias("topic_id", "prob"))


def dominant_topic_counts(doc_topics: DataFrame, docs: DataFrame, k: int,
                          by_date: bool = False) -> DataFrame:
    """Number of documents per user (x date) whose arg-max is each topic,
    zero-filled over all k topics. Long form ``(user_id[, date], topic_id, n)``."""
    keys = ["user_id"] + (["date"] if by_date else [])
    d = docs.withColumn("date", F.to_date("ts")) if by_date else docs
    dom = doc_topics.select("doc_id", M.first_argmax("probs").alias("dominant_topic"))
    j = dom.join(d.select("doc_id", *keys), "doc_id")
    c = j.groupBy(*keys, "dominant_topic").agg(F.count("*").alias("n"))
    vec = c.groupBy(*keys).agg(F.collect_list(F.struct(F.col("dominant_topic").cast("int"),
                                                       F.col("n").cast("double"))).alias("_e"))
    return vec.select(*keys, F.posexplode(_dense("_e", k)).alias("topic_id", "n")) \
              .withColumn("n", F.col("n").cast("long"))


def dataset_summary(posts: DataFrame) -> DataFrame:
    """Users, posts, average posts per user, first / last date."""
    return posts.agg(
        F.countDistinct("user_id").alias("num_users"),
        F.count("*").alias("num_posts"),
        (F.count("*") / F.countDistinct("user_id")).alias("avg_posts_per_user"),
        F.to_date(F.min("timestamp")).alias("first_date"),
        F.to_date(F.max("timestamp")).alias("last_date"),
    )
