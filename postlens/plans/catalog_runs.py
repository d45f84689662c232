"""Registered queries: saved results read back (K2 - K8, S12), one-call runs (A20) and the
comparison of two fitted models (A19, J6, F12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as CP
from ..operators import embed_topics as E
from ..operators import feeds as FD
from ..operators import lda as L
from ..sources import fixtures as FX
from . import catalog_embed, catalog_suspicion, catalog_topics, catalog_users, runs
from .catalog_io import scratch
from .common import rounded

QUERIES = {}
SQL = {}
ROWS_ONLY = {"run_lda_saved_summary", "run_embedding_saved_summary", "compare_fitted_topics", "topics_per_model", "lda_coherence_bands"}


def _reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _saved(spark, name, df):
    out = scratch(spark, "results")
    runs.save({name: df}, out)
    return runs.load(spark, out, name)


@_reg("saved_temporal_events", catalog_users.SQL["user_temporal_events"])
def q_saved_temporal_events(spark, sf):
    """K7 + S12: the temporal table written by time bin and read back."""
    back = _saved(spark, "temporal_topics", catalog_users.q_user_temporal_events(spark, sf))
    return back.select("user_id", "time_bin", "topic_id", "prob")


@_reg("saved_dataset_summary", catalog_users.SQL["dataset_summary_posts"])
def q_saved_dataset_summary(spark, sf):
    """K5 / K8 + S12: a one-row summary as JSON."""
    back = _saved(spark, "dataset_summary", catalog_users.q_dataset_summary_posts(spark, sf))
    return back.select("num_users", "num_posts", "avg_posts_per_user", F.to_date("first_date").alias("first_date"), F.to_date("last_date").alias("last_date"))


@_reg("saved_suspicious_users", catalog_suspicion.SQL["suspicious_no_duplicates_events"])
def q_saved_suspicious_users(spark, sf):
    """K4 + S12: the suspicious-user table."""
    return _saved(spark, "suspicious_users", catalog_suspicion.q_suspicious_no_duplicates_events(spark, sf))


def _run_summary(spark, results):
    out = scratch(spark, "run")
    runs.save(results, out)
    tables = {name: runs.load(spark, out, name) for name in results}
    users = tables["user_topic_data"].agg(F.count("*")).scalar()
    return rounded(tables["run_summary"].select("*", users.alias("users_saved"), F.lit(len(tables)).alias("tables_saved")))


@_reg("run_lda_saved_summary")
def q_run_lda_saved_summary(spark, sf):
    """The whole LDA run over the posts, saved; its summary and table sizes as read back."""
    posts = FX.posts(spark, sf)
    return _run_summary(spark, runs.run_lda(posts, runs.TopicConfig(k=catalog_topics.LDA_K), fitted=catalog_topics.lda_run(spark, sf)))


@_reg("run_embedding_saved_summary")
def q_run_embedding_saved_summary(spark, sf):
    """The whole embedding run over the posts, saved; as above."""
    return _run_summary(spark, runs.run_embedding(FX.posts(spark, sf)))


def _fitted_words(spark, sf):
    lda = catalog_topics.lda_run(spark, sf)
    docs, _, topic, _ = catalog_embed.embed_fit(spark, sf)
    weights, _ = E.class_tfidf(E.class_terms(docs, topic))
    return L.topic_words(lda["model"], lda["vocab"], 20), E.top_words(weights, 20)


@_reg("compare_fitted_topics")
def q_compare_fitted_topics(spark, sf):
    """J6 on two models fitted to the same posts: topics of either that share words."""
    return rounded(CP.topic_jaccard(*_fitted_words(spark, sf), threshold=0.0))


@_reg("topics_per_model")
def q_topics_per_model(spark, sf):
    """Distinct topics of each fitted model, outliers left out."""
    a, b = _fitted_words(spark, sf)
    return CP.distinct_topics(a, "lda").unionByName(CP.distinct_topics(b, "embedding"))


@_reg("lda_coherence_bands")
def q_lda_coherence_bands(spark, sf):
    """topics of the fitted LDA model by band of coherence."""
    results = runs.run_lda(None, runs.TopicConfig(k=catalog_topics.LDA_K), detect_suspicious=False, fitted=catalog_topics.lda_run(spark, sf))
    return results["coherence"].groupBy(FD.coherence_band(F.col("coherence")).alias("band")).agg(F.count("*").alias("topics"))
