"""Registered queries: user narrowness, temporal topics, summaries (A1 - A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import users as U
from ..sources import fixtures as FX
from .common import embed_probs_cte, events_probs_cte, rounded, scores_sql, EVENT_TOPIC_IDS_SQL

QUERIES = {}
SQL = {}


def _reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def scores_events(spark, sf, model=0):
    docs, dt, k = FX.doc_topics_events(spark, sf, model)
    return U.user_scores(U.user_topics(dt, docs, k))


@_reg("user_scores_events", scores_sql(events_probs_cte()))
def q_user_scores_events(spark, sf):
    return rounded(scores_events(spark, sf).drop("probs"))


@_reg("user_scores_embed", scores_sql(embed_probs_cte()))
def q_user_scores_embed(spark, sf):
    docs, dt, k = FX.doc_topics_embed(spark, sf)
    return rounded(U.user_scores(U.user_topics(dt, docs, k)).drop("probs"))


@_reg("user_temporal_events", f"""
WITH ids AS ({EVENT_TOPIC_IDS_SQL}),
ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id,
              CAST(date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE) AS time_bin,
              event_type FROM events),
n AS (SELECT user_id, time_bin, COUNT(*) AS n FROM ev GROUP BY 1, 2),
c AS (SELECT user_id, time_bin, topic_id, COUNT(*) AS c FROM ev JOIN ids USING (event_type) GROUP BY 1, 2, 3)
SELECT n.user_id, n.time_bin, i.topic_id, ROUND(COALESCE(c.c, 0) * 1.0 / n.n, 6) AS prob
FROM n CROSS JOIN ids i LEFT JOIN c ON c.user_id = n.user_id AND c.time_bin = n.time_bin AND c.topic_id = i.topic_id
""")
def q_user_temporal_events(spark, sf):
    docs, dt, k = FX.doc_topics_events(spark, sf)
    out = U.user_temporal(dt, docs, k, tb="week", week_anchor="tuesday")
    return rounded(out.withColumn("topic_id", F.col("topic_id").cast("int")))


@_reg("dominant_topic_counts_by_date", f"""
WITH ids AS ({EVENT_TOPIC_IDS_SQL}),
ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS date, event_type FROM events),
n AS (SELECT DISTINCT user_id, date FROM ev),
c AS (SELECT user_id, date, topic_id, COUNT(*) AS c FROM ev JOIN ids USING (event_type) GROUP BY 1, 2, 3)
SELECT n.user_id, n.date, i.topic_id, CAST(COALESCE(c.c, 0) AS BIGINT) AS n
FROM n CROSS JOIN ids i LEFT JOIN c ON c.user_id = n.user_id AND c.date = n.date AND c.topic_id = i.topic_id
""")
def q_dominant_topic_counts_by_date(spark, sf):
    docs, dt, k = FX.doc_topics_events(spark, sf)
    return U.dominant_topic_counts(dt, docs, k, by_date=True).withColumn("topic_id", F.col("topic_id").cast("int"))


@_reg("dataset_summary_posts", """
WITH p AS (SELECT CAST(e.user_id AS VARCHAR) AS user_id, e.ts FROM documents d JOIN events e ON e.event_id = d.doc_id)
SELECT COUNT(DISTINCT user_id) AS num_users, COUNT(*) AS num_posts,
       ROUND(COUNT(*) * 1.0 / COUNT(DISTINCT user_id), 6) AS avg_posts_per_user,
       CAST(MIN(ts) AS DATE) AS first_date, CAST(MAX(ts) AS DATE) AS last_date FROM p
""")
def q_dataset_summary_posts(spark, sf):
    return rounded(U.dataset_summary(FX.posts(spark, sf)))


@_reg("user_gini_zero_events", f"""
WITH p AS ({events_probs_cte()}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY p, topic_id) AS i,
             COUNT(*) OVER (PARTITION BY user_id) AS kk, SUM(p) OVER (PARTITION BY user_id) AS tot FROM p)
SELECT user_id, CAST(MAX(n) AS BIGINT) AS post_count,
       ROUND(CASE WHEN MAX(tot) = 0 THEN 0.0 ELSE SUM((2 * i - kk - 1) * p) / (MAX(kk) * MAX(tot)) END, 6) AS gini_score
FROM r GROUP BY user_id
""")
def q_user_gini_zero_events(spark, sf):
    docs, dt, k = FX.doc_topics_events(spark, sf)
    v = U.user_topics(dt, docs, k)
    return rounded(v.select("user_id", F.col("n_docs").cast("long").alias("post_count"),
                            M.gini_zero("probs").alias("gini_score")))
