"""Registered queries: chart feeds and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds as FD
from ..operators import suspicion as SU
from ..operators import users as U
from ..session import cut_lineage
from ..sources import fixtures as FX
from .common import EVENT_TOPIC_IDS_SQL, events_probs_cte, rounded, scores_sql

QUERIES = {}
SQL = {}
ROWS_ONLY = {"user_clusters_kmeans"}


def _reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _vec(spark, sf):
    docs, dt, k = FX.doc_topics_events(spark, sf)
    return cut_lineage(U.user_topics(dt, docs, k)), docs, dt, k


def _scores_flags(spark, sf, compat=True):
    vec, _, _, _ = _vec(spark, sf)
    scores = cut_lineage(U.user_scores(vec).drop("probs"))
    flags = cut_lineage(SU.suspicious_users(scores, None, compat=compat))
    return vec, scores, flags


P = f"p AS ({events_probs_cte()})"
SCORES = f"sc AS ({scores_sql(events_probs_cte(), digits=None)})"
FLAGS = f"""{SCORES},
ct AS (SELECT quantile_cont(post_count, 0.0095) AS pc, quantile_cont(gini_coefficient, 0.0095) AS gc FROM sc),
fl AS (SELECT sc.*, sc.post_count >= ct.pc AS suspicious_post_freq,
              COALESCE(sc.gini_coefficient >= ct.gc, FALSE) AS suspicious_narrowness, 0.0 AS duplicate_post_ratio,
              FALSE AS suspicious_duplicates,
              sc.post_count >= ct.pc AND COALESCE(sc.gini_coefficient >= ct.gc, FALSE) AS suspicious
       FROM sc CROSS JOIN ct)"""


@_reg("pie_slices_events", f"""
WITH {P},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY p DESC, topic_id) AS r,
             SUM(CASE WHEN p > 0.03 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS n_sig,
             MAX(CASE WHEN p <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS anyp FROM p),
sh AS (SELECT * FROM r WHERE anyp = 1 AND ((n_sig > 0 AND p > 0.03) OR (n_sig = 0 AND r <= 2 AND p > 1e-6))),
ot AS (SELECT user_id, 1.0 - SUM(p) AS value FROM sh GROUP BY user_id)
SELECT user_id, CAST(r AS INTEGER) AS slice, 'Topic ' || CAST(topic_id AS VARCHAR) AS label, ROUND(p, 6) AS value FROM sh
UNION ALL SELECT user_id, 999, 'Other', ROUND(value, 6) FROM ot WHERE value > 0.01
""")
def q_pie_slices_events(spark, sf):
    vec, _, _, _ = _vec(spark, sf)
    return rounded(FD.pie_slices(vec))


@_reg("pie_slices_dashboard_events", f"""
WITH {P},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY p DESC, topic_id) AS r FROM p),
ot AS (SELECT user_id, SUM(CASE WHEN p <= 0.03 THEN p ELSE 0.0 END) AS value FROM p GROUP BY user_id)
SELECT user_id, CAST(r AS INTEGER) AS slice, 'Topic ' || CAST(topic_id AS VARCHAR) AS label, ROUND(p, 6) AS value
FROM r WHERE p > 0.03
UNION ALL SELECT user_id, 999, 'Other', ROUND(value, 6) FROM ot WHERE value > 0.001
""")
def q_pie_slices_dashboard_events(spark, sf):
    vec, _, _, _ = _vec(spark, sf)
    return rounded(FD.pie_slices(vec, 0.03, 0.001, variant="dashboard"))


@_reg("temporal_top5_events", f"""
WITH ids AS ({EVENT_TOPIC_IDS_SQL}),
ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id,
              CAST(date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE) AS time_bin, event_type FROM events),
n AS (SELECT user_id, time_bin, COUNT(*) AS n FROM ev GROUP BY 1, 2),
c AS (SELECT user_id, time_bin, topic_id, COUNT(*) AS c FROM ev JOIN ids USING (event_type) GROUP BY 1, 2, 3),
t AS (SELECT n.user_id, n.time_bin, i.topic_id, COALESCE(c.c, 0) * 1.0 / n.n AS prob
      FROM n CROSS JOIN ids i LEFT JOIN c ON c.user_id = n.user_id AND c.time_bin = n.time_bin AND c.topic_id = i.topic_id),
m AS (SELECT user_id, topic_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ROUND(AVG(prob), 9) DESC, topic_id) AS r
      FROM t GROUP BY user_id, topic_id)
SELECT t.user_id, t.time_bin, CASE WHEN m.r <= 5 THEN 'Topic_' || CAST(t.topic_id AS VARCHAR) ELSE 'Other' END AS label,
       ROUND(SUM(t.prob), 6) AS prob
FROM t JOIN m USING (user_id, topic_id) GROUP BY 1, 2, 3
""")
def q_temporal_top5_events(spark, sf):
    docs, dt, k = FX.doc_topics_events(spark, sf)
    return rounded(FD.temporal_top(U.user_temporal(dt, docs, k), 5))


@_reg("scatter_feed_compat", f"""
WITH {FLAGS}
SELECT user_id, post_count, ROUND(gini_coefficient, 6) AS metric_value,
       CASE WHEN suspicious THEN 'Suspicious' ELSE 'Normal' END AS user_type
FROM fl WHERE gini_coefficient IS NOT NULL
""")
def q_scatter_feed_compat(spark, sf):
    _, scores, flags = _scores_flags(spark, sf)
    return rounded(FD.scatter_feed(scores, flags))


@_reg("distribution_feed_compat", f"""
WITH {FLAGS},
s AS (SELECT CASE WHEN suspicious THEN 'Suspicious' ELSE 'Normal' END AS user_type, gini_coefficient AS v
      FROM fl WHERE gini_coefficient IS NOT NULL)
SELECT user_type, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean, ROUND(quantile_cont(v, 0.0), 6) AS q000,
       ROUND(quantile_cont(v, 0.25), 6) AS q025, ROUND(quantile_cont(v, 0.5), 6) AS q050,
       ROUND(quantile_cont(v, 0.75), 6) AS q075, ROUND(quantile_cont(v, 1.0), 6) AS q100
FROM s GROUP BY user_type
""")
def q_distribution_feed_compat(spark, sf):
    _, scores, flags = _scores_flags(spark, sf)
    return rounded(FD.distribution_feed(cut_lineage(FD.scatter_feed(scores, flags))))


SIM_SQL = f"""{P},
g AS (SELECT a.topic_id AS i, b.topic_id AS j, SUM(a.p * b.p) AS dot FROM p a JOIN p b USING (user_id) GROUP BY 1, 2),
nn AS (SELECT topic_id, sqrt(SUM(p * p)) AS n FROM p GROUP BY 1),
sim AS (SELECT g.i, g.j, CASE WHEN x.n > 0 AND y.n > 0 THEN g.dot / (x.n * y.n) ELSE 0.0 END AS similarity
        FROM g JOIN nn x ON x.topic_id = g.i JOIN nn y ON y.topic_id = g.j)"""


@_reg("topic_similarity_matrix_events", f"""
WITH {SIM_SQL}
SELECT i, j, ROUND(similarity, 6) AS similarity FROM sim
""")
def q_topic_similarity_matrix_events(spark, sf):
    vec, _, _, _ = _vec(spark, sf)
    return rounded(FD.topic_similarity_matrix(vec))


@_reg("topic_network_degree_events", f"""
WITH {SIM_SQL},
e AS (SELECT i, j FROM sim WHERE i < j AND similarity >= 0.3),
d AS (SELECT t, COUNT(*) AS degree FROM (SELECT i AS t FROM e UNION ALL SELECT j FROM e) GROUP BY t)
SELECT n.i AS topic_id, CAST(COALESCE(d.degree, 0) AS BIGINT) AS degree
FROM (SELECT DISTINCT i FROM sim) n LEFT JOIN d ON d.t = n.i
""")
def q_topic_network_degree_events(spark, sf):
    vec, _, _, _ = _vec(spark, sf)
    _, nodes = FD.topic_network(FD.topic_similarity_matrix(vec), 0.3)
    return nodes


@_reg("topic_network_edges_embed", """
WITH d AS (SELECT CAST(label AS VARCHAR) AS user_id,
                  list_transform(embedding, lambda v: ABS(CAST(v AS DOUBLE))) AS h FROM embeddings),
l AS (SELECT user_id, CAST(t.i - 1 AS INTEGER) AS topic_id,
             CASE WHEN list_sum(h) > 0 THEN h[t.i] / list_sum(h) ELSE 0.0 END AS p FROM d, range(1, 65) t(i)),
p AS (SELECT user_id, topic_id, AVG(p) AS p FROM l GROUP BY 1, 2),
g AS (SELECT a.topic_id AS i, b.topic_id AS j, SUM(a.p * b.p) AS dot FROM p a JOIN p b USING (user_id) GROUP BY 1, 2),
nn AS (SELECT topic_id, sqrt(SUM(p * p)) AS n FROM p GROUP BY 1),
sim AS (SELECT g.i, g.j, g.dot / (x.n * y.n) AS similarity FROM g JOIN nn x ON x.topic_id = g.i JOIN nn y ON y.topic_id = g.j)
SELECT i, j, ROUND(similarity, 6) AS similarity FROM sim WHERE i < j AND similarity >= 0.3
""")
def q_topic_network_edges_embed(spark, sf):
    docs, dt, k = FX.doc_topics_embed(spark, sf)
    edges, _ = FD.topic_network(FD.topic_similarity_matrix(U.user_topics(dt, docs, k)), 0.3)
    return rounded(edges)


@_reg("user_clusters_kmeans")
def q_user_clusters_kmeans(spark, sf):
    """KMeans(5, seed 42) on user topic vectors + 2-D PCA."""
    vec, _, _, _ = _vec(spark, sf)
    return rounded(FD.user_clusters(vec, 5, 42))


@_reg("cluster_stats_dominant", f"""
WITH {SCORES}
SELECT dominant_topic AS cluster, COUNT(*) AS num_users, ROUND(AVG(gini_coefficient), 6) AS avg_gini,
       ROUND(AVG(post_count), 6) AS avg_posts FROM sc GROUP BY 1
""")
def q_cluster_stats_dominant(spark, sf):
    _, scores, _ = _scores_flags(spark, sf)
    assign = scores.select("user_id", F.col("dominant_topic").alias("cluster"))
    return rounded(FD.cluster_stats(assign, scores))


@_reg("cluster_topics_dominant", f"""
WITH {SCORES}, {P},
m AS (SELECT sc.dominant_topic AS cluster, p.topic_id, AVG(p.p) AS mean_prob FROM p JOIN sc USING (user_id) GROUP BY 1, 2),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY ROUND(mean_prob, 9) DESC, topic_id) AS INTEGER) AS rank FROM m)
SELECT cluster, topic_id, ROUND(mean_prob, 6) AS mean_prob, rank FROM r WHERE rank <= 3
""")
def q_cluster_topics_dominant(spark, sf):
    vec, scores, _ = _scores_flags(spark, sf)
    assign = scores.select("user_id", F.col("dominant_topic").alias("cluster"))
    return rounded(FD.cluster_topics(assign, vec, 3))


@_reg("top_users_by_gini_events", f"""
WITH {SCORES}
SELECT user_id, post_count, ROUND(gini_coefficient, 6) AS gini_coefficient FROM sc
ORDER BY ROUND(gini_coefficient, 9) DESC NULLS LAST, user_id LIMIT 5
""")
def q_top_users_by_gini_events(spark, sf):
    _, scores, _ = _scores_flags(spark, sf)
    return rounded(FD.top_users(scores, 5).select("user_id", "post_count", "gini_coefficient"))


@_reg("first_flagged_users_compat", f"""
WITH {FLAGS}
SELECT user_id, post_count, ROUND(gini_coefficient, 6) AS gini_coefficient FROM fl WHERE suspicious
ORDER BY ROUND(gini_coefficient, 9) DESC NULLS LAST, post_count DESC, user_id LIMIT 10
""")
def q_first_flagged_users_compat(spark, sf):
    _, _, flags = _scores_flags(spark, sf)
    top = SU.sort_suspicious(flags.filter(F.col("suspicious"))).limit(10)
    return rounded(top.select("user_id", "post_count", "gini_coefficient"))


@_reg("user_list_sorted_posts", """
SELECT DISTINCT CAST(e.user_id AS VARCHAR) AS user_id FROM documents d JOIN events e ON e.event_id = d.doc_id
""")
def q_user_list_sorted_posts(spark, sf):
    return FX.posts(spark, sf).select("user_id").distinct().orderBy("user_id")


@_reg("preview_posts", """
SELECT d.doc_id AS post_id, CAST(e.user_id AS VARCHAR) AS user_id, e.ts AS timestamp, d.text AS post_content
FROM documents d JOIN events e ON e.event_id = d.doc_id ORDER BY post_id LIMIT 5
""")
def q_preview_posts(spark, sf):
    return FX.posts(spark, sf).orderBy("post_id").limit(5)


@_reg("gini_bands_events", f"""
WITH {SCORES}
SELECT user_id, CASE WHEN gini_coefficient < 0.3 THEN 'diverse' WHEN gini_coefficient < 0.7 THEN 'moderately_focused'
                     ELSE 'highly_specialized' END AS band FROM sc
""")
def q_gini_bands_events(spark, sf):
    _, scores, _ = _scores_flags(spark, sf)
    return scores.select("user_id", FD.gini_band(F.col("gini_coefficient")).alias("band"))


@_reg("user_card_compat", f"""
WITH {FLAGS},
pick AS (SELECT user_id FROM fl ORDER BY post_count DESC, user_id LIMIT 1)
SELECT user_id, post_count, ROUND(gini_coefficient, 6) AS gini_coefficient, ROUND(shannon_entropy, 6) AS shannon_entropy,
       ROUND(top1_ratio, 6) AS top1_ratio, suspicious,
       concat_ws(', ', CASE WHEN suspicious_post_freq THEN 'high posting frequency' END,
                       CASE WHEN suspicious_narrowness THEN 'narrow topic focus' END,
                       CASE WHEN suspicious_duplicates THEN 'high duplicate content' END) AS reasons
FROM fl JOIN pick USING (user_id)
""")
def q_user_card_compat(spark, sf):
    _, _, flags = _scores_flags(spark, sf)
    pick = flags.orderBy(F.col("post_count").desc(), "user_id").limit(1).select("user_id")
    card = SU.flag_reasons(flags.join(pick, "user_id", "left_semi"))
    return rounded(card.select("user_id", "post_count", "gini_coefficient", "shannon_entropy", "top1_ratio",
                               "suspicious", "reasons"))


@_reg("membership_filter_compat", f"""
WITH {FLAGS}
SELECT user_id, post_count FROM fl WHERE suspicious
""")
def q_membership_filter_compat(spark, sf):
    _, scores, flags = _scores_flags(spark, sf)
    return FD.membership(scores.select("user_id", "post_count"), flags)


@_reg("user_vector_lookup_compat", f"""
WITH {FLAGS}, {P}
SELECT fl.user_id, fl.suspicious, {', '.join(f"ROUND(MAX(CASE WHEN p.topic_id = {i} THEN p.p END), 6) AS Topic_{i}" for i in range(5))}
FROM fl LEFT JOIN p USING (user_id) GROUP BY fl.user_id, fl.suspicious
""")
def q_user_vector_lookup_compat(spark, sf):
    vec, _, flags = _scores_flags(spark, sf)
    j = flags.select("user_id", "suspicious").join(vec.select("user_id", "probs"), "user_id", "left")
    return rounded(j.select("user_id", "suspicious", *[F.col("probs")[i].alias(f"Topic_{i}") for i in range(5)]))
