"""Shared helpers for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE / FLOAT column (results are compared at 1e-6)."""
    cols = []
    for name, typ in df.dtypes:
        c = F.col(f"`{name}`")
        if typ in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(name))
    return df.select(*cols)


# SQL fragments shared by oracles -------------------------------------------
EVENT_TOPIC_IDS_SQL = """
  SELECT event_type, CAST(DENSE_RANK() OVER (ORDER BY event_type) - 1 AS INTEGER) AS topic_id
  FROM (SELECT DISTINCT event_type FROM events)"""


def scores_sql(probs_cte: str, digits: int | None = 6) -> str:
    """User score SELECT over a CTE ``p(user_id, n, topic_id, p)`` holding all k topics."""
    if digits is None:
        return _scores_sql(probs_cte).replace("ROUND(", "(").replace(", 6) AS", ") AS")
    return _scores_sql(probs_cte)


def _scores_sql(probs_cte: str) -> str:
    return f"""
WITH p AS ({probs_cte}),
r AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY p, topic_id) AS i,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY p DESC, topic_id) AS j,
         COUNT(*) OVER (PARTITION BY user_id) AS kk,
         SUM(p) OVER (PARTITION BY user_id) AS tot,
         SUM(CASE WHEN p > 0 THEN p ELSE 0 END) OVER (PARTITION BY user_id) AS pos,
         MAX(p) OVER (PARTITION BY user_id) AS mx
  FROM p)
SELECT user_id, CAST(MAX(n) AS BIGINT) AS post_count,
  ROUND(CASE WHEN MAX(tot) = 0 THEN NULL WHEN MAX(kk) <= 1 THEN 0.0
        ELSE SUM((2 * i - kk - 1) * ABS(p)) / (MAX(kk) * SUM(ABS(p))) END, 6) AS gini_coefficient,
  ROUND(CASE WHEN MAX(pos) = 0 THEN 0.0
        ELSE -SUM(CASE WHEN p > 0 THEN (p / pos) * LOG2(p / pos) ELSE 0 END) END, 6) AS shannon_entropy,
  ROUND(CASE WHEN MAX(tot) = 0 THEN 0.0 ELSE SUM(CASE WHEN j = 1 THEN p ELSE 0 END) / MAX(tot) END, 6) AS top1_ratio,
  ROUND(CASE WHEN MAX(tot) = 0 THEN 0.0 ELSE SUM(CASE WHEN j <= 2 THEN p ELSE 0 END) / MAX(tot) END, 6) AS top2_ratio,
  CAST(MIN(CASE WHEN p = mx THEN topic_id END) AS INTEGER) AS dominant_topic
FROM r GROUP BY user_id"""


def events_probs_cte(model: int = 0) -> str:
    """``p(user_id, n, topic_id, p)`` for the one-hot events fixture (its two models)."""
    if model == 1:
        ids, ev = "SELECT CAST(range AS INTEGER) AS topic_id FROM range(5)", "SELECT *, CAST(hour(ts) % 5 AS INTEGER) AS topic_id FROM events"
    else:
        ids, ev = EVENT_TOPIC_IDS_SQL, f"SELECT e.*, i.topic_id FROM events e JOIN ({EVENT_TOPIC_IDS_SQL}) i USING (event_type)"
    return f"""
  WITH ids AS ({ids}),
  ev AS ({ev}),
  u AS (SELECT CAST(user_id AS VARCHAR) AS user_id, COUNT(*) AS n FROM ev GROUP BY 1),
  c AS (SELECT CAST(user_id AS VARCHAR) AS user_id, topic_id, COUNT(*) AS c FROM ev GROUP BY 1, 2)
  SELECT u.user_id, u.n, i.topic_id, COALESCE(c.c, 0) * 1.0 / u.n AS p
  FROM u CROSS JOIN ids i LEFT JOIN c ON c.user_id = u.user_id AND c.topic_id = i.topic_id"""


def embed_probs_cte() -> str:
    """``p(user_id, n, topic_id, p)`` for the embeddings fixture (64 topics, user = label)."""
    return """
  WITH d AS (SELECT vec_id, CAST(label AS VARCHAR) AS user_id,
                    list_transform(embedding, lambda v: ABS(CAST(v AS DOUBLE))) AS h FROM embeddings),
  dn AS (SELECT vec_id, user_id, h, list_sum(h) AS tot FROM d),
  l AS (SELECT user_id, CAST(t.i - 1 AS INTEGER) AS topic_id,
               CASE WHEN tot > 0 THEN h[t.i] / tot ELSE 0.0 END AS p
        FROM dn, range(1, 65) t(i)),
  u AS (SELECT user_id, COUNT(*) AS n FROM dn GROUP BY 1)
  SELECT l.user_id, u.n, l.topic_id, SUM(l.p) / u.n AS p
  FROM l JOIN u USING (user_id) GROUP BY l.user_id, u.n, l.topic_id"""
