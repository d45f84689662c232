"""DuckDB SQL builders for the posts pipeline oracles (CTE text)."""

from __future__ import annotations

from ..functions import text as T
from . import sqltext as S

STOPS = T.stopword_set()

POSTS = """
  SELECT d.doc_id AS post_id, CAST(e.user_id AS VARCHAR) AS user_id, e.ts AS timestamp, d.text AS post_content
  FROM documents d JOIN events e ON e.event_id = d.doc_id"""

POSTS_BY_SOURCE = """
  SELECT d.doc_id AS post_id, d.source AS user_id, e.ts AS timestamp, d.text AS post_content
  FROM documents d JOIN events e ON e.event_id = d.doc_id"""


def tokens_ctes(posts_sql: str = POSTS, min_tokens: int = 3, phrases: bool = True) -> str:
    """CTEs ``posts, tok0, pairs, vocab, phr, tok`` (tok = after phrases and re-filter)."""
    base = f"""
posts AS ({posts_sql}),
tok0 AS (SELECT post_id, user_id, timestamp, {S.lda_tokens('post_content', STOPS)} AS tokens FROM posts),
tok1 AS (SELECT * FROM tok0 WHERE len(tokens) >= {min_tokens})"""
    if not phrases:
        return base + ",\ntok AS (SELECT * FROM tok1)"
    return base + f""",
pairs AS (SELECT tokens[i] AS a, tokens[i + 1] AS b
          FROM (SELECT tokens, unnest(range(1, len(tokens))) AS i FROM tok1)),
vocab AS (SELECT k, COUNT(*) AS c FROM (SELECT unnest(tokens) AS k FROM tok1
                                        UNION ALL SELECT a || '_' || b FROM pairs) GROUP BY k),
vs AS (SELECT COUNT(*) AS v FROM vocab),
phr AS (SELECT * FROM (
          SELECT c.a, c.b, c.a || '_' || c.b AS phrase,
                 (vab.c - 5) / CAST(va.c * vb.c AS DOUBLE) * vs.v AS score
          FROM (SELECT DISTINCT a, b FROM pairs) c
          JOIN vocab va ON va.k = c.a JOIN vocab vb ON vb.k = c.b
          JOIN vocab vab ON vab.k = c.a || '_' || c.b CROSS JOIN vs) WHERE score > 10),
ex AS (SELECT post_id, pos, tokens[pos + 1] AS w,
              CASE WHEN pos + 1 < len(tokens) THEN tokens[pos + 2] END AS nxt
       FROM (SELECT post_id, tokens, unnest(range(0, len(tokens))) AS pos FROM tok1)),
hx AS (SELECT ex.*, ph.a IS NOT NULL AS hit FROM ex LEFT JOIN phr ph ON ph.a = ex.w AND ph.b = ex.nxt),
mx AS (SELECT *, hit AND (pos - COALESCE(MAX(CASE WHEN NOT hit THEN pos END) OVER (
              PARTITION BY post_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1) % 2 = 0 AS start
       FROM hx),
sx AS (SELECT *, COALESCE(LAG(start) OVER (PARTITION BY post_id ORDER BY pos), FALSE) AS prev_start FROM mx),
merged AS (SELECT post_id, list(CASE WHEN start THEN w || '_' || nxt ELSE w END ORDER BY pos) AS tokens
           FROM sx WHERE NOT prev_start GROUP BY post_id),
tok AS (SELECT t.post_id, t.user_id, t.timestamp, m.tokens FROM tok1 t JOIN merged m USING (post_id)
        WHERE len(m.tokens) >= {min_tokens})"""


def week_bin(col: str, anchor: str = "monday") -> str:
    if anchor == "tuesday":
        return f"CAST(date_trunc('week', {col} - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE)"
    return f"CAST(date_trunc('week', {col}) AS DATE)"


def bin_sql(col: str, tb: str, anchor: str = "monday") -> str:
    if tb == "day":
        return f"CAST({col} AS DATE)"
    if tb == "month":
        return f"CAST(date_trunc('month', {col}) AS DATE)"
    return week_bin(col, anchor)


def docs_ctes(tb: str = "week", anchor: str = "monday") -> str:
    """CTEs ``pd`` (posts with doc ids) and ``docs`` (user x bin documents); needs ``tok``."""
    return f"""
pd AS (SELECT *, {bin_sql('timestamp', tb, anchor)} AS time_bin,
              user_id || '|' || CAST({bin_sql('timestamp', tb, anchor)} AS VARCHAR) AS doc_id FROM tok),
docs AS (SELECT doc_id, user_id, time_bin,
                make_timestamp(CAST(SUM(epoch_us(timestamp)) // COUNT(*) AS BIGINT)) AS ts,
                COUNT(*) AS n_posts, CAST(SUM(len(tokens)) AS BIGINT) AS n_tokens
         FROM pd GROUP BY doc_id, user_id, time_bin HAVING SUM(len(tokens)) > 0)"""


def vocab_ctes(no_below: int = 3, no_above: float = 0.6, keep_n: int | None = None) -> str:
    """CTEs ``dterms, dfreq, dict`` over ``pd`` documents."""
    return f"""
dterms AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM pd) GROUP BY 1, 2),
ndocs AS (SELECT COUNT(*) AS n FROM docs),
dfreq AS (SELECT term, COUNT(*) AS df FROM dterms GROUP BY term),
dict AS (SELECT term, df, CAST(ROW_NUMBER() OVER (ORDER BY df DESC, term) - 1 AS INTEGER) AS term_index
         FROM (SELECT f.* FROM dfreq f, ndocs WHERE f.df >= {no_below} AND f.df <= FLOOR({no_above} * ndocs.n)
               {f'ORDER BY df DESC, term LIMIT {keep_n}' if keep_n else ''}))"""


def positions_cte() -> str:
    """CTE ``posn(doc_id, pos, term)``: global positions inside combined documents."""
    return """
posn AS (SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY timestamp, post_id, p) - 1 AS BIGINT) AS pos, term
         FROM (SELECT doc_id, timestamp, post_id, unnest(range(0, len(tokens))) AS p, unnest(tokens) AS term FROM pd))"""


def cv_ctes(p: str, posn: str, doclen: str, tw: str, w: int = 110) -> str:
    """c_v by naive window explosion; defines ``{p}coh(topic_id, coherence)``.

    ``posn(doc_id, pos, term)``, ``doclen(doc_id, L)``, ``tw(topic_id, word)``.
    """
    return f"""
{p}rw AS (SELECT DISTINCT word FROM {tw}),
{p}occp AS (SELECT x.doc_id, x.pos, x.term FROM {posn} x JOIN {p}rw ON {p}rw.word = x.term),
{p}dw AS (SELECT DISTINCT doc_id, term, s FROM (
         SELECT o.doc_id, o.term, unnest(range(GREATEST(0, o.pos - {w - 1}), LEAST(o.pos, GREATEST(0, l.L - {w})) + 1)) AS s
         FROM {p}occp o JOIN {doclen} l USING (doc_id))),
{p}nw AS (SELECT SUM(GREATEST(0, L - {w}) + 1) * 1.0 AS n FROM {doclen} WHERE doc_id IN (SELECT DISTINCT doc_id FROM {p}occp)),
{p}occ AS (SELECT term, COUNT(*) AS n FROM {p}dw GROUP BY term),
{p}tp AS (SELECT DISTINCT x.word AS t1, y.word AS t2 FROM {tw} x JOIN {tw} y ON x.topic_id = y.topic_id AND x.word < y.word),
{p}co AS (SELECT a.term AS t1, b.term AS t2, COUNT(*) AS n FROM {p}dw a JOIN {p}dw b ON a.doc_id = b.doc_id AND a.s = b.s
       JOIN {p}tp q ON q.t1 = a.term AND q.t2 = b.term GROUP BY 1, 2),
{p}m AS (SELECT x.topic_id, x.word AS wi, y.word AS wj FROM {tw} x JOIN {tw} y ON x.topic_id = y.topic_id),
{p}mm AS (SELECT m.*, oi.n AS ni, oj.n AS nj,
              CASE WHEN m.wi = m.wj THEN oi.n ELSE COALESCE(co.n, 0) END AS nij
       FROM {p}m m LEFT JOIN {p}occ oi ON oi.term = m.wi LEFT JOIN {p}occ oj ON oj.term = m.wj
       LEFT JOIN {p}co co ON co.t1 = LEAST(m.wi, m.wj) AND co.t2 = GREATEST(m.wi, m.wj)),
{p}v AS (SELECT topic_id, wi, wj,
             ln((nij / nw.n + 1e-12) / ((ni / nw.n) * (nj / nw.n))) / -ln(nij / nw.n + 1e-12) AS v FROM {p}mm, {p}nw nw),
{p}vec AS (SELECT topic_id, wj, SUM(v) AS vv FROM {p}v GROUP BY 1, 2),
{p}pw AS (SELECT v.topic_id, v.wi, SUM(v.v * vec.vv) AS dot, sqrt(SUM(v.v * v.v)) AS nrm
       FROM {p}v v JOIN {p}vec vec USING (topic_id, wj) GROUP BY 1, 2),
{p}vn AS (SELECT topic_id, sqrt(SUM(vv * vv)) AS vn FROM {p}vec GROUP BY 1),
{p}coh AS (SELECT topic_id, AVG(dot / (nrm * vn)) AS coherence FROM {p}pw JOIN {p}vn USING (topic_id) GROUP BY topic_id)"""


def doc_token_ctes() -> str:
    """Per-document LDA tokens of ``documents`` (no phrases), >= 3 tokens:
    ``t3(doc_id, lang, source, tokens)``, ``dposn``, ``dlen``, and the two
    fixed word tables ``twa`` (top 20 per lang) / ``twb`` (top 10 per source mod 4)."""
    return f"""
t0 AS (SELECT doc_id, lang, source, {S.lda_tokens('text', STOPS)} AS tokens FROM documents),
t3 AS (SELECT * FROM t0 WHERE len(tokens) >= 3),
dposn AS (SELECT doc_id, unnest(range(0, len(tokens))) AS pos, unnest(tokens) AS term FROM t3),
dlen AS (SELECT doc_id, len(tokens) AS L FROM t3),
ga AS (SELECT lang AS g, term, COUNT(*) AS c FROM (SELECT lang, unnest(tokens) AS term FROM t3) GROUP BY 1, 2),
twa AS (SELECT CAST(DENSE_RANK() OVER (ORDER BY g) - 1 AS INTEGER) AS topic_id, term AS word, CAST(r AS INTEGER) AS rank
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY c DESC, term) AS r FROM ga) WHERE r <= 20),
gb AS (SELECT CAST(substr(source, 4) AS INTEGER) % 4 AS g, term, COUNT(*) AS c
       FROM (SELECT source, unnest(tokens) AS term FROM t3) GROUP BY 1, 2),
twb AS (SELECT CAST(g AS INTEGER) AS topic_id, term AS word, CAST(r AS INTEGER) AS rank
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY c DESC, term) AS r FROM gb) WHERE r <= 10)"""
