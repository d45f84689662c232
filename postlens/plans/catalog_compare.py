"""Registered queries: model comparison.

Two "models" over fixed inputs: user scores / flags from the one-hot
events topics over all events, by event type and by hour of day; topic-word tables = top 20
words per document language vs top 10 per source (mod 4).
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import clean as C
from ..operators import coherence as CO
from ..operators import compare as CP
from ..operators import suspicion as SU
from ..session import cut_lineage, written
from ..sources import fixtures as FX
from . import sqlpipe as SP
from .common import events_probs_cte, rounded, scores_sql

QUERIES = {}
SQL = {}


def _reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _scores(spark, sf, model):
    from .catalog_users import scores_events
    return cut_lineage(scores_events(spark, sf, model).drop("probs"))


def _flags(spark, sf, model, compat=False, q=0.95):
    return cut_lineage(SU.suspicious_users(_scores(spark, sf, model), None, q, q, compat=compat))


def flags_sql(name: str, model: int, q: float = 0.95) -> str:
    return f"""
{name}s AS ({scores_sql(events_probs_cte(model), digits=None)}),
{name}c AS (SELECT quantile_cont(post_count, {q}) AS pc, quantile_cont(gini_coefficient, {q}) AS gc FROM {name}s),
{name} AS (SELECT s.*, 0.0 AS duplicate_post_ratio,
                  (s.post_count >= c.pc AND COALESCE(s.gini_coefficient >= c.gc, FALSE)) AS suspicious
           FROM {name}s s CROSS JOIN {name}c c)"""


MERGED_SQL = f"""{flags_sql('fa', 0)}, {flags_sql('fb', 1)},
mg AS (SELECT a.user_id, a.post_count AS post_count_lda, a.gini_coefficient AS gini_coefficient_lda,
              a.shannon_entropy AS shannon_entropy_lda, a.top1_ratio AS top1_ratio_lda,
              b.post_count AS post_count_bert, b.gini_coefficient AS gini_coefficient_bert,
              b.shannon_entropy AS shannon_entropy_bert, b.top1_ratio AS top1_ratio_bert
       FROM fa a JOIN fb b USING (user_id))"""


@_reg("compare_scores_join_events", f"""
WITH {MERGED_SQL}
SELECT user_id, post_count_lda, ROUND(gini_coefficient_lda, 6) AS gini_coefficient_lda,
       ROUND(shannon_entropy_lda, 6) AS shannon_entropy_lda, ROUND(top1_ratio_lda, 6) AS top1_ratio_lda,
       post_count_bert, ROUND(gini_coefficient_bert, 6) AS gini_coefficient_bert,
       ROUND(shannon_entropy_bert, 6) AS shannon_entropy_bert, ROUND(top1_ratio_bert, 6) AS top1_ratio_bert
FROM mg
""")
def q_compare_scores_join_events(spark, sf):
    return rounded(CP.join_scores(_scores(spark, sf, 0), _scores(spark, sf, 1)))


def _summary_sql(m):
    x, y = f"{m}_lda", f"{m}_bert"
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    xv, yv = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
    return f"""SELECT '{m}' AS metric,
  ROUND(CASE WHEN COUNT(CASE WHEN {both} THEN 1 END) >= 2 THEN corr({yv}, {xv}) END, 6) AS correlation,
  ROUND(AVG({x}), 6) AS lda_mean, ROUND(AVG({y}), 6) AS bert_mean,
  ROUND(stddev_samp({x}), 6) AS lda_std, ROUND(stddev_samp({y}), 6) AS bert_std,
  ROUND(AVG({y}) - AVG({x}), 6) AS mean_difference,
  ROUND(regr_slope({yv}, {xv}), 6) AS slope, ROUND(regr_intercept({yv}, {xv}), 6) AS intercept,
  ROUND(regr_r2({yv}, {xv}), 6) AS r_squared FROM mg"""


@_reg("compare_narrowness_events", f"""
WITH {MERGED_SQL}
{' UNION ALL '.join(_summary_sql(m) for m in CP.METRICS)}
""")
def q_compare_narrowness_events(spark, sf):
    merged = CP.join_scores(_scores(spark, sf, 0), _scores(spark, sf, 1))
    return rounded(CP.narrowness_summary(merged))


@_reg("compare_flag_overlap_events", f"""
WITH {flags_sql('fa', 0)}, {flags_sql('fb', 1)},
sa AS (SELECT DISTINCT user_id FROM fa WHERE suspicious), sb AS (SELECT DISTINCT user_id FROM fb WHERE suspicious),
n AS (SELECT (SELECT COUNT(*) FROM sa) AS na, (SELECT COUNT(*) FROM sb) AS nb,
             (SELECT COUNT(*) FROM sa JOIN sb USING (user_id)) AS nab)
SELECT CAST(na AS BIGINT) AS total_suspicious_lda, CAST(nb AS BIGINT) AS total_suspicious_bert,
       CAST(nab AS BIGINT) AS overlap_count,
       ROUND(nab * 1.0 / GREATEST(1, na) * 100, 6) AS overlap_percent_of_lda,
       ROUND(nab * 1.0 / GREATEST(1, nb) * 100, 6) AS overlap_percent_of_bert,
       CAST(na - nab AS BIGINT) AS lda_only_count, CAST(nb - nab AS BIGINT) AS bert_only_count FROM n
""")
def q_compare_flag_overlap_events(spark, sf):
    return rounded(CP.flag_overlap(_flags(spark, sf, 0), _flags(spark, sf, 1)))


@_reg("compare_flag_sets_events", f"""
WITH {flags_sql('fa', 0)}, {flags_sql('fb', 1)},
sa AS (SELECT DISTINCT user_id FROM fa WHERE suspicious), sb AS (SELECT DISTINCT user_id FROM fb WHERE suspicious)
SELECT user_id, 'both' AS membership FROM (SELECT * FROM sa INTERSECT SELECT * FROM sb)
UNION ALL SELECT user_id, 'lda_only' FROM (SELECT * FROM sa EXCEPT SELECT * FROM sb)
UNION ALL SELECT user_id, 'bert_only' FROM (SELECT * FROM sb EXCEPT SELECT * FROM sa)
""")
def q_compare_flag_sets_events(spark, sf):
    return CP.flag_sets(_flags(spark, sf, 0), _flags(spark, sf, 1))


@_reg("compare_discrepancies_events", f"""
WITH {flags_sql('fa', 0)}, {flags_sql('fb', 1)},
j AS (SELECT COALESCE(a.user_id, b.user_id) AS user_id, COALESCE(a.suspicious, FALSE) AS sa,
             COALESCE(b.suspicious, FALSE) AS sb, a.gini_coefficient AS lda_gini, b.gini_coefficient AS bert_gini,
             a.post_count AS pa, b.post_count AS pb, a.duplicate_post_ratio AS lda_duplicate_ratio,
             b.duplicate_post_ratio AS bert_duplicate_ratio
      FROM fa a FULL JOIN fb b ON a.user_id = b.user_id)
SELECT user_id, CASE WHEN sa AND NOT sb THEN 'LDA only' ELSE 'BERTopic only' END AS model,
       ROUND(lda_gini, 6) AS lda_gini, ROUND(bert_gini, 6) AS bert_gini,
       CAST(CASE WHEN sa AND NOT sb THEN COALESCE(pa, pb) ELSE COALESCE(pb, pa) END AS BIGINT) AS post_count,
       lda_duplicate_ratio, bert_duplicate_ratio
FROM j WHERE sa <> sb
""")
def q_compare_discrepancies_events(spark, sf):
    return rounded(CP.discrepancies(_flags(spark, sf, 0), _flags(spark, sf, 1)))


def doc_tokens(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return C.lda_tokenize(d, text_col="text").drop("text")


def word_tables(tok):
    """(words_a: top 20 per lang, words_b: top 10 per source number mod 4)."""
    ex = tok.select("lang", "source", F.explode("tokens").alias("term"))
    ex = written(ex.groupBy("lang", "source", "term").agg(F.count("*").alias("n")))    # both tables from one pass over the texts
    ca = ex.groupBy("lang", "term").agg(F.sum("n").alias("c"))
    ra = ca.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("c").desc(), "term")))
    ra = ra.filter(F.col("rank") <= 20)
    ids = ra.select("lang").distinct().withColumn("topic_id", (F.dense_rank().over(Window.orderBy("lang")) - 1).cast("int"))
    wa = ra.join(ids, "lang").select("topic_id", F.col("term").alias("word"), F.col("rank").cast("int"))
    g = (F.substring("source", 4, 10).cast("int") % 4).alias("g")
    cb = ex.select(g, "term", "n").groupBy("g", "term").agg(F.sum("n").alias("c"))
    rb = cb.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("c").desc(), "term")))
    wb = rb.filter(F.col("rank") <= 10).select(F.col("g").cast("int").alias("topic_id"), F.col("term").alias("word"),
                                               F.col("rank").cast("int"))
    return written(wa), written(wb)


JACCARD_SQL = f"""
a AS (SELECT DISTINCT topic_id AS lda_topic, word FROM twa WHERE rank <= 20),
b AS (SELECT DISTINCT topic_id AS bert_topic, word FROM twb WHERE rank <= 20 AND topic_id <> -1),
na AS (SELECT lda_topic, COUNT(*) AS na FROM a GROUP BY 1), nb AS (SELECT bert_topic, COUNT(*) AS nb FROM b GROUP BY 1),
sh AS (SELECT lda_topic, bert_topic, COUNT(*) AS k, string_agg(word, ',' ORDER BY word) AS shared_words
       FROM a JOIN b USING (word) GROUP BY 1, 2),
sims AS (SELECT lda_topic, bert_topic, k * 1.0 / (na + nb - k) AS similarity, CAST(k AS BIGINT) AS num_shared, shared_words
         FROM sh JOIN na USING (lda_topic) JOIN nb USING (bert_topic))"""


@_reg("topic_jaccard_lang_source", f"""
WITH {SP.doc_token_ctes()}, {JACCARD_SQL}
SELECT lda_topic, bert_topic, ROUND(similarity, 6) AS similarity, num_shared, shared_words FROM sims WHERE similarity > 0.1
""")
def q_topic_jaccard_lang_source(spark, sf):
    wa, wb = word_tables(doc_tokens(spark, sf))
    return rounded(CP.topic_jaccard(wa, wb))


@_reg("top_similar_topic_pairs", f"""
WITH {SP.doc_token_ctes()}, {JACCARD_SQL}
SELECT lda_topic, bert_topic, ROUND(similarity, 6) AS similarity, num_shared,
       array_to_string(string_split(shared_words, ',')[1:10], ',') AS shared_words
FROM sims WHERE similarity > 0.1 ORDER BY similarity DESC, lda_topic, bert_topic LIMIT 15
""")
def q_top_similar_topic_pairs(spark, sf):
    wa, wb = word_tables(doc_tokens(spark, sf))
    return rounded(CP.top_similar_pairs(CP.topic_jaccard(wa, wb), 15, 10))


@_reg("side_by_side_topics", f"""
WITH {SP.doc_token_ctes()},
ia AS (SELECT topic_id, CAST(DENSE_RANK() OVER (ORDER BY topic_id) AS INTEGER) AS i FROM (SELECT DISTINCT topic_id FROM twa)),
ib AS (SELECT topic_id, CAST(DENSE_RANK() OVER (ORDER BY topic_id) AS INTEGER) AS i
       FROM (SELECT DISTINCT topic_id FROM twb WHERE topic_id <> -1)),
wa AS (SELECT topic_id, string_agg(word, ', ' ORDER BY rank) AS w FROM twa WHERE rank <= 10 GROUP BY 1),
wb AS (SELECT topic_id, string_agg(word, ', ' ORDER BY rank) AS w FROM twb WHERE rank <= 10 GROUP BY 1)
SELECT ia.i, ia.topic_id AS lda_topic, wa.w AS lda_words, ib.topic_id AS bert_topic, wb.w AS bert_words
FROM ia JOIN wa USING (topic_id) JOIN ib ON ib.i = ia.i JOIN wb ON wb.topic_id = ib.topic_id WHERE ia.i <= 5
""")
def q_side_by_side_topics(spark, sf):
    wa, wb = word_tables(doc_tokens(spark, sf))
    return CP.side_by_side(wa, wb, 5, 10)


@_reg("compare_coherence_verdicts", f"""
WITH {SP.doc_token_ctes()}, {SP.cv_ctes('a_', 'dposn', 'dlen', 'twa')}, {SP.cv_ctes('b_', 'dposn', 'dlen', 'twb')},
{flags_sql('fa', 0)}, {flags_sql('fb', 1)},
ma AS (SELECT AVG(coherence) AS m FROM a_coh), mb AS (SELECT AVG(coherence) AS m FROM b_coh),
gm AS (SELECT a.user_id, a.gini_coefficient AS x, b.gini_coefficient AS y FROM fa a JOIN fb b USING (user_id)),
gc AS (SELECT CASE WHEN COUNT(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) >= 2 THEN corr(y, x) END AS r FROM gm),
sa AS (SELECT DISTINCT user_id FROM fa WHERE suspicious), sb AS (SELECT DISTINCT user_id FROM fb WHERE suspicious),
ov AS (SELECT (SELECT COUNT(*) FROM sa JOIN sb USING (user_id)) * 100.0 / GREATEST(1, (SELECT COUNT(*) FROM sa)) AS oa,
              (SELECT COUNT(*) FROM sa JOIN sb USING (user_id)) * 100.0 / GREATEST(1, (SELECT COUNT(*) FROM sb)) AS ob),
c AS (SELECT ma.m AS lda, mb.m AS bert, mb.m - ma.m AS d, gc.r, ov.oa, ov.ob FROM ma, mb, gc, ov)
SELECT ROUND(lda, 6) AS lda_coherence_mean, ROUND(bert, 6) AS bert_coherence_mean, ROUND(d, 6) AS difference,
       ROUND(CASE WHEN lda <> 0 THEN d / ABS(lda) * 100 WHEN d > 0 THEN 'inf'::DOUBLE WHEN d < 0 THEN '-inf'::DOUBLE ELSE 0.0 END, 6)
         AS percent_improvement_over_lda,
       CASE WHEN d IS NULL THEN 'unavailable' WHEN d > 0.01 THEN 'bert_more_coherent' WHEN d < -0.01 THEN 'lda_more_coherent'
            ELSE 'comparable' END AS coherence_verdict,
       CASE WHEN r IS NULL THEN 'unavailable' WHEN r > 0.7 THEN 'strong' WHEN r > 0.4 THEN 'moderate'
            WHEN r > 0.1 THEN 'weak' ELSE 'low_or_negative' END AS narrowness_verdict,
       CASE WHEN (oa + ob) / 2 > 60 THEN 'high' WHEN (oa + ob) / 2 > 30 THEN 'moderate' ELSE 'low' END AS overlap_verdict
FROM c
""")
def q_compare_coherence_verdicts(spark, sf):
    tok = written(doc_tokens(spark, sf))
    wa, wb = word_tables(tok)
    pos = tok.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    dl = tok.select("doc_id", F.size("tokens").alias("L"))
    ma = CO.coherence_cv(wa, pos, dl).agg(F.avg("coherence")).first()[0]
    mb = CO.coherence_cv(wb, pos, dl).agg(F.avg("coherence")).first()[0]
    merged = CP.join_scores(_scores(spark, sf, 0), _scores(spark, sf, 1))
    corr = CP.narrowness_summary(merged).filter(F.col("metric") == "gini_coefficient").select("correlation")
    ov = CP.flag_overlap(_flags(spark, sf, 0), _flags(spark, sf, 1))
    r = corr.first()[0]
    o = ov.first()
    base = spark.range(1).select(F.lit(ma).cast("double").alias("a"), F.lit(mb).cast("double").alias("b"),
                                 F.lit(r).cast("double").alias("r"),
                                 F.lit(o["overlap_percent_of_lda"]).cast("double").alias("oa"),
                                 F.lit(o["overlap_percent_of_bert"]).cast("double").alias("ob"))
    cols = CP.coherence_comparison(F.col("a"), F.col("b"))
    v = CP.verdicts(F.col("b") - F.col("a"), F.col("r"), F.col("oa"), F.col("ob"))
    return rounded(base.select(*cols, *v))


def _scaled(name, base_sql, q, fn):
    """Same query with other cut-off quantiles."""
    sql = base_sql.replace(flags_sql('fa', 0), flags_sql('fa', 0, q)).replace(flags_sql('fb', 1), flags_sql('fb', 1, q))
    QUERIES[name] = fn
    SQL[name] = sql


def _pair(how, **scale):
    return lambda spark, sf: how(_flags(spark, sf, 0, **scale), _flags(spark, sf, 1, **scale))


# compat: the reference's percentile scale (0.95 -> 0.0095); median: half of the users are
# over each cut-off, so that both models flag users that the other does not.
for _suffix, _q, _scale in (("compat", 0.0095, {"compat": True}), ("median", 0.5, {"q": 0.5})):
    for _name, _how in (("overlap", lambda a, b: rounded(CP.flag_overlap(a, b))), ("sets", CP.flag_sets)):
        _scaled(f"compare_flag_{_name}_events_{_suffix}", SQL[f"compare_flag_{_name}_events"], _q, _pair(_how, **_scale))
    _scaled(f"compare_discrepancies_events_{_suffix}", SQL["compare_discrepancies_events"], _q, _pair(lambda a, b: rounded(CP.discrepancies(a, b)), **_scale))
