"""Model-vs-model comparison.

Two "models" are any two user-score / flag / topic-word tables.  All
outputs are flat tables (lists become sorted, comma-joined strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

METRICS = ("gini_coefficient", "shannon_entropy", "top1_ratio")


def _nan_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def join_scores(a: DataFrame, b: DataFrame, suffixes=("_lda", "_bert"),
                cols=("post_count",) + METRICS) -> DataFrame:
    """Inner join on user_id with suffixed metric columns."""
    sa, sb = suffixes
    return a.select("user_id", *[F.col(c).alias(c + sa) for c in cols]).join(
        b.select("user_id", *[F.col(c).alias(c + sb) for c in cols]), "user_id", "inner")


def narrowness_summary(merged: DataFrame, metrics=METRICS, suffixes=("_lda", "_bert")) -> DataFrame:
    """A12 / A13 / A14 (C8): one row per metric, from a single aggregation pass.

    correlation over rows where both sides are defined (< 2 rows -> NULL);
    means / sample std over each side; regression of B on A.
    """
    sa, sb = suffixes
    aggs, structs = [], []
    for i, m in enumerate(metrics):
        x, y = F.col(m + sa), F.col(m + sb)
        both = x.isNotNull() & y.isNotNull()
        xv, yv = F.when(both, x), F.when(both, y)
        vals = [
            ("correlation", F.when(F.count(F.when(both, 1)) >= 2, _nan_null(F.corr(xv, yv)))),
            ("lda_mean", F.avg(x)), ("bert_mean", F.avg(y)),
            ("lda_std", F.stddev_samp(x)), ("bert_std", F.stddev_samp(y)),
            ("mean_difference", F.avg(y) - F.avg(x)),
            ("slope", _nan_null(F.regr_slope(yv, xv))), ("intercept", _nan_null(F.regr_intercept(yv, xv))),
            ("r_squared", _nan_null(F.regr_r2(yv, xv))),
        ]
        aggs += [v.cast("double").alias(f"{n}_{i}") for n, v in vals]
        structs.append(F.struct(F.lit(m).alias("metric"), *[F.col(f"{n}_{i}").alias(n) for n, _ in vals]))
    one = merged.agg(*aggs)
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def flagged(flags: DataFrame) -> DataFrame:
    return flags.filter(F.col("suspicious")).select(F.col("user_id").cast("string").alias("user_id")).distinct()


def flag_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set sizes and overlap percentages (denominator max(1, n))."""
    fa = flagged(a).withColumn("in_a", F.lit(1))
    fb = flagged(b).withColumn("in_b", F.lit(1))
    u = fa.join(fb, "user_id", "full")
    na = F.coalesce(F.sum(F.coalesce("in_a", F.lit(0))), F.lit(0))
    nb = F.coalesce(F.sum(F.coalesce("in_b", F.lit(0))), F.lit(0))
    both = F.coalesce(F.sum(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1).otherwise(0)), F.lit(0))
    s = u.agg(na.alias("total_suspicious_lda"), nb.alias("total_suspicious_bert"), both.alias("overlap_count"))
    return s.select(
        F.col("total_suspicious_lda").cast("long").alias("total_suspicious_lda"),
        F.col("total_suspicious_bert").cast("long").alias("total_suspicious_bert"),
        F.col("overlap_count").cast("long").alias("overlap_count"),
        (F.col("overlap_count") / F.greatest(F.lit(1), "total_suspicious_lda") * 100).alias("overlap_percent_of_lda"),
        (F.col("overlap_count") / F.greatest(F.lit(1), "total_suspicious_bert") * 100).alias("overlap_percent_of_bert"),
        (F.col("total_suspicious_lda") - F.col("overlap_count")).cast("long").alias("lda_only_count"),
        (F.col("total_suspicious_bert") - F.col("overlap_count")).cast("long").alias("bert_only_count"))


def flag_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(user_id, membership)`` with 'both' / 'lda_only' / 'bert_only'."""
    fa, fb = flagged(a), flagged(b)
    both = fa.intersect(fb).withColumn("membership", F.lit("both"))
    a_only = fa.subtract(fb).withColumn("membership", F.lit("lda_only"))
    b_only = fb.subtract(fa).withColumn("membership", F.lit("bert_only"))
    return both.unionByName(a_only).unionByName(b_only)


def discrepancies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Users flagged by exactly one model (missing side = not flagged)."""
    ca = a.select(F.col("user_id").cast("string").alias("user_id"), F.col("suspicious").alias("s_a"),
                  F.col("gini_coefficient").alias("lda_gini"), F.col("post_count").alias("pc_a"),
                  F.col("duplicate_post_ratio").alias("lda_duplicate_ratio"))
    cb = b.select(F.col("user_id").cast("string").alias("user_id"), F.col("suspicious").alias("s_b"),
                  F.col("gini_coefficient").alias("bert_gini"), F.col("post_count").alias("pc_b"),
                  F.col("duplicate_post_ratio").alias("bert_duplicate_ratio"))
    j = ca.join(cb, "user_id", "full")
    sa, sb = F.coalesce("s_a", F.lit(False)), F.coalesce("s_b", F.lit(False))
    model = F.when(sa & ~sb, F.lit("LDA only")).when(~sa & sb, F.lit("BERTopic only"))
    pc = F.when(sa & ~sb, F.coalesce("pc_a", "pc_b")).otherwise(F.coalesce("pc_b", "pc_a"))
    return j.select("user_id", model.alias("model"), "lda_gini", "bert_gini", pc.cast("long").alias("post_count"),
                    "lda_duplicate_ratio", "bert_duplicate_ratio").filter(F.col("model").isNotNull())


def drop_outliers(rows: DataFrame) -> DataFrame:
    """rows whose topic is not the outlier topic -1."""
    return rows.filter(F.col("topic_id") != -1)


def distinct_topics(words: DataFrame, model: str) -> DataFrame:
    """``(model, topics)``: how many topics have words, outliers left out."""
    return drop_outliers(words).agg(F.countDistinct("topic_id").alias("topics")).select(F.lit(model).alias("model"), "topics")


def topic_jaccard(words_a: DataFrame, words_b: DataFrame, topn: int = 20, threshold: float = 0.1) -> DataFrame:
    """Jaccard of top-``topn`` word sets for every topic pair, kept when
    strictly above ``threshold``; shared words sorted and comma-joined."""
    a = words_a.filter(F.col("rank") <= topn).select(F.col("topic_id").alias("lda_topic"), "word").distinct()
    b = drop_outliers(words_b.filter(F.col("rank") <= topn)) \
               .select(F.col("topic_id").alias("bert_topic"), "word").distinct()
    na = a.groupBy("lda_topic").agg(F.count("*").alias("na"))
    nb = b.groupBy("bert_topic").agg(F.count("*").alias("nb"))
    shared = a.join(b, "word").groupBy("lda_topic", "bert_topic").agg(
        F.count("*").alias("num_shared"), F.array_sort(F.collect_list("word")).alias("sw"))
    s = shared.join(na, "lda_topic").join(nb, "bert_topic")
    sim = F.col("num_shared") / (F.col("na") + F.col("nb") - F.col("num_shared"))
    return s.select("lda_topic", "bert_topic", sim.alias("similarity"), F.col("num_shared").cast("long"),
                    F.concat_ws(",", "sw").alias("shared_words")).filter(F.col("similarity") > threshold)


def top_similar_pairs(sims: DataFrame, n: int = 15, n_words: int = 10) -> DataFrame:
    """The n most similar pairs, first ``n_words`` shared words."""
    first = F.concat_ws(",", F.slice(F.split("shared_words", ","), 1, n_words))
    return sims.orderBy(F.col("similarity").desc(), "lda_topic", "bert_topic").limit(n) \
               .withColumn("shared_words", first)


def side_by_side(words_a: DataFrame, words_b: DataFrame, n_topics: int = 5, n_words: int = 10) -> DataFrame:
    """The i-th topic (by id) of each model with its first ``n_words`` words."""
    def prep(w, side):
        t = w.select("topic_id").distinct()
        if side == "bert":
            t = drop_outliers(t)
        t = t.withColumn("i", F.dense_rank().over(Window.orderBy("topic_id")))
        top = w.filter(F.col("rank") <= n_words).groupBy("topic_id").agg(
            F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("ws"))
        return t.join(top, "topic_id").select(
            "i", F.col("topic_id").alias(f"{side}_topic"),
            F.concat_ws(", ", F.transform("ws", lambda s: s["word"])).alias(f"{side}_words"))
    a, b = prep(words_a, "lda"), prep(words_b, "bert")
    return a.join(b, "i").filter(F.col("i") <= n_topics).withColumn("i", F.col("i").cast("int"))


def coherence_comparison(lda_mean: Column, bert_mean: Column) -> list[Column]:
    """Difference and % improvement over A (A = 0 -> +inf / -inf / 0)."""
    diff = bert_mean - lda_mean
    pct = (F.when(lda_mean != 0, diff / F.abs(lda_mean) * 100)
            .when(diff > 0, F.lit(float("inf"))).when(diff < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0)))
    return [lda_mean.alias("lda_coherence_mean"), bert_mean.alias("bert_coherence_mean"),
            diff.alias("difference"), pct.alias("percent_improvement_over_lda")]


def verdicts(coherence_diff: Column, gini_corr: Column, overlap_a: Column, overlap_b: Column) -> list[Column]:
    """F13 as categories (thresholds: coherence +-0.01; Gini correlation
    0.7 / 0.4 / 0.1; mean overlap 60 / 30 %)."""
    coh = (F.when(coherence_diff.isNull(), "unavailable").when(coherence_diff > 0.01, "bert_more_coherent")
            .when(coherence_diff < -0.01, "lda_more_coherent").otherwise("comparable"))
    nar = (F.when(gini_corr.isNull(), "unavailable").when(gini_corr > 0.7, "strong")
            .when(gini_corr > 0.4, "moderate").when(gini_corr > 0.1, "weak").otherwise("low_or_negative"))
    avg = (overlap_a + overlap_b) / 2
    ovl = (F.when(avg.isNull(), "unavailable").when(avg > 60, "high").when(avg > 30, "moderate").otherwise("low"))
    return [coh.alias("coherence_verdict"), nar.alias("narrowness_verdict"), ovl.alias("overlap_verdict")]
