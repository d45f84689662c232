"""Chart feeds: the data behind the reference's plots (C1 - C11, O2 - O8,
J3, J8 - J10, A15, A17, A18, F10 - F12).  Drawing is not built.

Inputs: ``user_vec(user_id, n_docs, probs)`` from ``users.user_topics``,
``scores`` from ``users.user_scores`` and ``flags`` from
``suspicion.suspicious_users``.  Per-user work is bounded by k topics.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from .suspicion import exact_quantiles


def _long(user_vec: DataFrame) -> DataFrame:
    return user_vec.select("user_id", F.posexplode("probs").alias("topic_id", "p")) \
                   .withColumn("topic_id", F.col("topic_id").cast("int"))


def pie_slices(user_vec: DataFrame, threshold: float = 0.03, other_min: float = 0.01,
               variant: str = "script") -> DataFrame:
    """``(user_id, slice, label, value)``.

    script: topics with p > threshold, else the top two with p > 1e-6;
    'Other' = 1 - shown, kept when > other_min; all-zero users omitted.
    dashboard: topics with p > threshold; 'Other' = sum of the rest, kept
    when > other_min (0.001 there).
    """
    lg = _long(user_vec)
    w = Window.partitionBy("user_id")
    r = lg.withColumn("r", F.row_number().over(w.orderBy(F.col("p").desc(), "topic_id"))) \
          .withColumn("n_sig", F.sum((F.col("p") > threshold).cast("int")).over(w)) \
          .withColumn("any", F.max((F.col("p") != 0).cast("int")).over(w))
    if variant == "script":
        keep = (F.col("any") == 1) & (((F.col("n_sig") > 0) & (F.col("p") > threshold))
                                      | ((F.col("n_sig") == 0) & (F.col("r") <= 2) & (F.col("p") > 1e-6)))
        shown = r.filter(keep)
        agg = shown.groupBy("user_id").agg(F.sum("p").alias("s"))
        other = agg.select("user_id", (F.lit(1.0) - F.col("s")).alias("value"))
    else:
        shown = r.filter(F.col("p") > threshold)
        other = r.groupBy("user_id").agg(F.sum(F.when(F.col("p") <= threshold, F.col("p")).otherwise(0.0)).alias("value"))
    slices = shown.select("user_id", F.col("r").cast("int").alias("slice"),
                          F.concat(F.lit("Topic "), F.col("topic_id").cast("string")).alias("label"),
                          F.col("p").alias("value"))
    oth = other.filter(F.col("value") > other_min).select("user_id", F.lit(999).alias("slice"),
                                                           F.lit("Other").alias("label"), "value")
    return slices.unionByName(oth)


def temporal_top(temporal: DataFrame, top_n: int = 5) -> DataFrame:
    """Per user, the top_n topics by mean over time keep their label,
    the rest sum into 'Other' per time bin: ``(user_id, time_bin, label, prob)``."""
    avg = temporal.groupBy("user_id", "topic_id").agg(F.avg("prob").alias("m"))
    rk = avg.withColumn("r", F.row_number().over(
        Window.partitionBy("user_id").orderBy(F.round("m", 9).desc(), "topic_id"))).select("user_id", "topic_id", "r")
    j = temporal.join(rk, ["user_id", "topic_id"])
    label = F.when(F.col("r") <= top_n, F.concat(F.lit("Topic_"), F.col("topic_id").cast("string"))).otherwise("Other")
    return j.groupBy("user_id", "time_bin", label.alias("label")).agg(F.sum("prob").alias("prob"))


def scatter_feed(scores: DataFrame, flags: DataFrame | None, metric: str = "gini_coefficient") -> DataFrame:
    """Scores left-joined to flags (missing -> Normal), nulls dropped."""
    s = scores.select("user_id", "post_count", F.col(metric).alias("metric_value"))
    if flags is not None:
        s = s.join(flags.select("user_id", F.col("suspicious").alias("_s")), "user_id", "left")
    else:
        s = s.withColumn("_s", F.lit(False))
    ut = F.when(F.coalesce("_s", F.lit(False)), F.lit("Suspicious")).otherwise(F.lit("Normal"))
    return s.select("user_id", "post_count", "metric_value", ut.alias("user_type")).dropna()


def distribution_feed(scatter: DataFrame, qs=(0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Per user type - count, mean and exact quantiles of the metric.

    The groups are the (two) user types; each group's quantiles come from
    ``exact_quantiles`` (bounded work per group, nothing collected whole).
    """
    spark = scatter.sparkSession
    base = scatter.groupBy("user_type").agg(F.count("*").alias("n"), F.avg("metric_value").alias("mean"))
    rows = []
    for (ut,) in scatter.select("user_type").distinct().collect():     # at most two values
        vals = exact_quantiles(scatter.filter(F.col("user_type") == ut), [("metric_value", q) for q in qs])
        rows.append((ut, *[float(v) if v is not None else None for v in vals]))
    names = [f"q{int(q * 100):03d}" for q in qs]
    schema = "user_type string, " + ", ".join(f"{n} double" for n in names)
    qdf = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
    return base.join(qdf, "user_type")


def topic_similarity_matrix(user_vec: DataFrame) -> DataFrame:
    """Cosine similarity of topic columns over users, all (i, j), in one
    aggregate: a user's products are formed in its own row, and nothing is joined on users."""
    pairs = user_vec.select(F.posexplode("probs").alias("i", "pi"), "probs") \
                    .select("i", "pi", F.posexplode("probs").alias("j", "pj"))
    g = pairs.groupBy("i", "j").agg(F.sum(F.col("pi") * F.col("pj")).alias("dot"))      # k * k sums a task are shuffled
    n = g.filter("i = j").select(F.col("i").alias("topic_id"), F.sqrt("dot").alias("n"))
    ni = n.select(F.col("topic_id").alias("i"), F.col("n").alias("ni"))
    nj = n.select(F.col("topic_id").alias("j"), F.col("n").alias("nj"))
    sim = F.when((F.col("ni") > 0) & (F.col("nj") > 0), F.col("dot") / (F.col("ni") * F.col("nj"))).otherwise(0.0)
    return g.join(ni, "i").join(nj, "j").select("i", "j", sim.alias("similarity"))


def topic_network(sim: DataFrame, threshold: float = 0.3):
    """Edges i < j with similarity >= threshold, and node degrees (0 included)."""
    edges = sim.filter((F.col("i") < F.col("j")) & (F.col("similarity") >= threshold))
    ends = edges.select(F.col("i").alias("topic_id")).unionAll(edges.select(F.col("j").alias("topic_id")))
    deg = ends.groupBy("topic_id").agg(F.count("*").alias("degree"))
    nodes = sim.select(F.col("i").alias("topic_id")).distinct().join(deg, "topic_id", "left") \
               .withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return edges, nodes


def user_clusters(user_vec: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """KMeans on topic vectors + 2-D PCA map; fewer users than k -> empty."""
    v = user_vec.select("user_id", array_to_vector("probs").alias("v"))
    n = v.count()
    if n < k:
        return v.select("user_id", F.lit(0).alias("cluster"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    km = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(v)
    c = km.transform(v)
    p = PCA(k=2, inputCol="v", outputCol="xy").fit(c).transform(c)
    xy = vector_to_array("xy")
    return p.select("user_id", F.col("cluster").cast("int"), xy[0].alias("x"), xy[1].alias("y"))


def cluster_stats(assign: DataFrame, scores: DataFrame) -> DataFrame:
    """Users, mean Gini and mean post count per cluster."""
    return assign.join(scores, "user_id").groupBy("cluster").agg(
        F.count("*").alias("num_users"), F.avg("gini_coefficient").alias("avg_gini"),
        F.avg("post_count").alias("avg_posts"))


def cluster_topics(assign: DataFrame, user_vec: DataFrame, top: int = 3) -> DataFrame:
    """Mean topic weight per cluster x topic with its rank (rank <= top kept)."""
    m = _long(user_vec).join(assign, "user_id").groupBy("cluster", "topic_id").agg(F.avg("p").alias("mean_prob"))
    r = m.withColumn("rank", F.row_number().over(
        Window.partitionBy("cluster").orderBy(F.round("mean_prob", 9).desc(), "topic_id")).cast("int"))
    return r.filter(F.col("rank") <= top)


def gini_band(c) -> F.Column:
    """< 0.3 diverse, < 0.7 moderately focused, else highly specialised."""
    return (F.when(c < 0.3, "diverse").when(c < 0.7, "moderately_focused").otherwise("highly_specialized"))


def coherence_band(c) -> F.Column:
    """> 0.6 excellent, > 0.5 good, > 0.4 fair, else poor."""
    return F.when(c > 0.6, "excellent").when(c > 0.5, "good").when(c > 0.4, "fair").otherwise("poor")


def top_users(scores: DataFrame, n: int = 5, by: str = "gini_coefficient") -> DataFrame:
    """O3: the n users with the highest metric (a top-k report)."""
    return scores.orderBy(F.round(by, 9).desc_nulls_last(), "user_id").limit(n)


def membership(df: DataFrame, flags: DataFrame) -> DataFrame:
    """rows whose user is flagged (left semi join)."""
    return df.join(flags.filter(F.col("suspicious")).select("user_id"), "user_id", "left_semi")
