"""Registered queries: embedding topics.

Every document gets a vector by feature hashing (M5).  With the given ``label`` as the
topic, -1 where a document has none, c-TF-IDF, topic info and representative documents
have exact SQL oracles; the fitted path (PCA, density clusters) is checked by
properties, and its clusters against a plain version in the tests.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import clean as C
from ..operators import compare as CP
from ..operators import density as DN
from ..operators import embed_topics as E
from ..operators import layout as LY
from ..operators import suspicion as SU
from ..operators import users as U
from ..operators import vectors as VX
from ..session import cut_lineage, written
from ..sources import fixtures as FX
from . import sqltext as S
from .common import rounded

QUERIES = {}
SQL = {}
ROWS_ONLY = {"density_clusters_embeddings", "density_inlier_counts", "embed_topics_ctfidf", "embed_doc_topic_probs", "embed_user_scores", "reduce_topics_label",
             "topic_map_2d", "embed_run_summary", "neighbour_map_embeddings", "neighbour_preservation_embeddings"}
STOPS = T.stopword_set()


def _reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def embed_docs(spark, sf):
    """All documents, embedding-path cleaned, >= 3 words; ``label`` -1 where none is given."""
    e = FX.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    d = FX.table(spark, sf, "documents").select("doc_id", "text")
    j = d.join(e, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    return C.embed_preprocess(j, text_col="text")


def _label_terms(spark, sf):
    docs = written(embed_docs(spark, sf).select("doc_id", "label", "processed_text"))
    assign = docs.select("doc_id", F.col("label").cast("int").alias("topic_id"))
    return written(E.class_terms(docs, assign)), assign, docs


DOCS_SQL = f"""
ed AS (SELECT d.doc_id, CAST(COALESCE(e.label, -1) AS INTEGER) AS topic_id, {S.embed_text('d.text', STOPS)} AS p
       FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
ed3 AS (SELECT * FROM ed WHERE len({S.tokenize_ws('p')}) >= 3),
dt AS (SELECT doc_id, topic_id, term, COUNT(*) AS tf FROM (
         SELECT doc_id, topic_id, unnest(regexp_extract_all(lower(p), {S.q('(' + T.WORD + '{2,})')}, 1)) AS term FROM ed3)
       WHERE NOT list_contains({S.lst(STOPS)}, term) GROUP BY 1, 2, 3),
tf AS (SELECT topic_id, term, SUM(tf) AS tf FROM dt GROUP BY 1, 2),
tot AS (SELECT topic_id, SUM(tf) AS s FROM tf GROUP BY 1),
aa AS (SELECT CAST(FLOOR(AVG(s)) AS DOUBLE) AS a FROM tot),
idf AS (SELECT term, ln(1.0 + aa.a / SUM(tf)) AS idf FROM tf, aa GROUP BY term, aa.a),
w AS (SELECT tf.topic_id, tf.term, sqrt(tf.tf * 1.0 / tot.s) * idf.idf AS weight
      FROM tf JOIN tot USING (topic_id) JOIN idf USING (term)),
tw AS (SELECT topic_id, term AS word, weight,
              CAST(ROW_NUMBER() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM w)"""


@_reg("ctfidf_label_topics", f"""
WITH {DOCS_SQL}
SELECT topic_id, word, ROUND(weight, 6) AS weight, rank FROM tw WHERE rank <= 10
""")
def q_ctfidf_label_topics(spark, sf):
    dt, _, _ = _label_terms(spark, sf)
    w, _ = E.class_tfidf(dt)
    return rounded(E.top_words(w, 10))


SIM_SQL = """
ds AS (SELECT doc_id, SUM(tf) AS s FROM dt GROUP BY 1),
dw AS (SELECT dt.doc_id, dt.topic_id, dt.term, sqrt(dt.tf * 1.0 / ds.s) * idf.idf AS wd
       FROM dt JOIN ds USING (doc_id) JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(SUM(wd * wd)) AS dn FROM dw GROUP BY 1),
tn AS (SELECT topic_id, sqrt(SUM(weight * weight)) AS tn FROM w GROUP BY 1),
dot AS (SELECT dw.doc_id, dw.topic_id, SUM(dw.wd * w.weight) AS dot FROM dw JOIN w USING (topic_id, term) GROUP BY 1, 2),
sim AS (SELECT dot.doc_id, dot.topic_id, dot.dot / (dn.dn * tn.tn) AS similarity
        FROM dot JOIN dn USING (doc_id) JOIN tn USING (topic_id)),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY topic_id ORDER BY ROUND(similarity, 9) DESC, doc_id) AS INTEGER) AS rank FROM sim)"""


@_reg("representative_docs_label_topics", f"""
WITH {DOCS_SQL},
{SIM_SQL}
SELECT topic_id, rank, doc_id, ROUND(similarity, 6) AS similarity FROM r WHERE rank <= 3
""")
def q_representative_docs_label_topics(spark, sf):
    dt, _, _ = _label_terms(spark, sf)
    w, idf = E.class_tfidf(dt)
    return rounded(E.representative_docs(dt, w, idf, 3))


@_reg("topic_info_label_topics", f"""
WITH {DOCS_SQL},
{SIM_SQL},
cnt AS (SELECT topic_id, COUNT(*) AS Count FROM ed3 GROUP BY 1),
nm AS (SELECT topic_id, CAST(topic_id AS VARCHAR) || '_' || string_agg(word, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS Name,
              list(word ORDER BY rank) AS Representation FROM tw WHERE rank <= 10 GROUP BY topic_id),
rd AS (SELECT r.topic_id, list(ed3.p ORDER BY r.rank) AS Representative_Docs FROM r JOIN ed3 USING (doc_id) WHERE r.rank <= 3 GROUP BY 1)
SELECT cnt.topic_id AS Topic, cnt.Count, nm.Name, nm.Representation, rd.Representative_Docs
FROM cnt LEFT JOIN nm USING (topic_id) LEFT JOIN rd USING (topic_id)
""")
def q_topic_info_label_topics(spark, sf):
    """Counts, names, ten words and three texts of each topic, -1 included."""
    dt, assign, docs = _label_terms(spark, sf)
    w, idf = E.class_tfidf(dt)
    return E.topic_info(assign, E.top_words(w, 10), E.representative_docs(dt, w, idf, 3), docs=docs)


@_reg("hashed_vectors_documents", f"""
WITH {DOCS_SQL},
n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM ed3),
h AS (SELECT term, ln((1 + n.n) / (1 + COUNT(*))) + 1 AS idf, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS h FROM dt, n GROUP BY term, n.n),
v AS (SELECT doc_id, CAST(h % 256 AS INTEGER) AS slot, SUM(tf * idf * (1 - 2 * ((h // 256) % 2))) AS v FROM dt JOIN h USING (term) GROUP BY 1, 2),
nn AS (SELECT doc_id, sqrt(SUM(v * v)) AS norm FROM v GROUP BY 1)
SELECT doc_id, slot, ROUND(CASE WHEN norm > 0 THEN v / norm ELSE 0 END, 6) AS value FROM v JOIN nn USING (doc_id)
""")
def q_hashed_vectors_documents(spark, sf):
    """M5: hashed TF-IDF vector of every document, long form."""
    v = VX.hashed_tfidf(written(embed_docs(spark, sf).select("doc_id", "processed_text")))
    return rounded(v.select("doc_id", F.explode(F.arrays_zip("slots", "values")).alias("e")).select("doc_id", F.col("e.slots").alias("slot"), F.col("e.values").alias("value")))


@_reg("density_clusters_embeddings")
def q_density_clusters_embeddings(spark, sf):
    """M6 + M7 on the given vectors: density clusters, outliers and strengths."""
    e = FX.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rounded(DN.cluster(E.reduce_dims(e, k=5)))


_FITS: dict = {}


def embed_fit(spark, sf, min_cluster_size: int = 15):
    """Documents, reduced vectors, topics and centroids; fitted once for each Spark
    application and folder, and kept as written tables."""
    key = (spark.sparkContext.applicationId, sf, min_cluster_size)
    if key not in _FITS:
        docs = written(embed_docs(spark, sf).drop("text", "tokens"))
        red = written(E.reduce_dims(written(VX.features(VX.hashed_tfidf(docs))), k=5))
        assign = written(DN.cluster(red, min_cluster_size))
        _FITS[key] = docs, red, assign, E.centroids(red, assign)
    return _FITS[key]


@_reg("density_inlier_counts")
def q_density_inlier_counts(spark, sf):
    """F7 + A19: documents, users and mean strength of each topic, outliers left out."""
    _, _, assign, _ = embed_fit(spark, sf)
    ev = FX.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "user_id")
    inliers = CP.drop_outliers(assign).join(ev, "doc_id", "left")
    return rounded(inliers.groupBy("topic_id").agg(F.count("*").alias("documents"), F.countDistinct("user_id").alias("users"), F.avg("strength").alias("mean_strength")))


@_reg("embed_topics_ctfidf")
def q_embed_topics_ctfidf(spark, sf):
    """M5 - M9: hashed vectors -> PCA(5) -> density clusters, outliers -> c-TF-IDF top words."""
    docs, _, assign, _ = embed_fit(spark, sf)
    w, _ = E.class_tfidf(E.class_terms(docs, assign))
    return rounded(E.top_words(w, 10))


@_reg("embed_doc_topic_probs")
def q_embed_doc_topic_probs(spark, sf):
    """M8: soft memberships, long form (sum to 1 per document)."""
    _, red, _, centers = embed_fit(spark, sf)
    sm = E.soft_membership(red, centers)
    return rounded(U.doc_topics_long(sm).withColumn("topic_id", F.col("topic_id").cast("int")))


@_reg("embed_user_scores")
def q_embed_user_scores(spark, sf):
    """Embedding-path user scores: posts' users over soft memberships."""
    _, red, _, centers = embed_fit(spark, sf)
    sm = E.soft_membership(red, centers)
    ev = FX.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"),
                                                F.col("user_id").cast("string").alias("user_id"))
    docs = ev.join(sm.select("doc_id"), "doc_id")
    return rounded(U.user_scores(U.user_topics(sm, docs, max(len(centers), 1))).drop("probs"))


@_reg("reduce_topics_label")
def q_reduce_topics_label(spark, sf):
    """Merge label topics down to 5 (outliers included in the count), then top words."""
    dt, _, _ = _label_terms(spark, sf)
    red = E.reduce_topics(dt, 5)
    w, _ = E.class_tfidf(red)
    return rounded(E.top_words(w, 10))


@_reg("topic_map_2d")
def q_topic_map_2d(spark, sf):
    """2-D PCA map of document-topic vectors, coloured by dominant topic."""
    _, red, _, centers = embed_fit(spark, sf)
    sm = E.soft_membership(red, centers).select("doc_id", "probs", array_to_vector("probs").alias("v"))
    if len(centers) < 2:                       # nothing to spread in two directions
        x = F.coalesce(F.get("probs", F.lit(0)), F.lit(0.0))
        return rounded(sm.select("doc_id", x.alias("x"), F.lit(0.0).alias("y"), M.first_argmax("probs").alias("dominant_topic")))
    p = PCA(k=2, inputCol="v", outputCol="xy").fit(sm).transform(sm)
    xy = vector_to_array("xy")
    return rounded(p.select("doc_id", xy[0].alias("x"), xy[1].alias("y"), M.first_argmax("probs").alias("dominant_topic")))


def _given_vectors(spark, sf):
    return FX.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


@_reg("neighbour_map_embeddings")
def q_neighbour_map_embeddings(spark, sf):
    """Two coordinates of every vector that keep its neighbours near, with its label."""
    e = _given_vectors(spark, sf)
    xy = LY.neighbour_layout(e).select("doc_id", F.col("layout")[0].alias("x"), F.col("layout")[1].alias("y"))
    return rounded(xy.join(e.select("doc_id", "label"), "doc_id"))


@_reg("neighbour_preservation_embeddings")
def q_neighbour_preservation_embeddings(spark, sf):
    """M6: share of the 15 nearest vectors kept by the neighbour map and by PCA, two coordinates each."""
    e = _given_vectors(spark, sf)
    found = LY.neighbours(e)
    maps = {"neighbours": LY.neighbour_layout(e, found=found), "pca": E.reduce_dims(e, k=2).withColumnRenamed("reduced", "layout")}
    return rounded(LY.preservation(e, maps, found=found), 4)


@_reg("embed_run_summary")
def q_embed_run_summary(spark, sf):
    """Documents, users, topics found (without -1), outliers, suspicious users."""
    _, red, assign, centers = embed_fit(spark, sf)
    ev = FX.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("user_id").cast("string").alias("user_id"))
    owned = assign.join(ev, "doc_id", "left")
    sums = owned.agg(F.count("*").alias("num_documents"), F.countDistinct("user_id").alias("num_users"),
                     F.countDistinct(F.when(F.col("topic_id") != -1, F.col("topic_id"))).alias("num_topics"),
                     F.sum((F.col("topic_id") == -1).cast("int")).alias("num_outliers"))
    if not centers:
        return sums.withColumn("suspicious_users_detected", F.lit(0).cast("long"))
    docs = ev.join(red.select("doc_id"), "doc_id")
    scores = cut_lineage(U.user_scores(U.user_topics(E.soft_membership(red, centers), docs, len(centers))).drop("probs"))
    flagged = SU.suspicious_users(scores).agg(F.sum(F.col("suspicious").cast("long"))).scalar()
    return sums.withColumn("suspicious_users_detected", F.coalesce(flagged, F.lit(0)))


@_reg("topic_embeddings_label", """
WITH e AS (SELECT vec_id, CAST(label AS INTEGER) AS topic_id, embedding FROM embeddings),
x AS (SELECT topic_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
             CAST(unnest(embedding) AS DOUBLE) AS v FROM e)
SELECT topic_id, dim, ROUND(AVG(v), 6) AS value FROM x GROUP BY topic_id, dim
""")
def q_topic_embeddings_label(spark, sf):
    """K6: topic embeddings (mean input embedding per topic) for the label assignment."""
    e = FX.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    assign = e.select("doc_id", F.col("label").cast("int").alias("topic_id"))
    return rounded(E.topic_embeddings(e, assign))
