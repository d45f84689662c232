"""Embedding topics (M6, M8 - M12, M14): vectors -> reduce -> cluster -> c-TF-IDF.

``vectors`` makes the vectors and ``density`` the clusters, with -1 for outliers; the
reduction is L2 ``Normalizer`` + ``PCA``.  Soft memberships are normalised inverse
distances to the topics' centroids, computed against a literal array of them
(topics x dims values, at most ``MOST_TOPICS`` topics) - no join at all.

Class-based TF-IDF (Grootendorst 2022): ``W(t,c) = sqrt(tf(t,c) / sum_t tf)
* ln(1 + A / f(t))`` with ``A = int(mean words per class)`` and ``f(t)``
the term's total count; classes include -1.
"""

from __future__ import annotations

import json

from pyspark.ml.feature import Normalizer, PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..session import cut_lineage, written
from .clean import fence, once


def reduce_dims(emb: DataFrame, key: str = "doc_id", col: str = "embedding", k: int = 5) -> DataFrame:
    """M6: ``(key, reduced ARRAY<DOUBLE>)`` - unit-normalise, then PCA(k).  ``col`` holds
    arrays of numbers or ``spark.ml`` vectors."""
    given = F.col(col)
    if dict(emb.dtypes)[col].startswith("array"):
        given = array_to_vector(F.transform(col, lambda x: x.cast("double")))
    v = emb.select(key, given.alias("v"))
    n = Normalizer(inputCol="v", outputCol="u", p=2.0).transform(v)
    pca = PCA(k=k, inputCol="u", outputCol="r").fit(n)
    return pca.transform(n).select(key, vector_to_array("r").alias("reduced"))


MOST_TOPICS = 5_000


def centroids(reduced: DataFrame, assignment: DataFrame, key: str = "doc_id") -> list[list[float]]:
    """Mean reduced vector of each topic from 0 up (-1 has none)."""
    ex = reduced.select(key, F.posexplode("reduced").alias("i", "v")).join(assignment.filter("topic_id <> -1").select(key, "topic_id"), key)
    mean = ex.groupBy("topic_id", "i").agg(F.avg("v").alias("v"))
    rows = mean.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e")).orderBy("topic_id").limit(MOST_TOPICS + 1).collect()
    if len(rows) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics: raise min_cluster_size or merge topics first (reduce_topics)")
    return [[x["v"] for x in r["e"]] for r in rows]


def soft_membership(reduced: DataFrame, centers: list[list[float]], key: str = "doc_id",
                    eps: float = 1e-9) -> DataFrame:
    """M8: ``(key, probs)``: normalised 1 / (eps + euclidean distance) per centroid; no
    entries if there is no topic."""
    if not centers:
        return reduced.select(key, F.array().cast("array<double>").alias("probs"))
    cent = F.from_json(F.lit(json.dumps(centers)), "array<array<double>>")      # one literal in the plan, not one a number
    dist = F.transform(cent, lambda c: F.sqrt(F.aggregate(
        F.zip_with(c, F.col("reduced"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    inv = F.transform(dist, lambda d: F.lit(1.0) / (d + eps))
    rows = once(reduced.select(key, "reduced"), _inv=inv)          # not anew for each topic
    rows = once(rows, _tot=F.aggregate("_inv", F.lit(0.0), lambda s, x: s + x))
    return rows.select(key, F.transform("_inv", lambda x: x / F.col("_tot")).alias("probs"))


def class_terms(docs: DataFrame, assignment: DataFrame, key: str = "doc_id",
                text_col: str = "processed_text", stopwords=None) -> DataFrame:
    """Per-document term counts with the document's class: ``(key, topic_id, term, tf)``."""
    stops = sorted(set(stopwords if stopwords is not None else T.ENGLISH_STOPWORDS))
    named = docs.filter(F.col(key).isNotNull())
    toks = fence(named.select(key, T.drop_stopwords(T.tokenize_words(F.lower(F.col(text_col)), 2), stops).alias("t")), "t").filter(F.size("t") > 0)
    # Counted row by row: no task holds the terms of more than a document.  Only the
    # terms of rows that share a key are added up.
    again = cut_lineage(named.groupBy(key).count().filter("count > 1").select(key))
    classes = assignment.groupBy(key, "topic_id").agg(F.count("*").alias("_copies"))
    if again.isEmpty():
        ex = _counted(toks.join(classes, key), [key, "topic_id", "_copies"])
    else:
        ex = _counted(toks.join(again, key, "left_anti").join(classes, key), [key, "topic_id", "_copies"])
        more = _counted(toks.join(again, key, "left_semi"), [key]).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
        ex = ex.unionByName(more.join(classes, key))
    return ex.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(key, "topic_id", "term", "tf")


def _counted(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``(*keep, term, tf)`` of each row: the runs of its sorted tokens ``t``."""
    rows = once(rows.select(*keep, "t"), _s=F.array_sort("t")).drop("t")
    first = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    rows = once(rows, _at=first)
    runs = F.transform("_at", lambda p, k: F.struct(F.get("_s", p).alias("term"), (F.coalesce(F.get("_at", k + 1), F.size("_s")) - p).cast("long").alias("tf")))
    return rows.select(*keep, F.inline(runs))


def class_tfidf(dterms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M9: ``(ctfidf(topic_id, term, weight), idf(term, idf))``."""
    tf = written(dterms.groupBy("topic_id", "term").agg(F.sum("tf").alias("tf")))    # read three times
    tot = tf.groupBy("topic_id").agg(F.sum("tf").alias("s"))
    a = tot.agg(F.floor(F.avg("s")).cast("double")).scalar()
    f = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    idf = f.select("term", F.log(F.lit(1.0) + a / F.col("f")).alias("idf"))
    w = tf.join(tot, "topic_id").join(idf, "term").select(
        "topic_id", "term", (F.sqrt(F.col("tf") / F.col("s")) * F.col("idf")).alias("weight"))
    return w, idf


def top_words(ctfidf: DataFrame, n: int = 10) -> DataFrame:
    """``(topic_id, word, weight, rank)``, rank 1-based by weight desc, word asc."""
    w = Window.partitionBy("topic_id").orderBy(F.col("weight").desc(), "term")
    r = ctfidf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return r.select("topic_id", F.col("term").alias("word"), "weight", F.col("rank").cast("int"))


def topic_info(assignment: DataFrame, words: DataFrame, representatives: DataFrame | None = None, key: str = "doc_id",
               docs: DataFrame | None = None, text_col: str = "processed_text") -> DataFrame:
    """``(Topic, Count, Name, Representation[, Representative_Docs])``; Name = id_w1_w2_w3_w4,
    Representation = the words by rank, Representative_Docs = the texts of
    ``representative_docs`` by rank (given with ``docs``)."""
    cnt = assignment.groupBy("topic_id").agg(F.count("*").alias("Count"))
    ranked = words.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("w"))
    name = F.concat_ws("_", F.col("topic_id").cast("string"), F.concat_ws("_", F.slice("w", 1, 4)))
    out = cnt.join(ranked, "topic_id", "left")
    cols = [F.col("topic_id").alias("Topic"), "Count", name.alias("Name"), F.coalesce("w", F.array().cast("array<string>")).alias("Representation")]
    if representatives is not None:
        texts = representatives.select("topic_id", "rank", key).join(docs.select(key, F.col(text_col).alias("t")), key)
        texts = texts.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda s: s["t"]).alias("docs"))
        out = out.join(texts, "topic_id", "left")
        cols.append(F.coalesce("docs", F.array().cast("array<string>")).alias("Representative_Docs"))
    return out.select(*cols)


def representative_docs(dterms: DataFrame, ctfidf: DataFrame, idf: DataFrame, n: int = 3,
                        key: str = "doc_id") -> DataFrame:
    """The n documents per topic whose c-TF-IDF vector is most cosine-similar
    to their topic's vector: ``(topic_id, rank, key, similarity)``."""
    tot = dterms.groupBy(key).agg(F.sum("tf").alias("s"))
    dw = written(dterms.join(tot, key).join(idf, "term").select(
        key, "topic_id", "term", (F.sqrt(F.col("tf") / F.col("s")) * F.col("idf")).alias("wd")))
    dn = dw.groupBy(key).agg(F.sqrt(F.sum(F.col("wd") * F.col("wd"))).alias("dn"))
    tn = ctfidf.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("tn"))
    dot = dw.join(ctfidf, ["topic_id", "term"]).groupBy(key, "topic_id").agg(
        F.sum(F.col("wd") * F.col("weight")).alias("dot"))
    sim = dot.join(dn, key).join(tn, "topic_id").select(
        key, "topic_id", (F.col("dot") / (F.col("dn") * F.col("tn"))).alias("similarity"))
    # rank on 9 decimals: equal similarities summed in another order must tie
    w = Window.partitionBy("topic_id").orderBy(F.round("similarity", 9).desc(), key)
    r = sim.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return r.select("topic_id", F.col("rank").cast("int"), key, "similarity")


def topic_similarity(ctfidf: DataFrame) -> DataFrame:
    """Cosine similarity of c-TF-IDF vectors for every topic pair (a < b); k^2 rows."""
    n = ctfidf.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    a = ctfidf.select(F.col("topic_id").alias("a"), "term", F.col("weight").alias("wa"))
    b = ctfidf.select(F.col("topic_id").alias("b"), "term", F.col("weight").alias("wb"))
    dot = a.join(b, "term").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(
        F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na = n.select(F.col("topic_id").alias("a"), F.col("n").alias("na"))
    nb = n.select(F.col("topic_id").alias("b"), F.col("n").alias("nb"))
    return dot.join(na, "a").join(nb, "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cos"))


def reduce_topics(dterms: DataFrame, nr_topics: int, key: str = "doc_id") -> DataFrame:
    """Merge the most similar pair of (non-outlier) topics until
    ``nr_topics`` remain (the count includes -1 when present); the smaller
    topic joins the larger.  Returns the re-labelled ``dterms``, which is read three
    times: give a written table.

    The merges work on the table of (topic, term, tf) counts; the documents are read once
    for it and once more for the labels at the end.  The driver sees the sizes of the
    topics and one pair a merge.
    """
    sizes = dict(dterms.groupBy("topic_id").agg(F.countDistinct(key)).collect())   # <= k values
    counts = cut_lineage(dterms.groupBy("topic_id", "term").agg(F.sum("tf").alias("tf")))
    now = {t: t for t in sizes}
    while len(set(now.values())) > nr_topics:
        merged = counts.withColumn("topic_id", _relabel(now)).groupBy("topic_id", "term").agg(F.sum("tf").alias("tf"))
        w, _ = class_tfidf(merged.filter(F.col("topic_id") != -1))
        pair = topic_similarity(w).orderBy(F.col("cos").desc(), "a", "b").first()
        if pair is None:
            break
        a, b = pair["a"], pair["b"]
        src, dst = (a, b) if sizes[a] < sizes[b] else (b, a)
        sizes[dst] += sizes.pop(src)
        now = {t: dst if to == src else to for t, to in now.items()}
    return dterms.withColumn("topic_id", _relabel(now))


def _relabel(now: dict[int, int]):
    changed = [x for t, to in now.items() if t != to for x in (F.lit(t), F.lit(to))]
    return F.coalesce(F.element_at(F.create_map(*changed), F.col("topic_id")), F.col("topic_id")) if changed else F.col("topic_id")


def topic_embeddings(emb: DataFrame, assignment: DataFrame, key: str = "doc_id",
                     col: str = "embedding") -> DataFrame:
    """K6: mean embedding per topic, long form ``(topic_id, dim, value)``.

    Partial aggregation per (topic, dimension); nothing per topic is collected.
    """
    ex = emb.select(key, F.posexplode(col).alias("dim", "v")).join(assignment.select(key, "topic_id"), key)
    return ex.groupBy("topic_id", "dim").agg(F.avg(F.col("v").cast("double")).alias("value")) \
             .withColumn("dim", F.col("dim").cast("int"))
