"""Inputs derived from the driver tables (``/root/testdata/sf*/``).

These map the generic tables onto the posts contract and onto fixed
document-topic tables, so every downstream operator can be checked
against an SQL oracle without a trained model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def posts(spark: SparkSession, sf_dir: str, user_from: str = "events") -> DataFrame:
    """``documents`` joined to ``events`` on ``event_id = doc_id``.

    ``user_from='source'`` uses the document source as the user (few, large
    users: the dense near-duplicate case).
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    j = d.join(e, d.doc_id == e.event_id)
    user = F.col("source") if user_from == "source" else F.col("user_id").cast("string")
    return j.select(F.col("doc_id").alias("post_id"), user.alias("user_id"),
                    F.col("ts").alias("timestamp"), F.col("text").alias("post_content"))


def event_topic_ids(events: DataFrame) -> DataFrame:
    """Topic id of each event type = its rank in name order (0-based)."""
    types = events.select("event_type").distinct()
    return types.withColumn("topic_id", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("int"))


def doc_topics_events(spark: SparkSession, sf_dir: str, model: int = 0):
    """One-hot document-topic table over events.

    Returns ``(docs, doc_topics, k)``: docs ``(doc_id, user_id, ts)``;
    doc_topics ``(doc_id, probs ARRAY<DOUBLE>)`` with all k entries.
    ``model`` 0 takes the event type as the topic, 1 the hour of day modulo 5:
    two "models" over the same rows.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    if model == 1:
        k, j = 5, ev.withColumn("topic_id", (F.hour("ts") % 5).cast("int"))
    else:
        ids = event_topic_ids(table(spark, sf_dir, "events")).cache()
        k = ids.count()
        j = ev.join(ids, "event_type")
    docs = j.select(F.col("event_id").cast("string").alias("doc_id"),
                    F.col("user_id").cast("string").alias("user_id"), "ts")
    probs = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                        lambda i: F.when(i == F.col("topic_id"), F.lit(1.0)).otherwise(F.lit(0.0)))
    dt = j.select(F.col("event_id").cast("string").alias("doc_id"), probs.alias("probs"))
    return docs, dt, k


def doc_topics_embed(spark: SparkSession, sf_dir: str, k: int = 64):
    """Magnitudes of all ``k`` dimensions of each embedding, normalised; user = ``label``."""
    em = table(spark, sf_dir, "embeddings")
    head = F.transform("embedding", lambda v: F.abs(v).cast("double"))
    tot = F.aggregate(head, F.lit(0.0).cast("double"), lambda a, b: a + b)
    docs = em.select(F.col("vec_id").cast("string").alias("doc_id"),
                     F.col("label").cast("string").alias("user_id"),
                     F.lit(None).cast("timestamp_ntz").alias("ts"))
    dt = em.select(F.col("vec_id").cast("string").alias("doc_id"),
                   F.when(tot > 0, F.transform(head, lambda v: v / tot))
                    .otherwise(F.transform(head, lambda v: F.lit(0.0))).alias("probs"))
    return docs, dt, k


def doc_topics_from_post_events(spark: SparkSession, sf_dir: str, post_docs: DataFrame):
    """Fixed topic vectors for post-built documents: the share of each
    event type among a document's posts (post_id = event_id).

    Returns ``(doc_topics(doc_id, probs), k)``.
    """
    ev = table(spark, sf_dir, "events")
    ids = event_topic_ids(ev).cache()
    k = ids.count()
    j = post_docs.select("doc_id", "post_id").join(
        ev.select(F.col("event_id").alias("post_id"), "event_type"), "post_id").join(ids, "event_type")
    c = j.groupBy("doc_id", "topic_id").agg(F.count("*").alias("c"))
    per_doc = c.groupBy("doc_id").agg(
        F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("topic_id", "c"))).alias("m"))
    probs = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                        lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double") / F.col("n"))
    return per_doc.select("doc_id", probs.alias("probs")), k
