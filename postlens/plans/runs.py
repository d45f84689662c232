"""One-call runs (Entry 1 - 3 of the reference).

``run_lda`` and ``run_embedding`` take posts to named result tables; ``save`` writes them
and ``load`` reads one back.  Every table that is read more than once is written once
(a checkpoint).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import clean as C
from ..operators import coherence as CO
from ..operators import compare as CP
from ..operators import dedup as DD
from ..operators import density as DN
from ..operators import docs as D
from ..operators import embed_topics as E
from ..operators import lda as L
from ..operators import phrases as P
from ..operators import suspicion as SU
from ..operators import users as U
from ..operators import vectors as VX
from ..operators import vocab as V
from ..session import cut_lineage, written
from ..sources.files import read_result
from . import sinks as K


@dataclass(frozen=True)
class TopicConfig:
    k: int = 20
    time_bin: str = "week"
    combine: bool = True
    min_tokens: int = 3
    extra_stopwords: tuple[str, ...] = ()
    seed: int = 42
    passes: int = 20
    week_anchor: str = "monday"          # combine-mode weeks of the LDA path
    temporal_week_anchor: str = "tuesday"
    phrase_min_count: int = 5
    phrase_threshold: float = 10.0
    no_below: int = 3
    no_above: float = 0.6
    keep_n: int | None = None
    topn: int = 20
    compat_percentile: bool = False
    min_cluster_size: int = 15
    dims: int = 5
    extra: dict = field(default_factory=dict)


def post_tokens(posts: DataFrame, cfg: TopicConfig = TopicConfig(), persist: bool = True):
    """posts -> tokens (>= min) -> learned phrases -> merged tokens (>= min).

    Returns ``(tokens, phrases)``; ``tokens`` has post_id, user_id, timestamp, tokens.  Both
    token tables are written (a cache of lists of strings is several times the text's size).
    """
    tok = C.lda_tokenize(posts.select("post_id", "user_id", "timestamp", "post_content"),
                         C.TokenConfig(extra_stopwords=cfg.extra_stopwords, min_tokens=cfg.min_tokens))
    tok = tok.drop("post_content")
    if persist:
        tok = written(tok)
    phr = P.learn_phrases(tok, cfg.phrase_min_count, cfg.phrase_threshold)
    merged = P.apply_phrases(tok, phr).filter(F.size("tokens") >= cfg.min_tokens)
    if persist:
        merged = written(merged)
    return merged, phr


def fit_topics(posts: DataFrame, cfg: TopicConfig = TopicConfig()) -> dict:
    """Posts -> tokens -> documents -> vocabulary -> LDA; every table is written once."""
    tok, phrases = post_tokens(posts, cfg)
    post_docs, docs = post_documents(tok, cfg)
    docs = cut_lineage(docs)
    terms = cut_lineage(V.doc_terms(post_docs))
    vocab = cut_lineage(V.filter_extremes(V.document_frequency(terms), docs.count(), cfg.no_below, cfg.no_above, cfg.keep_n))
    bow = cut_lineage(V.bag_of_words(terms, vocab).select("doc_id", "term_index", "tf"))
    model = L.fit_lda(bow, k=cfg.k, passes=cfg.passes, seed=cfg.seed)
    return dict(tok=tok, phrases=phrases, post_docs=post_docs, docs=docs, vocab=vocab, bow=bow, model=model,
                doc_topics=cut_lineage(L.document_topics(model, bow)), k=cfg.k)


def post_documents(tokens: DataFrame, cfg: TopicConfig = TopicConfig()):
    """tokens -> ``(post_docs, docs)`` for the configured binning / combine mode."""
    pd_ = D.assign_docs(tokens, cfg.time_bin, cfg.combine, cfg.week_anchor)
    return pd_, D.docs_table(pd_)


def user_topic_wide(scores: DataFrame, k: int) -> DataFrame:
    """K2: scores with one column a topic, ``Topic_0`` to ``Topic_<k - 1>``."""
    cols = [F.coalesce(F.get("probs", F.lit(i)), F.lit(0.0)).alias(f"Topic_{i}") for i in range(k)]
    return scores.select(*[c for c in scores.columns if c != "probs"], *cols)


def _results(doc_topics: DataFrame, docs: DataFrame, k: int, tokens: DataFrame, words: DataFrame, lengths: DataFrame, positions: DataFrame,
             topics, cfg: TopicConfig, detect_suspicious: bool) -> dict[str, DataFrame]:
    """The tables that both kinds of run end in."""
    scores = cut_lineage(U.user_scores(U.user_topics(doc_topics, docs, max(k, 1))))
    coherence = cut_lineage(CO.coherence_cv(words, positions, lengths))
    out = {"topic_words": words, "coherence": coherence, "user_topic_data": user_topic_wide(scores, k),
           "temporal_topics": U.user_temporal(doc_topics, docs, max(k, 1), cfg.time_bin, cfg.temporal_week_anchor)}
    summary = docs.agg(F.count("*").alias("num_documents"), F.countDistinct("user_id").alias("num_users")).select(
        "*", topics.alias("num_topics"), CO.model_coherence(coherence).select("coherence_mean").scalar().alias("coherence_score"))
    if detect_suspicious:
        ratios = DD.duplicate_ratios(tokens)
        flags = cut_lineage(SU.suspicious_users(scores.drop("probs"), ratios, compat=cfg.compat_percentile))
        out["suspicious_users"] = SU.flag_reasons(flags)
        summary = summary.withColumn("suspicious_users_detected", flags.agg(F.count_if("suspicious")).scalar())
    return out | {"run_summary": summary}


def run_lda(posts: DataFrame, cfg: TopicConfig = TopicConfig(), detect_suspicious: bool = True, fitted: dict | None = None) -> dict[str, DataFrame]:
    """Posts -> LDA topics -> user scores, temporal topics, coherence, suspicious users, summary.

    ``fitted``: what ``fit_topics`` gave, to spare a second fit."""
    f = fitted or fit_topics(posts, cfg)
    words = cut_lineage(L.topic_words(f["model"], f["vocab"], cfg.topn))
    positions = D.token_positions(f["post_docs"], D.post_offsets(f["post_docs"]), keep=words.select(F.col("word").alias("term")))
    lengths = f["docs"].select("doc_id", F.col("n_tokens").alias("L"))
    return _results(f["doc_topics"], f["docs"], f["k"], f["tok"], words, lengths, positions, F.lit(f["k"]), cfg, detect_suspicious)


def run_embedding(posts: DataFrame, cfg: TopicConfig = TopicConfig(), detect_suspicious: bool = True, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """Posts (one document each) -> vectors -> density topics -> the tables of ``run_lda``, and
    ``topic_info`` and ``topic_embeddings`` (M5 - M12).

    ``vectors`` ``(doc_id, embedding)``, by ``post_id``, replaces the hashed TF-IDF vectors."""
    pre = C.embed_preprocess(posts.select("post_id", "user_id", "timestamp", "post_content"), cfg.extra_stopwords, cfg.min_tokens)
    docs = cut_lineage(pre.select(F.col("post_id").alias("doc_id"), "post_id", "user_id", "timestamp", F.col("timestamp").alias("ts"), "processed_text", "tokens"))
    vectors = cut_lineage(VX.features(VX.hashed_tfidf(docs))) if vectors is None else vectors
    reduced = cut_lineage(E.reduce_dims(vectors, k=cfg.dims))
    topic = cut_lineage(DN.cluster(reduced, cfg.min_cluster_size))
    centers = E.centroids(reduced, topic)
    terms = cut_lineage(E.class_terms(docs, topic, stopwords=T.stopword_set(cfg.extra_stopwords)))
    weights, idf = E.class_tfidf(terms)
    words = cut_lineage(E.top_words(weights, cfg.topn))
    inliers = CP.drop_outliers(words)
    top = inliers.filter(F.col("rank") <= 10)                     # coherence takes ten words here
    positions = docs.select("doc_id", F.posexplode("tokens").alias("pos", "term")).join(top.select(F.col("word").alias("term")).distinct(), "term", "left_semi")
    lengths = docs.select("doc_id", F.size("tokens").alias("L"))
    found = CP.drop_outliers(topic).agg(F.countDistinct("topic_id")).scalar()
    out = _results(E.soft_membership(reduced, centers), docs, len(centers), docs, inliers, lengths, positions, found, cfg, detect_suspicious)
    out["topic_info"] = E.topic_info(topic, words.filter(F.col("rank") <= 10), E.representative_docs(terms, weights, idf, 3), docs=docs)
    plain = vectors if dict(vectors.dtypes)["embedding"].startswith("array") else vectors.select("doc_id", vector_to_array("embedding").alias("embedding"))
    out["topic_embeddings"] = E.topic_embeddings(plain, CP.drop_outliers(topic))
    return out


def save(results: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Writes the tables of a run (K2 - K8): ``{name: path}``."""
    return K.write_results(results, out_dir)


def load(spark, out_dir: str, name: str) -> DataFrame | None:
    """One table of a saved run, None if it was not saved."""
    return read_result(spark, f"{out_dir}/{name}")
