"""Registered queries: sources, cleaning, tokens, TF-IDF (S*, T*, F1 - F5, V8, U1)."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Window, functions as F

from ..functions import stem as ST
from ..functions import text as T
from ..operators import clean as C
from ..operators import replace as R
from ..operators import vocab as V
from ..operators import words as W
from ..sources import adapters as A
from ..sources import fixtures as FX
from . import sqltext as S
from .common import rounded

QUERIES = {}
SQL = {}


def _reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


STOPS = T.stopword_set()
MULTI = C.MultilingualOptions()
EXTRACT = C.CleanOptions(hashtags="extract", mentions="extract", remove_special_chars=True)


@_reg("lda_term_counts_documents", f"""
WITH t AS (SELECT doc_id, {S.lda_tokens('text', STOPS)} AS tokens FROM documents),
e AS (SELECT doc_id, unnest(tokens) AS term FROM t WHERE len(tokens) >= 3)
SELECT term, COUNT(DISTINCT doc_id) AS n_docs, COUNT(*) AS n_occ FROM e GROUP BY term
""")
def q_lda_term_counts_documents(spark, sf):
    docs = FX.table(spark, sf, "documents")
    tok = C.lda_tokenize(docs, text_col="text")
    ex = tok.select("doc_id", F.explode("tokens").alias("term"))
    return ex.groupBy("term").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_occ"))


@_reg("stemmed_terms_documents", f"""
WITH t AS (SELECT doc_id, {S.lda_tokens('text', STOPS)} AS tokens FROM documents),
e AS (SELECT unnest(tokens) AS term FROM t WHERE len(tokens) >= 3),
v AS (SELECT term, COUNT(*) AS n FROM e GROUP BY term),
{ST.stems_sql('v')}
SELECT stem, COUNT(*) AS n_terms, CAST(SUM(n) AS BIGINT) AS n_occ, MIN(term) AS first_term FROM stems GROUP BY stem
""")
def q_stemmed_terms_documents(spark, sf):
    """Stems of the vocabulary; each distinct word is stemmed once."""
    tok = C.lda_tokenize(FX.table(spark, sf, "documents"), text_col="text")
    vocab = tok.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return (C.normal_forms(vocab, stem=True).groupBy(F.col("norm").alias("stem"))
            .agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_occ"), F.min("term").alias("first_term")))


@_reg("lda_tokens_documents", f"""
WITH t AS (SELECT doc_id, {S.lda_tokens('text', STOPS)} AS tokens FROM documents)
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS token_text
FROM t WHERE len(tokens) >= 3
""")
def q_lda_tokens_documents(spark, sf):
    tok = C.lda_tokenize(FX.table(spark, sf, "documents"), text_col="text")
    return tok.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                      T.join_tokens("tokens").alias("token_text"))


@_reg("embed_text_documents", f"""
WITH t AS (SELECT doc_id, {S.embed_text('text', STOPS)} AS processed_text FROM documents)
SELECT doc_id, processed_text FROM t
WHERE len({S.tokenize_ws('processed_text')}) >= 3
""")
def q_embed_text_documents(spark, sf):
    out = C.embed_preprocess(FX.table(spark, sf, "documents"), text_col="text")
    return out.select("doc_id", "processed_text")


@_reg("clean_chain_pages", f"""
SELECT page_id, {S.clean_chain('html', C.CleanOptions())} AS cleaned_html FROM pages
""")
def q_clean_chain_pages(spark, sf):
    return C.clean_chain(FX.table(spark, sf, "pages"), "html").select("page_id", "cleaned_html")


@_reg("clean_chain_documents_extract", f"""
SELECT doc_id, {S.clean_chain('text', EXTRACT)} AS cleaned_text FROM documents
""")
def q_clean_chain_documents_extract(spark, sf):
    return C.clean_chain(FX.table(spark, sf, "documents"), "text", EXTRACT).select("doc_id", "cleaned_text")


@_reg("html_text_pages", f"""
SELECT page_id, {S.strip_html('html')} AS page_text FROM pages
""")
def q_html_text_pages(spark, sf):
    return FX.table(spark, sf, "pages").select("page_id", T.strip_html("html").alias("page_text"))


def _tagless(col):
    """SQL: ``html_text`` before its references are decoded."""
    x = col
    for pat, rep in T.HTML_STEPS:
        x = f"regexp_replace({x}, {S.q(pat)}, {S.q(rep)}, 'g')"
    return x


# Named references by their longest prefix, decimal ones by code.
@_reg("html_decoded_pages", f"""
WITH names(name, chars) AS (VALUES {', '.join(f"({S.q(n)}, {S.q(c)})" for n, c in sorted(html5.items()))}),
x AS (SELECT page_id, string_split({_tagless('html')}, '&') AS ps FROM pages),
e AS (SELECT page_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM x),
pre AS (SELECT page_id, i, n, substr(piece, 1, n) AS name FROM e, range(2, 33) t(n) WHERE i > 1 AND n <= length(piece)),
hit AS (SELECT page_id, i, MAX(n) AS n, MAX_BY(chars, n) AS chars FROM pre JOIN names USING (name) GROUP BY page_id, i)
SELECT page_id, string_agg(CASE WHEN i = 1 THEN piece WHEN n IS NOT NULL THEN chars || substr(piece, n + 1)
  WHEN regexp_matches(piece, '^#[0-9]+') THEN chr(CAST(regexp_extract(piece, '^#([0-9]+)', 1) AS INTEGER)) || regexp_replace(piece, '^#[0-9]+;?', '')
  ELSE '&' || piece END, '' ORDER BY i) AS page_text
FROM e LEFT JOIN hit USING (page_id, i) GROUP BY page_id
""")
def q_html_decoded_pages(spark, sf):
    """T3 with all references of HTML 5."""
    pages = FX.table(spark, sf, "pages").select("page_id", F.col("html").alias("page_text"))
    return R.html_text(pages, "page_text")


@_reg("emoji_named_pages")
def q_emoji_named_pages(spark, sf):
    """T9 on decoded pages (their signs come from references); ``test_words.py`` checks names."""
    return R.name_emoji(q_html_decoded_pages(spark, sf), "page_text")


@_reg("segmented_words_conversations")
def q_segmented_words_conversations(spark, sf):
    """Conversations without their spaces, cut into words by the counts of the documents'
    words (the tables hold no Chinese text); ``test_words.py`` compares a plain version."""
    terms = FX.table(spark, sf, "documents").select(F.explode(T.tokenize_words(T.lower("text"))).alias("word"))
    dictionary = terms.groupBy("word").agg(F.count("*").alias("freq"))
    turns = FX.table(spark, sf, "conversations").select("conv_id", "turn", W.unspaced("text").alias("tokens"))
    cut = W.segment_tokens(turns, dictionary, pieces=".+", run=".")
    return cut.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@_reg("stopword_table_documents", f"""
WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), {S.q('(' + T.WORD + '{2,})')}, 1) AS toks FROM documents),
e AS (SELECT lang, unnest(toks) AS word FROM t),
c AS (SELECT lang, word, COUNT(*) AS n FROM e GROUP BY lang, word),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM c)
SELECT lang, word, n FROM r WHERE r > 50
""")
def q_stopword_table_documents(spark, sf):
    """T16 by a table: each language's 50 most frequent words are its stop words."""
    tok = FX.table(spark, sf, "documents").select("doc_id", "lang", T.tokenize_words(T.lower("text")).alias("tokens"))
    counts = tok.select("lang", F.explode("tokens").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    stops = counts.withColumn("r", rank).filter("r <= 50").select("lang", "word")
    kept = W.drop_stopwords_by_lang(tok, stops, "lang")
    return kept.select("lang", F.explode("tokens").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


ROWS_ONLY = {"emoji_named_pages", "segmented_words_conversations"}


@_reg("hashtags_documents", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {S.q('#(' + T.WORD + '+)')}, 1) AS tags FROM documents)
SELECT doc_id, CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) AS pos, unnest(tags) AS hashtag FROM t
""")
def q_hashtags_documents(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(T.extract_hashtags("text", keep_symbol=False)).alias("pos", "hashtag"))


@_reg("hashtags_documents_tagged", f"""
WITH s AS (SELECT doc_id, '#' || lang || ' ' || text || ' #' || source || '_' || lang || ' @' || source AS text FROM documents),
t AS (SELECT doc_id, regexp_extract_all(text, {S.q('#(' + T.WORD + '+)')}, 1) AS tags FROM s)
SELECT doc_id, CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) AS pos, unnest(tags) AS hashtag FROM t
""")
def q_hashtags_documents_tagged(spark, sf):
    """T6 on documents that carry their language and source as tags (the texts alone have none)."""
    text = F.concat(F.lit("#"), "lang", F.lit(" "), "text", F.lit(" #"), "source", F.lit("_"), "lang", F.lit(" @"), "source")
    d = FX.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return d.select("doc_id", F.posexplode(T.extract_hashtags("text", keep_symbol=False)).alias("pos", "hashtag"))


@_reg("mentions_pages_cleaned", f"""
WITH c AS (SELECT page_id, lower({S.strip_html('html')}) AS x FROM pages),
t AS (SELECT page_id, regexp_extract_all(x, {S.q('@(' + T.WORD + '+)')}, 0) AS m FROM c)
SELECT page_id, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, unnest(m) AS mention FROM t
""")
def q_mentions_pages_cleaned(spark, sf):
    p = FX.table(spark, sf, "pages")
    x = T.lower(T.strip_html("html"))
    return p.select("page_id", F.posexplode(T.extract_mentions(x, keep_symbol=True)).alias("pos", "mention"))


@_reg("multilingual_term_counts", f"""
WITH t AS (SELECT lang, {S.multilingual_tokens('text', 'lang', MULTI)} AS tokens FROM documents),
e AS (SELECT lang, unnest(tokens) AS term FROM t)
SELECT lang, term, COUNT(*) AS n FROM e GROUP BY lang, term
""")
def q_multilingual_term_counts(spark, sf):
    t = C.multilingual_tokens(FX.table(spark, sf, "documents"), "text", "lang", MULTI)
    return t.select("lang", F.explode("tokens").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))


@_reg("tfidf_documents", f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, {S.q('(' + T.WORD + '{2,})')}, 1) AS toks FROM documents),
n AS (SELECT COUNT(*) AS n FROM documents),
e AS (SELECT doc_id, unnest(toks) AS term FROM d),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM e GROUP BY 1, 2),
df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1),
k AS (SELECT df.* FROM df, n WHERE df >= 2 AND df <= 0.95 * n),
w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1.0 + n.n) / (1.0 + k.df)) + 1.0) AS w
      FROM tf JOIN k USING (term), n)
SELECT doc_id, term, ROUND(w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
""")
def q_tfidf_documents(spark, sf):
    return rounded(V.tfidf(FX.table(spark, sf, "documents"), "doc_id", "text"))


@_reg("map_roles_posts", """
SELECT CAST(e.user_id AS VARCHAR) AS user_id, e.ts AS timestamp, d.text AS post_content
FROM documents d JOIN events e ON e.event_id = d.doc_id
WHERE length(trim(d.text)) > 5
""")
def q_map_roles_posts(spark, sf):
    d = FX.table(spark, sf, "documents")
    e = FX.table(spark, sf, "events")
    raw = d.join(e, d.doc_id == e.event_id).select("user_id", F.col("ts").cast("string").alias("date"), "text")
    cols = A.guess_columns(raw)
    out = A.map_roles(raw, cols["user_id"], cols["timestamp"], cols["post_content"])
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@_reg("map_source_reddit_like", """
SELECT CAST(d.doc_id AS VARCHAR) AS user_id,
       make_timestamp(CAST(floor(epoch_us(e.ts) / 1000000.0) * 1000000 AS BIGINT)) AS timestamp,
       trim(COALESCE(d.source, '') || ' ' || COALESCE(d.text, '')) AS post_content
FROM documents d JOIN events e ON e.event_id = d.doc_id
""")
def q_map_source_reddit_like(spark, sf):
    d = FX.table(spark, sf, "documents")
    e = FX.table(spark, sf, "events")
    raw = d.join(e, d.doc_id == e.event_id).select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("body"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("created"))
    out = A.map_source(raw, "reddit")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@_reg("union_sources_posts", """
WITH a AS (SELECT CAST(e.user_id AS VARCHAR) AS user_id, e.ts AS timestamp, d.text AS post_content, 'events' AS dataset
           FROM documents d JOIN events e ON e.event_id = d.doc_id),
b AS (SELECT user_id, created_at AS timestamp, tweet AS post_content, 'tweets' AS dataset FROM
      (SELECT d.source AS user_id, e.ts AS created_at, d.text AS tweet
       FROM documents d JOIN events e ON e.event_id = d.doc_id))
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE trim(post_content) <> ''
""")
def q_union_sources_posts(spark, sf):
    p = FX.posts(spark, sf).drop("post_id")
    tw = FX.posts(spark, sf, user_from="source").select(
        "user_id", F.col("timestamp").alias("created_at"), F.col("post_content").alias("tweet"))
    mapped = A.map_source(tw, "tweets_a").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    out = A.union_sources([p, mapped], ["events", "tweets"])
    return out.select("user_id", "timestamp", "post_content", "dataset")
