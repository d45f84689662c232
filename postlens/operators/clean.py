"""Cleaning and tokenisation operators.

Each operator is one projection of built-in expressions; the text never
leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.stem import stems
from ..session import written
from .replace import free_name, name_emoji
from .words import segment_tokens


@dataclass(frozen=True)
class TokenConfig:
    """LDA-path tokenisation (``preprocess_text``)."""
    extra_stopwords: tuple[str, ...] = ()
    min_tokens: int = 3                 # F3 min_post_length
    min_token_len_exclusive: int = 2    # tokens longer than this


@dataclass(frozen=True)
class CleanOptions:
    """Dashboard cleaning chain (T21), fixed order:
    lower -> html -> urls -> emoji -> hashtags -> mentions -> special ->
    punctuation -> numbers -> stop words."""
    lowercase: bool = True
    remove_html: bool = True
    remove_urls: bool = True
    emoji: str = "remove"              # 'remove' | 'demojize' | 'keep'
    hashtags: str = "remove"           # 'remove' | 'extract' | 'keep'
    mentions: str = "remove"           # 'remove' | 'extract' | 'keep'
    remove_special_chars: bool = False
    remove_punctuation: bool = True
    remove_numbers: bool = True
    remove_stopwords: bool = True
    custom_stopwords: str = ""


@dataclass(frozen=True)
class MultilingualOptions:
    """Multilingual tokeniser (T21 variant): mentions before hashtags,
    both before emoji; tokens filtered by stop words then length."""
    lowercase: bool = True
    remove_html: bool = True
    remove_urls: bool = True
    mentions: str = "remove"
    hashtags: str = "remove"
    emoji: str = "remove"
    remove_special_chars: bool = False
    remove_punctuation: bool = True
    remove_numbers: bool = True
    remove_stopwords: bool = True
    custom_stopwords: str = ""
    min_token_length: int = 5
    stopwords_by_lang: dict = field(default_factory=lambda: {"en": tuple(T.ENGLISH_STOPWORDS)})
    cjk_langs: tuple[str, ...] = ("zh",)


def fence(df: DataFrame, col: str) -> DataFrame:
    """Keep later filters on ``col`` above this point.

    Without it the optimizer pushes e.g. ``size(tokens) >= 3`` below the
    projection and re-inlines the whole regex chain into the predicate
    (measured 4-6x slower).  A one-element generator is a boundary that
    predicate push-down does not cross.  Filters inferred from a later
    ``explode`` (``size(tokens) > 0``) are stopped the same way.
    """
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.inline(F.array(F.struct(F.col(col).alias(col)))))


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row.  What a lambda function
    names is otherwise computed anew for each element it is called on."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def lda_tokenize(posts: DataFrame, cfg: TokenConfig = TokenConfig(), text_col: str = "post_content",
                 min_tokens: int | None = None) -> DataFrame:
    """Posts -> ``tokens`` (LDA path), keeping posts with >= min_tokens tokens."""
    stops = T.stopword_set(cfg.extra_stopwords)
    out = posts.withColumn("_clean", T.lda_clean_text(text_col))
    out = out.withColumn("tokens", T.lda_tokens_from_clean(F.col("_clean"), stops, cfg.min_token_len_exclusive)) \
             .drop("_clean")
    n = cfg.min_tokens if min_tokens is None else min_tokens
    out = fence(out, "tokens")
    return out.filter(F.size("tokens") >= n) if n > 0 else out


def embed_preprocess(posts: DataFrame, extra_stopwords=(), min_words: int = 3,
                     text_col: str = "post_content") -> DataFrame:
    """Embedding path: ``processed_text`` + ``tokens``; keep >= min_words words."""
    stops = T.stopword_set(extra_stopwords)
    out = posts.withColumn("_clean", T.embed_clean_text(text_col))
    out = out.withColumn("processed_text", T.embed_text_from_clean(F.col("_clean"), stops)).drop("_clean")
    out = fence(out, "processed_text").withColumn("tokens", T.tokenize_ws("processed_text"))
    return out.filter(F.size("tokens") >= min_words)


def clean_chain(df: DataFrame, col: str, opts: CleanOptions = CleanOptions()) -> DataFrame:
    """Adds ``cleaned_<col>`` (+ ``extracted_hashtags`` / ``extracted_mentions``)."""
    x: Column = F.coalesce(F.col(col).cast("string"), F.lit(""))
    extra = {}
    if opts.lowercase:
        x = T.lower(x)
    if opts.remove_html:
        x = T.strip_html(x)
    if opts.remove_urls:
        x = T.remove_urls(x)
    if opts.emoji == "remove":
        x = T.remove_emoji(x)
    elif opts.emoji == "demojize":
        named = free_name(df, "_named")
        df = name_emoji(df.withColumn(named, x), named)
        x = F.col(named)
    if opts.hashtags == "extract":
        extra["extracted_hashtags"] = T.extract_hashtags(x, keep_symbol=True)
    elif opts.hashtags == "remove":
        x = T.remove_hashtags(x)
    if opts.mentions == "extract":
        extra["extracted_mentions"] = T.extract_mentions(x, keep_symbol=True)
    elif opts.mentions == "remove":
        x = T.remove_mentions(x)
    if opts.remove_special_chars:
        x = T.remove_special_chars(x, keep_punct=True)
    if opts.remove_punctuation:
        x = T.remove_ascii_punctuation(x, keep="@#")
    if opts.remove_numbers:
        x = T.remove_numbers(x)
    if opts.remove_stopwords:
        words = T.stopword_set(T.parse_stopword_list(opts.custom_stopwords))
        x = T.join_tokens(T.drop_stopwords(T.tokenize_ws(x), words, case_insensitive=True))
    out = df
    for k, v in extra.items():
        out = out.withColumn(k, v)
    out = out.withColumn(f"cleaned_{col}", x)
    return out.drop(named) if opts.emoji == "demojize" else out


def multilingual_tokens(df: DataFrame, col: str, lang_col: str,
                        opts: MultilingualOptions = MultilingualOptions(),
                        dictionary: DataFrame | None = None) -> DataFrame:
    """T21 multilingual variant -> ``tokens``; stop-word list chosen per row by language.

    Texts of ``opts.cjk_langs`` become the words of ``dictionary`` (``(word, freq)``, see
    ``words.segment_tokens``), or character bigrams without one.
    """
    x: Column = F.coalesce(F.col(col).cast("string"), F.lit(""))
    if opts.lowercase:
        x = T.lower(x)
    if opts.remove_html:
        x = T.strip_tags_simple(x)
    if opts.remove_urls:
        x = T.remove_urls(x, scheme_only=True)
    if opts.mentions == "remove":
        x = T.remove_mentions(x)
    if opts.hashtags == "remove":
        x = T.remove_hashtags(x)
    if opts.emoji == "remove":
        x = T.remove_emoji(x)
    elif opts.emoji == "demojize":
        named = free_name(df, "_named")
        df = name_emoji(df.withColumn(named, x), named)
        x = F.col(named)
    if opts.remove_special_chars:
        x = T.remove_special_chars(x, keep_punct=False)
    if opts.remove_punctuation:
        x = T.remove_punctuation(x)
    if opts.remove_numbers:
        x = T.remove_numbers(x)
    lang = F.col(lang_col)
    df = df.withColumn("_clean", x)
    x = F.col("_clean")
    ws = T.tokenize_ws(T.split_contractions_text(x))
    cjk = lang.isin(list(opts.cjk_langs))
    if dictionary is None:
        toks = F.when(cjk, T.cjk_bigrams(T.tokenize_ws(x))).otherwise(ws)
    else:
        df = segment_tokens(df.withColumn("tokens", F.when(cjk, T.tokenize_ws(x)).otherwise(ws)), dictionary, where=cjk)
        toks = F.col("tokens")
    if opts.remove_stopwords:
        custom = [w.strip() for w in opts.custom_stopwords.split(",") if w.strip()]
        expr = None
        for lg, words in sorted(opts.stopwords_by_lang.items()):
            branch = T.drop_stopwords(toks, list(words) + custom)
            expr = (F.when(lang == lg, branch) if expr is None else expr.when(lang == lg, branch))
        default = T.drop_stopwords(toks, custom)
        toks = expr.otherwise(default) if expr is not None else default
    toks = T.min_length(toks, opts.min_token_length)
    out = df.withColumn("tokens", toks).drop("_clean")
    return fence(out.drop(named) if opts.emoji == "demojize" else out, "tokens")


def normal_forms(vocab: DataFrame, lemmas: DataFrame | None = None, stem: bool = False, col: str = "term") -> DataFrame:
    """``vocab`` with ``norm``: a word's lemma where the ``(token, lemma)`` dictionary has
    one (of several the smallest), else its stem with ``stem``, else the word."""
    out = stems(vocab, col, "norm") if stem else vocab.withColumn("norm", F.col(col))
    if lemmas is None:
        return out
    one = lemmas.filter("lemma IS NOT NULL").groupBy(F.col("token").alias("_token")).agg(F.min("lemma").alias("_lemma"))
    out = out.join(one, F.col(col) == F.col("_token"), "left")
    return out.withColumn("norm", F.coalesce("_lemma", "norm")).drop("_token", "_lemma")


def normalize_tokens(tok: DataFrame, lemmas: DataFrame | None = None, col: str = "tokens", stem: bool = False) -> DataFrame:
    """T19 on token lists: normal forms of the *distinct* vocabulary, joined back by place.

    Rows are numbered in a written table, so rows that share an id stay apart and a lost
    task numbers none anew.  A null list becomes an empty one.
    """
    rows = written(tok.withColumn("_row", F.monotonically_increasing_id()))
    places = rows.select("_row", F.posexplode(col).alias("pos", "term"))
    forms = normal_forms(places.select("term").distinct(), lemmas, stem)
    named = places.join(forms, places["term"].eqNullSafe(forms["term"]), "left").select("_row", "pos", "norm")
    back = named.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("_s"))
    back = back.select("_row", F.transform("_s", lambda s: s["norm"]).alias("_norm"))
    out = rows.join(back, "_row", "left").withColumn(col, F.coalesce("_norm", F.array().cast("array<string>")))
    return out.select(*tok.columns)


def drop_blank(df: DataFrame, col: str = "post_content", stripped: bool = True) -> DataFrame:
    """F2."""
    c = F.trim(F.col(col)) if stripped else F.col(col)
    return df.filter(c.isNotNull() & (c != ""))


def observed_counts(df: DataFrame, name: str):
    """Attach a row counter to ``df`` without an extra pass.

    Returns ``(df, observation)``; ``observation.get`` holds ``{name: n}``
    after the first action on the returned DataFrame.
    """
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias(name)), obs


def _demojize_series(s: pd.Series) -> pd.Series:
    import re
    import unicodedata
    skip = "\u200d\ufe0e\ufe0f"
    ranges = "".join(f"{re.escape(chr(lo))}-{re.escape(chr(hi))}" for lo, hi in T.EMOJI_RANGES)
    pat = re.compile(f"[{ranges}\U000E0020-\U000E007F\u20E3{skip}]")

    def one(t):
        if t is None:
            return None
        return pat.sub(lambda m: "" if m.group(0) in skip else
                       ":" + unicodedata.name(m.group(0), "emoji").lower().replace(" ", "_") + ":", t)
    return s.map(one)


def demojize(c) -> Column:
    """T9 as a column: single emoji -> ``:name:`` (Unicode character names, lower-case, '_'
    for spaces), by a small Arrow-batched helper.  ``replace.name_emoji`` names whole
    sequences without Python; the cleaning chains use that."""
    udf = F.pandas_udf(_demojize_series, "string")
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.rlike(T.EMOJI_CLASS_JAVA), udf(x)).otherwise(x)
