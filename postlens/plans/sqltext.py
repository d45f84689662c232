"""DuckDB SQL text expressions for the oracles.

Same pattern text as ``postlens.functions.text`` (RE2 accepts the Unicode
classes); only RE2-specific spellings differ (``\\p{Han}``, ``'g'`` flag).
"""

from __future__ import annotations

from ..functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in sorted(set(words))) + "]::VARCHAR[]"


def rr(x: str, pat: str, rep: str = "") -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def tokenize_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(T.MULTI_WS)}), lambda t: t <> '')"


def split_contractions(toks: str) -> str:
    cases = " ".join(f"WHEN t = {q(a + b)} THEN [{q(a)}, {q(b)}]" for a, b in T.CONTRACTION_SPLITS)
    return f"flatten(list_transform({toks}, lambda t: CASE {cases} ELSE [t] END))"


def strip_html(x: str) -> str:
    for pat, rep in T.HTML_STEPS:
        x = rr(x, pat, rep)
    for ent, ch in T.HTML_ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def lda_tokens(col: str, stops, min_excl: int = 2) -> str:
    x = f"lower(COALESCE({col}, ''))"
    x = rr(x, T.URL_ANY)
    x = rr(x, T.MENTION)
    x = rr(x, T.PUNCT)
    x = rr(x, T.NUMBER)
    toks = split_contractions(tokenize_ws(x))
    return f"list_filter({toks}, lambda t: NOT list_contains({lst(stops)}, t) AND length(t) > {min_excl})"


def embed_text(col: str, stops) -> str:
    x = f"lower(COALESCE({col}, ''))"
    x = rr(x, T.URL_ANY, " ")
    x = rr(x, T.MENTION, " ")
    x = rr(x, T.PUNCT)
    x = rr(x, T.NUMBER)
    toks = split_contractions(tokenize_ws(x))
    return (f"array_to_string(list_filter({toks}, lambda t: NOT list_contains({lst(stops)}, t) "
            f"AND length(t) > 1), ' ')")


def clean_chain(col: str, opts) -> str:
    x = f"COALESCE(CAST({col} AS VARCHAR), '')"
    if opts.lowercase:
        x = f"lower({x})"
    if opts.remove_html:
        x = strip_html(x)
    if opts.remove_urls:
        x = rr(x, T.URL_ANY)
    if opts.emoji == "remove":
        x = rr(x, T.EMOJI_CLASS)
    if opts.hashtags == "remove":
        x = rr(x, T.HASHTAG)
    if opts.mentions == "remove":
        x = rr(x, T.MENTION)
    if opts.remove_special_chars:
        x = rr(x, T.SPECIAL_KEEP_PUNCT)
    if opts.remove_punctuation:
        chars = "".join(ch for ch in T.ASCII_PUNCT if ch not in "@#")
        x = f"translate({x}, {q(chars)}, '')"
    if opts.remove_numbers:
        x = rr(x, T.NUMBER)
    if opts.remove_stopwords:
        words = T.stopword_set(T.parse_stopword_list(opts.custom_stopwords))
        x = (f"array_to_string(list_filter({tokenize_ws(x)}, "
             f"lambda t: NOT list_contains({lst(words)}, lower(t))), ' ')")
    return x


def multilingual_tokens(col: str, lang: str, opts) -> str:
    x = f"lower(COALESCE(CAST({col} AS VARCHAR), ''))" if opts.lowercase else f"COALESCE(CAST({col} AS VARCHAR), '')"
    if opts.remove_html:
        x = rr(x, T.HTML_TAG)
    if opts.remove_urls:
        x = rr(x, T.URL_SCHEME)
    if opts.mentions == "remove":
        x = rr(x, T.MENTION)
    if opts.hashtags == "remove":
        x = rr(x, T.HASHTAG)
    if opts.emoji == "remove":
        x = rr(x, T.EMOJI_CLASS)
    if opts.remove_special_chars:
        x = rr(x, T.SPECIAL_ASCII_WORD)
    if opts.remove_punctuation:
        x = rr(x, T.PUNCT)
    if opts.remove_numbers:
        x = rr(x, T.NUMBER)
    ws = split_contractions(tokenize_ws(x))
    cjk = (f"flatten(list_transform({tokenize_ws(x)}, lambda t: CASE WHEN regexp_matches(t, '\\p{{Han}}') "
           f"AND length(t) > 1 THEN list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) ELSE [t] END))")
    toks = f"(CASE WHEN {lang} IN ({', '.join(q(c) for c in opts.cjk_langs)}) THEN {cjk} ELSE {ws} END)"
    if opts.remove_stopwords:
        custom = [w.strip() for w in opts.custom_stopwords.split(",") if w.strip()]
        branches = " ".join(
            f"WHEN {lang} = {q(lg)} THEN list_filter({toks}, lambda t: NOT list_contains({lst(list(w) + custom)}, t))"
            for lg, w in sorted(opts.stopwords_by_lang.items()))
        default = f"list_filter({toks}, lambda t: NOT list_contains({lst(custom)}, t))" if custom else toks
        toks = f"(CASE {branches} ELSE {default} END)"
    return f"list_filter({toks}, lambda t: length(t) >= {opts.min_token_length})"
