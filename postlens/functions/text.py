"""Text scalar functions as built-in column expressions (no row UDFs).

Python's ``re`` treats ``\\w``, ``\\s`` and ``\\d`` as Unicode classes while
Java regex and RE2 treat them as ASCII.  The classes below spell out the
Unicode meaning so the same pattern text behaves alike in Spark (Java) and
in DuckDB (RE2), which the SQL oracles rely on.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# --- regex building blocks -------------------------------------------------
WORD_CHARS = r"\p{L}\p{N}_"                       # Python's Unicode \w
WS_CHARS = r"\t\n\x0B\f\r \x1C-\x1F\x85\p{Z}"      # Python's Unicode \s
WORD = f"[{WORD_CHARS}]"
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"

URL_ANY = f"http{NON_WS}+|www{NON_WS}+|https{NON_WS}+"
URL_SCHEME = rf"https?://{NON_WS}+|www\.{NON_WS}+"
MENTION = f"@{WORD}+"
HASHTAG = f"#{WORD}+"
PUNCT = f"[^{WORD_CHARS}{WS_CHARS}]"              # [^\w\s]
NUMBER = r"\p{Nd}+"                                # \d+
PUNCT_OR_DIGIT = f"{PUNCT}|\\p{{Nd}}"               # one pass: deleting a char set is order-free
MULTI_WS = f"{WS}+"
HTML_TAG = "<.*?>"
# [^A-Za-z0-9\s.,!?:;'-@#_]: "'-@" is a range 0x27-0x40, kept as written.
SPECIAL_KEEP_PUNCT = rf"[^A-Za-z0-9{WS_CHARS}.,!?:;'-@#_]"
SPECIAL_ASCII_WORD = rf"[^a-zA-Z0-9{WS_CHARS}_]"
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"   # string.punctuation
CJK = r"\p{IsHan}"

# HTML stripping steps (pattern, replacement) and entities.
HTML_STEPS = [
    (r"(?is)<script[^>]*>.*?</script\s*>", " "),
    (r"(?is)<style[^>]*>.*?</style\s*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?s)<[^>]*>", ""),
]
HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                 ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]

# Emoji code points (fixed values: the pictographic blocks, misc symbols and dingbats,
# misc technical, arrows and the few BMP symbols with emoji presentation).
EMOJI_RANGES = [
    (0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2300, 0x23FF), (0x2B00, 0x2BFF), (0x3030, 0x3030),
    (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x00A9, 0x00A9), (0x00AE, 0x00AE),
    (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x2199),
    (0x21A9, 0x21AA), (0x24C2, 0x24C2), (0x25AA, 0x25AB), (0x25B6, 0x25B6), (0x25C0, 0x25C0),
    (0x25FB, 0x25FE), (0x2934, 0x2935),
]
_RANGES = "".join(f"\\x{{{lo:04X}}}" + (f"-\\x{{{hi:04X}}}" if hi > lo else "") for lo, hi in EMOJI_RANGES)
EMOJI_BASE = f"[{_RANGES}]"
# Removed by T8 as well: tag, presentation, joiner and keycap characters.
EMOJI_CLASS = f"[{_RANGES}" + r"\x{E0020}-\x{E007F}\x{FE0E}\x{FE0F}\x{200D}\x{20E3}]"

# --- fixed values: English stop words (198 entries, NLTK english list) ----
ENGLISH_STOPWORDS = (
    "a about above after again against ain all am an and any are aren aren't as at "
    "be because been before being below between both but by can couldn couldn't d "
    "did didn didn't do does doesn doesn't doing don don't down during each few for "
    "from further had hadn hadn't has hasn hasn't have haven haven't having he he'd "
    "he'll her here hers herself he's him himself his how i i'd if i'll i'm in into "
    "is isn isn't it it'd it'll it's its itself i've just ll m ma me mightn mightn't "
    "more most mustn mustn't my myself needn needn't no nor not now o of off on once "
    "only or other our ours ourselves out over own re s same shan shan't she she'd "
    "she'll she's should shouldn shouldn't should've so some such t than that that'll "
    "the their theirs them themselves then there these they they'd they'll they're "
    "they've this those through to too under until up ve very was wasn wasn't we we'd "
    "we'll we're were weren weren't we've what when where which while who whom why "
    "will with won won't wouldn wouldn't y you you'd you'll your you're yours yourself "
    "yourselves you've"
).split()

# --- fixed values: dashboard default extra stop words for the LDA model ----
DEFAULT_EXTRA_STOPWORDS = (
    "rt,amp,via,http,https,co,u,wa,ha,thi,doe,becau,veri,ani,becaus,abov,ani,alon,"
    "alreadi,alway,anoth,anyon,anyth,anywher,aras,area,ask,avail,awai,back,becam,"
    "becom,befor,began,begin,begun,believ,besid,better,bigger,biggest,blockquot,nbsp"
)

# --- fixed values: tokenizer contractions split apart (whole words only) ---
CONTRACTION_SPLITS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"),
                      ("lem", "me"), ("wan", "na")]


def parse_stopword_list(text: str | None) -> list[str]:
    """Comma-separated list -> trimmed, lower-cased, non-empty words."""
    if not text:
        return []
    return [w.strip().lower() for w in text.split(",") if w.strip()]


def stopword_set(extra: Iterable[str] | None = None, base: Iterable[str] | None = None) -> list[str]:
    """Union of a base list and extra words, de-duplicated, sorted (U4)."""
    words = set(ENGLISH_STOPWORDS if base is None else base)
    words.update(extra or [])
    return sorted(words)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- T1 - T13 ---------------------------------------------------------------
def lower(c) -> Column:
    return F.lower(_c(c))


def remove_urls(c, repl: str = "", scheme_only: bool = False) -> Column:
    return F.regexp_replace(_c(c), URL_SCHEME if scheme_only else URL_ANY, repl)


def strip_html(c) -> Column:
    """Drop script/style/comment blocks, then tags, then basic entities."""
    x = _c(c)
    for pat, rep in HTML_STEPS:
        x = F.regexp_replace(x, pat, rep)
    for ent, ch in HTML_ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def strip_tags_simple(c) -> Column:
    """T3 multilingual variant: ``<.*?>`` -> ''."""
    return F.regexp_replace(_c(c), HTML_TAG, "")


def remove_mentions(c, repl: str = "") -> Column:
    return F.regexp_replace(_c(c), MENTION, repl)


def remove_hashtags(c) -> Column:
    return F.regexp_replace(_c(c), HASHTAG, "")


def extract_hashtags(c, keep_symbol: bool = True) -> Column:
    """(a) ``#\\w+`` keeping '#', (b) ``#(\\w+)`` without it."""
    return F.regexp_extract_all(_c(c), F.lit(f"#({WORD}+)"), F.lit(0 if keep_symbol else 1))


def extract_mentions(c, keep_symbol: bool = True) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(f"@({WORD}+)"), F.lit(0 if keep_symbol else 1))


# Java-only fast form of the same class: characters below U+00A9 (most text)
# fail the leading range at once instead of walking the whole union.
EMOJI_CLASS_JAVA = r"[[\x{00A9}\x{00AE}\x{200D}-\x{E007F}]&&" + EMOJI_CLASS + "]"


def remove_emoji(c) -> Column:
    return F.regexp_replace(_c(c), EMOJI_CLASS_JAVA, "")


def remove_punctuation(c) -> Column:
    """T10 ``[^\\w\\s]`` -> ''."""
    return F.regexp_replace(_c(c), PUNCT, "")


def remove_ascii_punctuation(c, keep: str = "") -> Column:
    """T10 variant: delete ``string.punctuation`` characters except ``keep``."""
    chars = "".join(ch for ch in ASCII_PUNCT if ch not in keep)
    return F.translate(_c(c), chars, "")


def remove_special_chars(c, keep_punct: bool = True) -> Column:
    return F.regexp_replace(_c(c), SPECIAL_KEEP_PUNCT if keep_punct else SPECIAL_ASCII_WORD, "")


def remove_numbers(c) -> Column:
    return F.regexp_replace(_c(c), NUMBER, "")


def squeeze_ws(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), MULTI_WS, " "))


def split_contractions(tokens) -> Column:
    """Whole-token contraction splits of the word tokenizer (tokens hold
    only word characters here, so a whole token is a whole word)."""
    t = _c(tokens)

    def split(x):
        e = None
        for a, b in CONTRACTION_SPLITS:
            cond = x == F.lit(a + b)
            e = F.when(cond, F.array(F.lit(a), F.lit(b))) if e is None else e.when(cond, F.array(F.lit(a), F.lit(b)))
        return e.otherwise(F.array(x))
    return F.flatten(F.transform(t, split))


def split_contractions_text(c) -> Column:
    """Same splits in one regex pass over text (Java lookarounds): a space
    is inserted after the prefix of each whole-word contraction."""
    x = _c(c)
    alts = "|".join(f"{a}(?={b}(?!{WORD}))" for a, b in CONTRACTION_SPLITS)
    guard = None
    for a, b in CONTRACTION_SPLITS:          # cheap byte scans skip the regex for most rows
        g = x.contains(a + b)
        guard = g if guard is None else guard | g
    return F.when(guard, F.regexp_replace(x, f"(?<!{WORD})(?:{alts})", "$0 ")).otherwise(x)


# --- T14 - T20 --------------------------------------------------------------
def tokenize_ws(c) -> Column:
    """Whitespace tokens, empties dropped."""
    return F.filter(F.split(_c(c), MULTI_WS), lambda t: t != F.lit(""))


def tokenize_words(c, min_chars: int = 2) -> Column:
    """Runs of >= ``min_chars`` word characters (``\\b\\w\\w+\\b``)."""
    return F.regexp_extract_all(_c(c), F.lit(f"({WORD}{{{min_chars},}})"), F.lit(1))


def cjk_bigrams(tokens) -> Column:
    """Tokens holding Han characters become overlapping character bigrams."""
    def expand(t):
        n = F.length(t)
        return F.when(
            t.rlike(CJK) & (n > 1),
            F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, 2)),
        ).otherwise(F.array(t))
    return F.flatten(F.transform(_c(tokens), expand))


def drop_stopwords(tokens, words: Iterable[str], case_insensitive: bool = False) -> Column:
    """Token-level exact match; keeps order and repeats.

    ``isin`` over a literal list becomes a hash ``InSet`` inside the lambda.
    """
    words = sorted(set(words))
    if not words:
        return _c(tokens)
    if case_insensitive:
        return F.filter(_c(tokens), lambda t: ~F.lower(t).isin(words))
    return F.filter(_c(tokens), lambda t: ~t.isin(words))


def min_length(tokens, n: int, strict: bool = False) -> Column:
    """Keep tokens with length >= n (or > n when ``strict``)."""
    if strict:
        return F.filter(_c(tokens), lambda t: F.length(t) > n)
    return F.filter(_c(tokens), lambda t: F.length(t) >= n)


def join_tokens(tokens) -> Column:
    return F.concat_ws(" ", _c(tokens))


# --- composed cleaners of the two topic paths --------------------------------
# Each path is split in two projections: the cleaned text is materialised
# as a column first, so the contraction guard (several cheap scans of the
# same value) reads a column instead of re-running the regex chain.
def lda_clean_text(c) -> Column:
    """LDA path up to tokenisation: lower, URLs, mentions, punctuation, digits."""
    x = F.coalesce(_c(c), F.lit(""))
    return F.regexp_replace(remove_mentions(remove_urls(lower(x))), PUNCT_OR_DIGIT, "")


def lda_tokens_from_clean(clean, stopwords: Iterable[str], min_len_exclusive: int = 2) -> Column:
    toks = tokenize_ws(split_contractions_text(clean))
    words = sorted(set(stopwords))
    return F.filter(toks, lambda t: (~t.isin(words)) & (F.length(t) > min_len_exclusive))


def lda_tokens(c, stopwords: Iterable[str], min_len_exclusive: int = 2) -> Column:
    """Single-expression form (small inputs / tests); operators use the two-step form."""
    return lda_tokens_from_clean(lda_clean_text(c), stopwords, min_len_exclusive)


def embed_clean_text(c) -> Column:
    x = F.coalesce(_c(c), F.lit(""))
    return F.regexp_replace(remove_mentions(remove_urls(lower(x), " "), " "), PUNCT_OR_DIGIT, "")


def embed_text_from_clean(clean, stopwords: Iterable[str]) -> Column:
    toks = tokenize_ws(split_contractions_text(clean))
    words = sorted(set(stopwords))
    return join_tokens(F.filter(toks, lambda t: (~t.isin(words)) & (F.length(t) > 1)))


def embed_text(c, stopwords: Iterable[str]) -> Column:
    """Embedding path: same cleaning with URL / mention -> ' ', stop words and
    1-character tokens dropped, re-joined with single spaces."""
    return embed_text_from_clean(embed_clean_text(c), stopwords)
