"""Porter's stemmer (Porter 1980) as column expressions over a vocabulary.

Each step finds the longest listed ending of a word by one pattern, looks its
replacement up in a literal map and tests the rest of the word by a pattern of
vowel and consonant runs.  Words of other characters than a-z, and words of one
or two letters, stay as they are.  The patterns are also valid RE2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Runs of consonants and of vowels; "y" is a vowel after a consonant, and "Y" stands for a leading y.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL = f"^({_C})?[aeiouy]"
MEASURE_OVER_0 = f"^({_C})?{_V}{_C}"
MEASURE_OVER_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
MEASURE_1 = f"^({_C})?{_V}{_C}({_V})?$"
SHORT = f"^{_C}[aeiouy][^aeiouwxyY]$"                 # one syllable: consonant, vowel, consonant
ENDS_CVC = "[^aeiouy][aeiouy][^aeiouwxyY]$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# Endings of the published algorithm and what they become.
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_1B = {"eed": "ee", "ed": "", "ing": ""}
STEP_1B_AFTER = {"at": "ate", "bl": "ble", "iz": "ize"}
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
          "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
          "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
                        "ate", "iti", "ous", "ive", "ize"], "")


def ending(table: dict) -> str:
    """Pattern whose groups are the rest of a word and its longest ending of ``table``."""
    return f"^(.*?)({'|'.join(table)})$"


def _split(word: Column, table: dict) -> tuple[Column, Column, Column]:
    rest, end = F.regexp_extract(word, ending(table), 1), F.regexp_extract(word, ending(table), 2)
    new = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), end)
    return rest, end, F.concat(rest, new)


def stems(vocab: DataFrame, col: str = "term", out: str = "stem") -> DataFrame:
    """``vocab`` with the stem of ``col`` as ``out``; one projection a step, so that no step is
    written out again inside the next.  A null word has a null stem."""
    w = F.col(out)
    step = lambda df, new: df.withColumn(out, new)
    plain = F.col(col).rlike("^[a-z]{3,}$")
    df = vocab.withColumn(out, F.when(plain, F.regexp_replace(col, "^y", "Y")))
    _, end, new = _split(w, STEP_1A)
    df = step(df, F.when(end != "", new).otherwise(w))
    rest, end, new = _split(w, STEP_1B)
    cut = F.when(end == "eed", F.when(rest.rlike(MEASURE_OVER_0), new).otherwise(w)).when(
        (end != "") & rest.rlike(HAS_VOWEL), F.concat(rest, F.lit("+"))).otherwise(w)
    df = step(df, cut)                                # "+" marks a word that lost "ed" or "ing"
    bare = F.regexp_replace(w, r"\+$", "")
    _, end, new = _split(bare, STEP_1B_AFTER)
    mended = (F.when(end != "", new).when(bare.rlike(DOUBLE), F.expr(f"left({out}, length({out}) - 2)"))
              .when(bare.rlike(SHORT), F.concat(bare, F.lit("e"))).otherwise(bare))
    df = step(df, F.when(w.endswith("+"), mended).otherwise(w))
    rest = F.regexp_replace(w, "y$", "")
    df = step(df, F.when(w.endswith("y") & rest.rlike(HAS_VOWEL), F.concat(rest, F.lit("i"))).otherwise(w))
    for table in (STEP_2, STEP_3):
        rest, end, new = _split(w, table)
        df = step(df, F.when((end != "") & rest.rlike(MEASURE_OVER_0), new).otherwise(w))
    rest, end, _ = _split(w, STEP_4)
    df = step(df, F.when((end != "") & rest.rlike(MEASURE_OVER_1) & ((end != "ion") | rest.rlike("[st]$")), rest).otherwise(w))
    rest = F.regexp_replace(w, "e$", "")
    short = rest.rlike(MEASURE_1) & ~rest.rlike(ENDS_CVC)
    df = step(df, F.when(w.endswith("e") & (rest.rlike(MEASURE_OVER_1) | short), rest).otherwise(w))
    df = step(df, F.when(w.endswith("ll") & w.rlike(MEASURE_OVER_1), F.regexp_replace(w, "l$", "")).otherwise(w))
    return step(df, F.coalesce(F.regexp_replace(w, "^Y", "y"), F.col(col)))


def stems_sql(vocab: str, col: str = "term") -> str:
    """DuckDB: CTEs that end in ``stems(<columns of vocab>, stem)``."""
    def parts(word, table):
        pat = ending(table)
        rest, end = (f"regexp_extract({word}, '{pat}', {i})" for i in (1, 2))
        names = "CASE " + end + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
        return rest, end, f"({rest} || {names})"

    def has(text, pattern):
        return f"regexp_matches({text}, '{pattern}')"
    out = [f"s0 AS (SELECT *, CASE WHEN {has(col, '^[a-z]{3,}$')} THEN regexp_replace({col}, '^y', 'Y') END AS w FROM {vocab})"]

    def step(expr):
        out.append(f"s{len(out)} AS (SELECT * REPLACE ({expr} AS w) FROM s{len(out) - 1})")
    _, end, new = parts("w", STEP_1A)
    step(f"CASE WHEN {end} <> '' THEN {new} ELSE w END")
    rest, end, new = parts("w", STEP_1B)
    step(f"CASE WHEN {end} = 'eed' THEN CASE WHEN {has(rest, MEASURE_OVER_0)} THEN {new} ELSE w END "
         f"WHEN {end} <> '' AND {has(rest, HAS_VOWEL)} THEN {rest} || '+' ELSE w END")
    bare = "rtrim(w, '+')"
    _, end, new = parts(bare, STEP_1B_AFTER)
    step(f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN {end} <> '' THEN {new} WHEN {has(bare, DOUBLE)} THEN w[:-3] "
         f"WHEN {has(bare, SHORT)} THEN {bare} || 'e' ELSE {bare} END")
    step(f"CASE WHEN ends_with(w, 'y') AND {has('w[:-2]', HAS_VOWEL)} THEN w[:-2] || 'i' ELSE w END")
    for table in (STEP_2, STEP_3):
        rest, end, new = parts("w", table)
        step(f"CASE WHEN {end} <> '' AND {has(rest, MEASURE_OVER_0)} THEN {new} ELSE w END")
    rest, end, _ = parts("w", STEP_4)
    step(f"CASE WHEN {end} <> '' AND {has(rest, MEASURE_OVER_1)} AND ({end} <> 'ion' OR {has(rest, '[st]$')}) THEN {rest} ELSE w END")
    rest = "w[:-2]"
    step(f"CASE WHEN ends_with(w, 'e') AND ({has(rest, MEASURE_OVER_1)} OR ({has(rest, MEASURE_1)} AND NOT {has(rest, ENDS_CVC)})) THEN {rest} ELSE w END")
    step(f"CASE WHEN ends_with(w, 'll') AND {has('w', MEASURE_OVER_1)} THEN w[:-2] ELSE w END")
    return ",\n".join(out) + f",\nstems AS (SELECT * EXCLUDE (w), COALESCE(regexp_replace(w, '^Y', 'y'), {col}) AS stem FROM s{len(out) - 1})"
