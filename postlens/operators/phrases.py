"""Bigram phrase learning and application (V1, V2).

Scoring (Mikolov et al. 2013): ``(c(ab) - min_count) / (c(a) c(b)) * V >
threshold`` where V counts distinct vocabulary keys, unigrams and
``a_b`` bigrams alike (one string-keyed vocabulary).

Application is the greedy left-to-right merge: in every run of
consecutive phrase hits, merges start at even offsets.  It is linear in
the length of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import written
from .clean import fence

DELIM = "_"
BROADCAST_ROWS = 1_000_000


def _pairs(tokens: DataFrame, key: str, col: str) -> DataFrame:
    """Adjacent pairs ``(a, b)`` without a window: zip the array with its tail."""
    n = F.size(col)
    z = F.arrays_zip(F.slice(col, 1, F.greatest(n - 1, F.lit(0))).alias("a"),
                     F.slice(col, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    return tokens.select(key, F.explode(z).alias("p")).select(key, "p.a", "p.b")


def learn_phrases(tokens: DataFrame, min_count: int = 5, threshold: float = 10.0,
                  key: str = "post_id", col: str = "tokens") -> DataFrame:
    """V1: ``(a, b, phrase, score)`` for every adjacent pair that scores above threshold.

    The vocabulary is keyed by string: a bigram ``a_b`` and a unigram that
    happens to be spelled ``a_b`` share one count, as do two pairs with the
    same joined spelling.  Such collisions need a ``_`` inside a token, so
    only those (tiny) key sets are regrouped; all other counts come straight
    from the two pre-aggregated tables.  A score above a non-negative
    threshold needs c(ab) > min_count: of the other pairs only the number is
    kept.  The tables are written once, so joins know how small they are.
    """
    has_us = lambda c: F.instr(c, DELIM) > 0
    uni = written(tokens.select(F.explode(col).alias("k")).groupBy("k").agg(F.count("*").alias("c")))
    bi = _pairs(tokens, key, col).groupBy("a", "b").agg(F.count("*").alias("c")) \
                                 .withColumn("phrase", F.concat_ws(DELIM, "a", "b"))
    u_us = uni.filter(has_us(F.col("k"))).select(F.col("k").alias("phrase"), F.col("c").alias("u"))
    # pairs spelled like an underscore unigram: the unigram cut at one of its underscores
    at = F.explode(F.filter(F.sequence(F.lit(1), F.length("phrase")), lambda i: F.substring(F.col("phrase"), i, F.lit(1)) == DELIM))
    cuts = written(u_us.select("phrase", at.alias("i")).select(
        F.substring(F.col("phrase"), F.lit(1), F.col("i") - 1).alias("a"), F.substring(F.col("phrase"), F.col("i") + 1, F.length("phrase")).alias("b"), F.lit(True).alias("named")))
    # The pairs are counted as they pass; only those that can score are kept.
    bi = bi.join(cuts, ["a", "b"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    seen = Observation()
    able = F.col("named") | has_us(F.col("a")) | has_us(F.col("b"))
    bi = bi.observe(seen, F.count(F.lit(1)).alias("n"))
    bi = written(bi.filter(able | (F.col("c") > min_count)) if threshold >= 0 else bi)
    n_bi = seen.get.get("n") or 0
    hit_u = bi.filter("named")
    # spellings shared by several pairs need '_' inside a or b
    shared = bi.filter(has_us(F.col("a")) | has_us(F.col("b"))).groupBy("phrase").agg(
        F.sum("c").alias("cs"), F.count("*").alias("npairs"))
    n_overlap = hit_u.agg(F.countDistinct("phrase")).first()[0]
    n_dup = shared.agg(F.coalesce(F.sum(F.col("npairs") - 1), F.lit(0))).first()[0]
    v_size = F.lit(float(uni.count() + n_bi - n_overlap - n_dup))
    # string-keyed count of a phrase: its pairs' counts + a same-spelled unigram
    cand = bi.select("a", "b", "phrase", F.col("c").alias("own"))
    cand = cand.join(shared, "phrase", "left").join(u_us, "phrase", "left")
    cab = F.coalesce("cs", "own") + F.coalesce("u", F.lit(0))
    cand = cand.select("a", "b", "phrase", cab.alias("cab"))
    if threshold >= 0:
        cand = cand.filter(F.col("cab") > min_count)
    # string-keyed count of a unigram: plus pairs spelled like it (underscore tokens only)
    extra = hit_u.groupBy("phrase").agg(F.sum("c").alias("x"))
    ucnt = uni.join(extra.withColumnRenamed("phrase", "k"), "k", "left") \
              .select("k", (F.col("c") + F.coalesce("x", F.lit(0))).alias("c"))
    va = ucnt.select(F.col("k").alias("a"), F.col("c").alias("ca"))
    vb = ucnt.select(F.col("k").alias("b"), F.col("c").alias("cb"))
    scored = cand.join(va, "a").join(vb, "b").withColumn(
        "score", (F.col("cab") - F.lit(min_count)) / (F.col("ca") * F.col("cb")).cast("double") * v_size)
    return written(scored.filter(F.col("score") > F.lit(float(threshold))).select("a", "b", "phrase", "score"))


def apply_phrases(tokens: DataFrame, phrases: DataFrame, key: str = "post_id",
                  col: str = "tokens") -> DataFrame:
    """V2: replace tokens with merged phrases; rows keep all other columns."""
    # Hits are gathered by the digest of the token list, not by a post id: equal
    # lists have equal hits, so repeated posts and repeated ids change nothing, and
    # copies fold together before the shuffle.
    t = F.col(col)
    rows = tokens.withColumn("_tk", F.md5(F.concat_ws("\x01", F.size(t), t)))
    ex = rows.select("_tk", t.alias("_t"), F.posexplode(F.expr(f"slice(`{col}`, 1, greatest(size(`{col}`) - 1, 0))")).alias("pos", "a"))
    ex = ex.select("_tk", "pos", "a", F.element_at("_t", (F.col("pos") + 2).cast("int")).alias("b"))
    # So many phrases fit every executor's memory; then no pair of tokens is shuffled.
    listed = phrases.select("a", "b")
    if phrases.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    hits = (ex.join(listed, ["a", "b"], "left_semi")
            .groupBy("_tk").agg(F.sort_array(F.collect_set("pos")).alias("_h")))
    # One byte a token, '1' for a hit.  Greedy from the left: a hit starts a phrase
    # unless the one before it did, which is '11' -> '10' in one scan.
    gap = lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get("_h", i - 1), F.lit(-1)) - 1), F.lit("1"))
    mask = F.regexp_replace(F.array_join(F.transform("_h", gap), ""), "11", "10").cast("binary")
    hits = fence(hits.select("_tk", mask.alias("_m")), "_m")
    rows = rows.join(hits, "_tk", "left")
    starts = lambda i: F.substr("_m", i + 1, F.lit(1)) == F.lit(b"1")
    joined = F.transform(t, lambda x, i: F.when(starts(i), F.concat_ws(DELIM, x, F.get(t, i + 1))).otherwise(x))
    merged = F.filter(joined, lambda x, i: (i == 0) | ~starts(i - 1))
    out = rows.withColumn(col, F.when(F.col("_m").isNull(), t).otherwise(merged)).select(*tokens.columns)
    # A later filter on the merged list must not be pushed below the merge.
    return fence(out, col).select(*tokens.columns)
