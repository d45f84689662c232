"""Percentile cut-offs and suspicious-user flags.

``exact_quantile`` returns numpy's linear-interpolated percentile without
sorting the whole column in one task: an approximate quantile sketch
brackets the target ranks, the values below the bracket are counted, and
only the bracket (about 4n/accuracy values) is sorted, distributed, to
pick the two order statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def _valid(col: str):
    v = F.col(col).cast("double")
    return F.when(~F.isnan(v), v)


def exact_quantiles(df: DataFrame, specs: list[tuple[str, float]],
                    accuracy: int = 100_000) -> list[float | None]:
    """Linear-interpolation quantiles (numpy default) of non-null, non-NaN values.

    Job 1: counts + approximate brackets for every spec.  Job 2: per spec,
    counts below / at / inside / at the top of the bracket.  Ranks landing
    on a bracket end resolve to that value; only ranks strictly inside
    need job 3, which sorts just the interior (about 4n/accuracy values).
    """
    out: list[float | None] = [None] * len(specs)
    eps = [2.0 / accuracy] * len(specs)
    first = df.agg(*[F.count(_valid(c)).alias(f"n{i}") for i, (c, _) in enumerate(specs)]).first()
    todo = [i for i in range(len(specs)) if first[f"n{i}"] > 0]
    while todo:
        brackets = {}
        aggs = []
        for i in todo:
            c, q = specs[i]
            ql, qh = max(0.0, q - eps[i]), min(1.0, q + eps[i])
            aggs.append(F.percentile_approx(_valid(c), [ql, qh], accuracy).alias(f"b{i}"))
        b = df.agg(*aggs).first()
        cnt = []
        for i in todo:
            c, q = specs[i]
            lo, hi = b[f"b{i}"]
            if q - eps[i] <= 0:
                lo = None
            if q + eps[i] >= 1:
                hi = None
            brackets[i] = (lo, hi)
            v = _valid(c)
            lo_c = F.lit(lo if lo is not None else float("-inf"))
            hi_c = F.lit(hi if hi is not None else float("inf"))
            cnt += [F.count_if(v < lo_c).alias(f"below{i}"), F.count_if(v == lo_c).alias(f"eqlo{i}"),
                    F.count_if((v > lo_c) & (v < hi_c)).alias(f"in{i}"), F.count_if(v == hi_c).alias(f"eqhi{i}")]
        st = df.agg(*cnt).first()
        retry = []
        for i in todo:
            c, q = specs[i]
            n = first[f"n{i}"]
            lo, hi = brackets[i]
            below, eqlo, inside, eqhi = (st[f"below{i}"], st[f"eqlo{i}"], st[f"in{i}"], st[f"eqhi{i}"])
            if lo is not None and lo == hi:
                eqhi, inside = 0, 0
            pos = q * (n - 1)
            ranks = sorted({int(math.floor(pos)), min(int(math.floor(pos)) + 1, n - 1)})
            if ranks[0] < below or ranks[-1] >= below + eqlo + inside + eqhi:
                eps[i] *= 4
                retry.append(i)
                continue
            vals = {}
            need = []
            for r in ranks:
                if r < below + eqlo:
                    vals[r] = lo
                elif r < below + eqlo + inside:
                    need.append(r - below - eqlo)
                else:
                    vals[r] = hi
            if need:
                v = _valid(c)
                lo_c = F.lit(lo if lo is not None else float("-inf"))
                hi_c = F.lit(hi if hi is not None else float("inf"))
                rows = (df.select(v.alias("v")).filter((F.col("v") > lo_c) & (F.col("v") < hi_c))
                          .orderBy("v").offset(min(need)).limit(max(need) - min(need) + 1).collect())
                for r in ranks:
                    if r not in vals:
                        vals[r] = rows[r - below - eqlo - min(need)]["v"]
            a, bb = vals[ranks[0]], vals[ranks[-1]]
            frac = pos - math.floor(pos)
            out[i] = a + (bb - a) * frac
        todo = retry
    return out


def exact_quantile(df: DataFrame, col: str, q: float, accuracy: int = 100_000) -> float | None:
    return exact_quantiles(df, [(col, q)], accuracy)[0]


def cutoffs(scores: DataFrame, freq_q: float = 0.95, narrow_q: float = 0.95,
            compat: bool = False) -> tuple[float, float]:
    """Post-count and Gini cut-offs.

    Default reads the thresholds as quantiles (the documented intent, top
    5 %); ``compat=True`` reproduces the reference's percent-scale slip
    (``percentile(x, 0.95)`` = the 0.95th percentile).
    """
    fq = freq_q / 100.0 if compat else freq_q
    nq = narrow_q / 100.0 if compat else narrow_q
    post_cut, gini_cut = exact_quantiles(scores, [("post_count", fq), ("gini_coefficient", nq)])
    return (post_cut if post_cut is not None else math.inf,
            gini_cut if gini_cut is not None else math.inf)


def suspicious_users(scores: DataFrame, duplicates: DataFrame | None = None,
                     freq_q: float = 0.95, narrow_q: float = 0.95,
                     duplicate_ratio_threshold: float = 0.5, compat: bool = False) -> DataFrame:
    """Flags per user; ``duplicates=None`` gives ratio 0 / flag false."""
    post_cut, gini_cut = cutoffs(scores, freq_q, narrow_q, compat)
    out = scores.withColumn("suspicious_post_freq", F.col("post_count") >= F.lit(post_cut)) \
                .withColumn("suspicious_narrowness",
                            F.coalesce(F.col("gini_coefficient") >= F.lit(gini_cut), F.lit(False)))
    if duplicates is not None:
        out = out.join(duplicates.select("user_id", "duplicate_post_ratio"), "user_id", "left") \
                 .withColumn("duplicate_post_ratio", F.coalesce("duplicate_post_ratio", F.lit(0.0)))
    else:
        out = out.withColumn("duplicate_post_ratio", F.lit(0.0))
    out = out.withColumn("suspicious_duplicates", F.col("duplicate_post_ratio") > F.lit(duplicate_ratio_threshold))
    return out.withColumn("suspicious", (F.col("suspicious_post_freq") & F.col("suspicious_narrowness"))
                          | F.col("suspicious_duplicates"))


def sort_suspicious(df: DataFrame) -> DataFrame:
    """D4 order: flag, Gini, count descending (undefined Gini last)."""
    return df.orderBy(F.col("suspicious").desc(), F.round("gini_coefficient", 9).desc_nulls_last(),
                      F.col("post_count").desc(), "user_id")


# Reason texts of the dashboard user card, in flag order.
FLAG_NAMES = [("suspicious_post_freq", "high posting frequency"),
              ("suspicious_narrowness", "narrow topic focus"),
              ("suspicious_duplicates", "high duplicate content")]


def flag_reasons(df: DataFrame) -> DataFrame:
    """``reasons`` = names of the true flags, joined with ', '."""
    arr = F.array_compact(F.array(*[F.when(F.col(c), F.lit(name)) for c, name in FLAG_NAMES]))
    return df.withColumn("reasons", F.concat_ws(", ", arr))
