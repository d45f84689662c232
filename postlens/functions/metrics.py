"""Distribution metrics over an ``ARRAY<DOUBLE>`` column.

All are higher-order built-ins, so they stay inside whole-stage codegen.
NaN is never produced: "undefined" results are SQL NULL, which sorts and
compares like the reference's NaN-last / NaN-is-false rules.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda a, b: a + b)


def gini(c) -> Column:
    """Gini of |p|: sum((2i - n - 1) p_(i)) / (n sum p); sum 0 -> NULL; n <= 1 -> 0."""
    p = _c(c)
    n = F.size(p)
    srt = F.array_sort(F.transform(p, lambda v: F.abs(v)))
    num = F.aggregate(
        F.transform(srt, lambda v, i: (2 * (i + 1) - n - 1) * v),
        F.lit(0.0).cast("double"), lambda a, b: a + b)
    total = _sum(p)
    abs_total = _sum(F.transform(p, lambda v: F.abs(v)))
    return (F.when(p.isNull() | (total == 0), F.lit(None).cast("double"))
             .when(n <= 1, F.lit(0.0))
             .otherwise(num / (n * abs_total)))


def gini_zero(c) -> Column:
    """Multilingual variant: sum 0 -> 0 (no abs)."""
    p = _c(c)
    n = F.size(p)
    srt = F.array_sort(p)
    num = F.aggregate(F.transform(srt, lambda v, i: (2 * (i + 1) - n - 1) * v),
                      F.lit(0.0).cast("double"), lambda a, b: a + b)
    total = _sum(p)
    return F.when(total == 0, F.lit(0.0)).otherwise(num / (n * total))


def entropy_bits(c) -> Column:
    """Shannon entropy (bits) of the positive part, renormalised; empty -> 0."""
    p = _c(c)
    pos = F.filter(p, lambda v: v > 0)
    # The sum is a lambda's argument, so that it is made once and not for each entry.
    h = F.get(F.transform(F.array(_sum(pos)), lambda s: F.aggregate(
        pos, F.lit(0.0).cast("double"), lambda a, v: a - (v / s) * F.log2(v / s))), F.lit(0))
    return F.when(p.isNull(), F.lit(None).cast("double")).when(F.size(pos) == 0, F.lit(0.0)).otherwise(h)


def top_n_ratio(c, n: int) -> Column:
    """Sum of the n largest / total; total 0 -> 0; n < 1 -> NULL."""
    p = _c(c)
    if n < 1:
        return F.lit(None).cast("double")
    total = _sum(p)
    top = _sum(F.slice(F.sort_array(p, asc=False), 1, n))
    return F.when(p.isNull(), F.lit(None).cast("double")).when(total == 0, F.lit(0.0)).otherwise(top / total)


def first_argmax(c) -> Column:
    """0-based index of the first maximum (``np.argmax``); empty -> -1."""
    p = _c(c)
    return F.when(F.size(p) > 0, F.array_position(p, F.array_max(p)) - 1).otherwise(F.lit(-1)).cast("int")
