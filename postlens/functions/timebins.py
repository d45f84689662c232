"""Time binning (F8) and timestamp coercion.

Week bins come in two anchors, as in the reference paths:
* ``'monday'``  - weeks Monday..Sunday, labelled by the Monday;
* ``'tuesday'`` - weeks ending on Monday (pandas ``W-MON``), labelled by the
  Tuesday that starts them.
Unknown bin names fall back to week.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


#: Shapes beside Spark's own, tried in this order (month before day, as pandas does).
DATE_PATTERNS = [
    "yyyy-MM-dd HH:mm:ssXXX", "MM/dd/yyyy HH:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
    "MMM d HH:mm:ss Z yyyy", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "MMM d, yyyy",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd",
    "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy", "d.M.yyyy HH:mm", "d.M.yyyy", "M/d/yy HH:mm", "M/d/yy", "d-MMM-yyyy HH:mm:ss", "d-MMM-yyyy",
    "MMMM d, yyyy HH:mm", "MMMM d, yyyy", "d MMMM yyyy", "yyyyMMdd",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_bin(ts, tb: str = "week", week_anchor: str = "monday") -> Column:
    t = _c(ts)
    if tb == "day":
        return F.to_date(t)
    if tb == "month":
        return F.to_date(F.date_trunc("month", t))
    if week_anchor == "tuesday":
        return F.date_add(F.to_date(F.date_trunc("week", t - F.expr("INTERVAL 1 DAY"))), 1)
    return F.to_date(F.date_trunc("week", t))


def parse_timestamp(c) -> Column:
    """Lenient parse: bad text -> NULL (never raises under ANSI)."""
    x = F.trim(_c(c).cast("string"))
    # The weekday says nothing more, and Spark does not parse it.
    x = F.regexp_replace(x, r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? ", "")
    # Ten digits are seconds since 1970, thirteen milliseconds.
    number = x.try_cast("long")
    epoch = F.when(x.rlike("^[0-9]{10}$"), F.timestamp_millis(number * 1000)).when(x.rlike("^[0-9]{13}$"), F.timestamp_millis(number))
    return F.coalesce(epoch, F.try_to_timestamp(x), *[F.try_to_timestamp(x, F.lit(p)) for p in DATE_PATTERNS])


def epoch_seconds(c) -> Column:
    """Epoch seconds (numeric or numeric text) -> timestamp; bad -> NULL."""
    v = F.expr(f"try_cast({_col_sql(c)} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return F.timestamp_micros((v * F.lit(1_000_000)).cast("long"))


def _col_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mean_timestamp(ts: str) -> Column:
    """Aggregate: mean instant of a group, floored to the microsecond.

    Summed exactly as DECIMAL(38,0) and divided with integral ``div``; the
    result keeps the input's NTZ type (a session-zone round trip).
    """
    c = _col_sql(ts)
    q = F.expr(f"sum(cast(unix_micros(cast({c} AS TIMESTAMP)) AS DECIMAL(38,0))) div count({c})")
    return F.timestamp_micros(q.cast("long")).cast("timestamp_ntz")
