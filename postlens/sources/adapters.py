"""Source adapters (S5 - S11) and dataset union.

The five per-dataset adapters are one operator, ``map_source``, driven by a
spec: candidate column names for user / time / content plus a time rule.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timebins import epoch_seconds, parse_timestamp


@dataclass(frozen=True)
class SourceSpec:
    user: tuple[str, ...]                   # first present column wins
    content: tuple[str, ...] = ()           # first present column wins
    content_concat: tuple[str, ...] = ()    # strip(a + ' ' + b); missing -> ''
    time: tuple[str, ...] = ()              # parsed timestamps, first present
    epoch_time: tuple[str, ...] = ()        # epoch seconds, used if ``time`` absent
    synthetic_days: int | None = None       # base - int(days*i/n) when no time
    strip_filter: bool = True               # drop strip(content) == '' (else only == '')
    headerless: tuple[str, ...] = field(default=())  # names for a headerless file


# The adapters' column rules.
SPECS = {
    "reddit": SourceSpec(user=("id",), content_concat=("title", "body"),
                         time=("timestamp",), epoch_time=("created",), strip_filter=False),
    "fake": SourceSpec(user=("username", "id"), content=("text", "body"),
                       time=("timestamp",), synthetic_days=60, strip_filter=False),
    "tweets_a": SourceSpec(user=("user_id",), content=("tweet",), time=("created_at",)),
    "tweets_b": SourceSpec(user=("screenname",), content=("text",), time=("date_sent",),
                           headerless=("screenname", "date_sent", "text", "retweets", "favorites")),
    "tweets_c": SourceSpec(user=("Twitter screenname",), content=("Tweet text",),
                           time=("Date tweet sent",)),
}

# Column-role candidates of the free-form CSV picker.
ROLE_CANDIDATES = {
    "user_id": ["user_id", "userid", "author", "USER_ID"],
    "post_content": ["post_content", "text", "tweet", "content", "body", "TEXT", "TWEET"],
    "timestamp": ["timestamp", "date", "created_at", "time", "TIMESTAMP"],
}


def _first(df: DataFrame, names) -> str | None:
    return next((n for n in names if n in df.columns), None)


def _time(df: DataFrame, spec: SourceSpec, base_time: _dt.datetime | None) -> Column:
    t = _first(df, spec.time)
    if t:
        return parse_timestamp(F.col(f"`{t}`"))
    e = _first(df, spec.epoch_time)
    if e:
        return epoch_seconds(e)
    if spec.synthetic_days is not None:
        if base_time is None:
            raise ValueError("synthetic timestamps need an explicit base_time")
        return F.col("_synthetic_ts")
    raise ValueError(f"No recognizable timestamp column among {spec.time + spec.epoch_time}")


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Dense 0-based row index without a single-partition window.

    Per-partition counts (one row per partition, a bounded table) give
    offsets; the index is offset + position inside the partition.
    """
    spark = df.sparkSession
    d = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = sorted(d.groupBy("_pid").count().collect())
    offsets, acc = [], 0
    for pid, cnt in counts:
        offsets.append((pid, acc))
        acc += cnt
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    return (d.join(F.broadcast(off), "_pid")
             .withColumn(name, F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
             .drop("_pid", "_mid", "_off"))


def map_source(df: DataFrame, spec: SourceSpec | str,
               base_time: _dt.datetime | None = None) -> DataFrame:
    """Map one raw dataset to ``(user_id, timestamp, post_content)``."""
    if isinstance(spec, str):
        spec = SPECS[spec]
    if spec.headerless and not any(c in df.columns for c in spec.user):
        df = df.toDF(*spec.headerless[: len(df.columns)], *df.columns[len(spec.headerless):])
    u = _first(df, spec.user)
    if u is None:
        raise ValueError(f"No recognizable user identifier among {spec.user}")
    if spec.content_concat:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
                 for c in spec.content_concat]
        content = F.trim(F.concat_ws(" ", *parts))
    else:
        c = _first(df, spec.content)
        if c is None:
            raise ValueError(f"No recognizable content column among {spec.content}")
        content = F.col(f"`{c}`").cast("string")
    if spec.synthetic_days is not None and not _first(df, spec.time):
        n = df.count()
        df = with_row_index(df, "_i").withColumn(
            "_synthetic_ts",
            F.lit(base_time) - F.make_interval(days=F.floor(F.lit(spec.synthetic_days) * F.col("_i") / F.lit(max(n, 1))).cast("int")))
    out = df.select(
        F.col(f"`{u}`").cast("string").alias("user_id"),
        _time(df, spec, base_time).alias("timestamp"),
        content.alias("post_content"),
    ).dropna(subset=["user_id", "timestamp", "post_content"])
    keep = F.trim(F.col("post_content")) != "" if spec.strip_filter else F.col("post_content") != ""
    return out.filter(keep)


def guess_columns(df: DataFrame) -> dict[str, str | None]:
    """First candidate name present for each role."""
    return {role: _first(df, names) for role, names in ROLE_CANDIDATES.items()}


def map_roles(df: DataFrame, user_col: str, time_col: str, text_col: str,
              min_chars: int = 5) -> DataFrame:
    """Select + rename, coerce time, drop nulls, keep stripped length > min_chars."""
    out = df.select(
        F.col(f"`{user_col}`").cast("string").alias("user_id"),
        parse_timestamp(F.col(f"`{time_col}`")).alias("timestamp"),
        F.col(f"`{text_col}`").cast("string").alias("post_content"),
    ).dropna(subset=["user_id", "timestamp", "post_content"])
    return out.filter(F.length(F.trim("post_content")) > min_chars)


def union_sources(dfs: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """Union of mapped datasets, re-coerced and re-filtered, tagged."""
    if not dfs:
        raise ValueError("No valid dataframes to combine.")
    parts = []
    for i, d in enumerate(dfs):
        tag = names[i] if names else str(i)
        ts = d["timestamp"] if dict(d.dtypes)["timestamp"].startswith("timestamp") else parse_timestamp(d["timestamp"])
        parts.append(d.select(F.col("user_id").cast("string").alias("user_id"), ts.alias("timestamp"),
                              F.col("post_content").cast("string").alias("post_content"),
                              F.lit(tag).alias("dataset")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.dropna(subset=["user_id", "timestamp", "post_content"])
    return out.filter(F.trim("post_content") != "")
