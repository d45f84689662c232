"""File scans (S1 - S4, S12) and the posts contract."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.timebins import parse_timestamp
from ..session import cut_lineage
from .csvsplit import csv_records

POST_COLUMNS = ["user_id", "timestamp", "post_content"]


BAD = "_bad"


def csv_rows(spark: SparkSession, path: str, schema: StructType, header: bool = True, skip_lines: int = 0) -> DataFrame:
    """The columns of ``schema`` and ``_bad``: the text of a record that does not fit it
    (number of fields, types), else null.  Read by splits, see ``csvsplit``."""
    rows = csv_records(spark, path, skip_lines).filter(F.trim("text") != "")
    if header:
        rows = rows.filter("NOT first")
    full = StructType([*(StructField(f.name, f.dataType) for f in schema.fields), StructField(BAD, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "escape": '"', "quote": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    return rows.select(F.from_csv("text", full.simpleString(), options).alias("r")).select("r.*")


def count_bad(rows: DataFrame, name: str = "bad_lines"):
    """``(good rows without _bad, observation)``: the observation holds ``{name: n}``
    after the first action, so bad lines are counted in the same pass."""
    seen = Observation(name)
    rows = rows.observe(seen, F.count(F.col(BAD)).alias(name))
    return rows.filter(F.col(BAD).isNull()).drop(BAD), seen


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = True) -> DataFrame:
    """RFC-4180 CSV (``""`` quoting, newlines inside quoted fields).  Without a schema
    all columns are strings, named by the first record; missing fields are null and
    surplus ones are left out."""
    if schema is None:
        probe = spark.read.option("header", header).option("multiLine", True).option("escape", '"').csv(path)
        schema = StructType([StructField(c, StringType()) for c in probe.columns])
    return csv_rows(spark, path, schema, header).drop(BAD)


def read_headerless(spark: SparkSession, path: str, schema, skip_lines: int = 3) -> DataFrame:
    """Headerless CSV whose first ``skip_lines`` lines are junk; the first schema fields
    are kept and surplus ones left out; records without a first field are dropped."""
    rows = csv_rows(spark, path, schema, False, skip_lines).drop(BAD)
    return rows.filter(F.col(schema.fieldNames()[0]).isNotNull())


def jsonl_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As ``csv_rows``, for one JSON object a line."""
    full = StructType([*schema.fields, StructField(BAD, StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One object per line; malformed lines are dropped (``jsonl_rows`` with
    ``count_bad`` counts them)."""
    r = spark.read.option("mode", "DROPMALFORMED")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S3: dispatch on the suffix; unknown formats raise."""
    p = path.rstrip("/").lower()
    if p.endswith(".csv"):
        return read_csv(spark, path, schema)
    if p.endswith(".jsonl") or p.endswith(".json"):
        return read_jsonl(spark, path, schema)
    if p.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError("Unsupported file format. Please provide CSV, JSONL or Parquet.")


def require_columns(df: DataFrame, required=POST_COLUMNS) -> DataFrame:
    """Raise with the list of missing column names."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def to_posts(df: DataFrame, id_col: str | None = None, lost: Observation | None = None) -> DataFrame:
    """Coerce to the posts contract and drop rows missing a key (F1).  ``lost`` counts, in
    the same pass, all rows and those without a user, a timestamp (none, or none that can
    be read) or content.

    ``post_id`` is taken from ``id_col`` when given.  Else rows are numbered once
    and the numbers written with them (a checkpoint), so equal posts of one user
    have ids of their own and a recomputation cannot change them.  A stream has
    no row numbers: there the id is a hash of the content.
    """
    require_columns(df)
    ts = df["timestamp"]
    ts_col = ts if dict(df.dtypes)["timestamp"].startswith("timestamp") else parse_timestamp(ts)
    if id_col:
        pid = F.col(id_col).cast("long")
    elif df.isStreaming:
        pid = F.xxhash64(F.col("user_id").cast("string"), ts_col.cast("string"), F.col("post_content"))
    else:
        pid = F.monotonically_increasing_id()
    out_user, out_text = F.col("user_id").cast("string"), F.col("post_content").cast("string")
    out = df.select(pid.alias("post_id"), out_user.alias("user_id"), ts_col.alias("timestamp"), out_text.alias("post_content"))
    if lost is not None:
        none = lambda c: F.count_if(F.col(c).isNull())
        blank = F.trim(ts.cast("string")).isNull()
        out = df.select(out_user.alias("user_id"), ts_col.alias("timestamp"), blank.alias("_blank"), out_text.alias("post_content"), pid.alias("post_id"))
        out = out.observe(lost, F.count("*").alias("rows"), none("user_id").alias("no_user"), F.count_if("_blank").alias("no_timestamp"),
                          F.count_if(F.col("timestamp").isNull() & ~F.col("_blank")).alias("unread_timestamp"), none("post_content").alias("no_content"))
        out = out.select("post_id", "user_id", "timestamp", "post_content")
    out = out.dropna(subset=POST_COLUMNS)
    return out if id_col or df.isStreaming else cut_lineage(out)


def read_posts(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """``load_data``: scan + required columns + coercion + null drop."""
    return to_posts(read_any(spark, path, schema))


def read_result(spark: SparkSession, path: str) -> DataFrame | None:
    """Read a saved result table (Parquet dir or JSON) at any path that Spark
    reads; missing -> None."""
    try:
        return spark.read.json(path) if path.rstrip("/").endswith((".json", "_summary")) else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
