"""Shared helpers of the subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlens.session import cut_lineage, ensure_checkpoint_dir  # noqa: F401

#: A word is a maximal run of characters other than these (Java and Python regex).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, through Spark's reader (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def plain_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, so shared by all executors."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until ``docs`` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def counted_anew(docs: DataFrame, changed: Column) -> DataFrame:
    """``docs`` with ``n_chars`` of the texts that ``changed`` marks; without that column as they are."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
