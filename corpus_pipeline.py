"""Corpus pipeline over ``documents``: each stage works on all that its
predecessor kept, and each result is written as Parquet and read again.

1. toxicity: documents predicted toxic go.
2. near_dedup: one document of each group of near-duplicates stays, the one
   with the smallest id; rows that repeat it go.
3. passage_dedup: words that stand before in another document go.
4. mixing: every document stays once; blocks of words that its source's target
   weight draws a second time follow its text.
5. bpe: token counts and digests of ids and decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlens.llm import bpe, mixing, setsketch, suffix, toxicity
from postlens.llm.common import documents, scratch_folder, table
from postlens.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.representatives(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_path(), digests=True)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mixing", mix), ("bpe", encode)]
#: A fitted classifier and hashed draws cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), scratch_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
