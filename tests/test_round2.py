"""Repeated posts, date shapes, missing results."""

from pyspark.sql import functions as F

from postlens.functions.timebins import parse_timestamp
from postlens.operators.phrases import apply_phrases
from postlens.sources.files import read_result, to_posts


def test_repeated_posts_keep_their_tokens(spark):
    df = spark.createDataFrame([("u", "2022-01-01 00:00:00", "alpha beta gamma delta")] * 2, "user_id string, timestamp string, post_content string")
    posts = to_posts(df)
    assert posts.select("post_id").distinct().count() == 2
    tokens = posts.select(F.lit(7).alias("post_id"), F.split("post_content", " ").alias("tokens"))  # even with one id
    phrases = spark.createDataFrame([("alpha", "beta"), ("beta", "gamma"), ("gamma", "delta")], "a string, b string")
    got = [r.tokens for r in apply_phrases(tokens, phrases.withColumn("phrase", F.lit(""))).collect()]
    assert got == [["alpha_beta", "gamma_delta"]] * 2


def test_date_shapes(spark):
    texts = ["Thu May 05 19:10:11 +0000 2022", "1/2/2024 3:04", "02/27/2022", "2022/02/27 10:00", "27 Feb 2022", "notadate"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(parse_timestamp("t"), "yyyy-MM-dd HH:mm").alias("d"))
    assert [r.d for r in df.collect()] == ["2022-05-05 19:10", "2024-01-02 03:04", "2022-02-27 00:00", "2022-02-27 10:00", "2022-02-27 00:00", None]


def test_missing_result_is_none(spark, tmp_path):
    assert read_result(spark, f"file://{tmp_path}/none") is None
    spark.range(3).write.parquet(f"file://{tmp_path}/there")
    assert read_result(spark, f"file://{tmp_path}/there").count() == 3
