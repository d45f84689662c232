"""CSV quoting / newlines, JSONL bad lines, required columns, adapters."""
import datetime as dt
import os
import tempfile

import pytest

from postlens.sources import adapters as A
from postlens.sources import files as FS


def _tmp(content, suffix):
    d = tempfile.mkdtemp(prefix="postlens-test-")
    p = os.path.join(d, "f" + suffix)
    with open(p, "w", encoding="utf-8") as f:
        f.write(content)
    return p


def test_csv_quotes_and_newlines(spark):
    p = _tmp('user_id,timestamp,post_content\nu1,2024-01-01 10:00:00,"say ""hi""\nsecond line"\n'
             'u2,notadate,"x"\n,2024-01-02 00:00:00,"y"\n', ".csv")
    rows = FS.read_posts(spark, p).collect()
    assert len(rows) == 1
    assert rows[0].post_content == 'say "hi"\nsecond line'


def test_jsonl_bad_line_dropped(spark):
    p = _tmp('{"user_id": "a", "timestamp": "2024-01-01T00:00:00", "post_content": "ok"}\n{broken\n'
             '{"user_id": "b", "timestamp": "2024-01-02T00:00:00", "post_content": "fine"}\n', ".jsonl")
    rows = FS.read_posts(spark, p).collect()
    assert sorted(r.user_id for r in rows) == ["a", "b"]


def test_missing_column_and_format(spark):
    p = _tmp("user_id,text\nu,x\n", ".csv")
    with pytest.raises(ValueError, match="Missing required columns"):
        FS.read_posts(spark, p)
    with pytest.raises(ValueError, match="Unsupported"):
        FS.read_any(spark, "/x/y.txt")


def test_adapters(spark):
    reddit = spark.createDataFrame([("p1", "T", None, 1704067200.0), ("p2", None, None, 1704067200.0)],
                                   "id string, title string, body string, created double")
    out = A.map_source(reddit, "reddit").collect()
    assert [(r.user_id, r.post_content) for r in out] == [("p1", "T")]
    fake = spark.createDataFrame([("u1", "a"), ("u2", "b"), ("u3", "c")], "username string, text string")
    base = dt.datetime(2024, 3, 1)
    f = sorted(A.map_source(fake, "fake", base_time=base).collect(), key=lambda r: r.user_id)
    assert [r.timestamp for r in f] == [base - dt.timedelta(days=int(60 * i / 3)) for i in range(3)]
    c = spark.createDataFrame([("s", "2024-01-01 00:00:00", "hello")],
                              "`Twitter screenname` string, `Date tweet sent` string, `Tweet text` string")
    assert A.map_source(c, "tweets_c").first().user_id == "s"
    assert A.guess_columns(c) == {"user_id": None, "post_content": None, "timestamp": None}
    raw = spark.createDataFrame([("u", "2024-01-01", "short"), ("v", "2024-01-01", "long enough")],
                                "author string, date string, content string")
    g = A.guess_columns(raw)
    assert g == {"user_id": "author", "post_content": "content", "timestamp": "date"}
    assert [r.user_id for r in A.map_roles(raw, g["user_id"], g["timestamp"], g["post_content"]).collect()] == ["v"]


def test_headerless_with_junk_lines(spark):
    from postlens.sources import adapters as A
    p = _tmp("junk line one\nanother, junk\nthird\nalice,2024-01-01 10:00:00,hello world,3,4\n"
             "bob,2024-01-02 11:00:00,second post,0,1\n", ".csv")
    schema = "screenname string, date_sent string, text string, retweets int, favorites int"
    from pyspark.sql.types import _parse_datatype_string
    raw = FS.read_headerless(spark, p, _parse_datatype_string(schema))
    out = sorted(A.map_source(raw, "tweets_b").collect(), key=lambda r: r.user_id)
    assert [(r.user_id, r.post_content) for r in out] == [("alice", "hello world"), ("bob", "second post")]
