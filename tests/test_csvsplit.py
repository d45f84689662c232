"""Quoted CSV read by splits equals the reader that takes a file whole; bad lines are counted."""
import os
import random
import tempfile

import pytest
from pyspark.sql.types import _parse_datatype_string

from postlens.sources import csvsplit as CS
from postlens.sources import files as FS


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def folder(*texts):
    d = tempfile.mkdtemp(prefix="postlens-test-")
    for i, t in enumerate(texts):
        with open(os.path.join(d, f"f{i}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(t)
    return d


def random_csv(rng, rows):
    def field():
        plain = "".join(rng.choice("ab é5") for _ in range(rng.randint(1, 12)))
        if rng.random() < 0.2:
            return plain + 'x"y'                                  # a stray quote is text
        if rng.random() < 0.5:
            return plain
        return '"' + "".join(rng.choice(["a", "\n", '""', ",", " long words here ", "\n\n"]) for _ in range(rng.randint(0, 15))) + 'z"'
    return "a,b,c\n" + "".join(",".join(field() for _ in range(3)) + "\n" for _ in range(rows))


def test_splits_equal_the_whole_file_reader(spark, tiny_splits):
    rng = random.Random(8)
    d = folder(*[random_csv(rng, 60) for _ in range(4)], "a,b,c\n", '"a","b","c"\n"' + "very long\n" * 60 + '",2,3')
    lines = CS._lines(spark, d)
    assert lines.select("file", "split").distinct().count() > 40           # quoted fields do cross borders
    got = FS.read_csv(spark, d)
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(d)
    assert got.columns == want.columns == ["a", "b", "c"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 241


def test_skipped_lines_and_bad_lines(spark, tiny_splits):
    junk = 'junk, "never closed\n' + "x" * 200 + "\nmore\n"
    body = "".join(f'u{i},2022-01-01,"text {i}\nline two",7\n' for i in range(30)) + "short\n,2022-01-01,no user,1\n"
    d = folder(junk + body, junk + body)
    schema = _parse_datatype_string("screenname string, date_sent string, text string")
    rows = FS.read_headerless(spark, d, schema).collect()
    assert len(rows) == 62 and sum("\nline two" in (r.text or "") for r in rows) == 60
    typed = folder("a,b\n1,x\n2,y,z\noops,y\n4,w\n")
    good, seen = FS.count_bad(FS.csv_rows(spark, typed, _parse_datatype_string("a int, b string")))
    assert sorted((r.a, r.b) for r in good.collect()) == [(1, "x"), (4, "w")] and seen.get == {"bad_lines": 2}


def test_jsonl_bad_lines_are_counted(spark):
    d = tempfile.mkdtemp(prefix="postlens-test-")
    with open(os.path.join(d, "f.jsonl"), "w") as f:
        f.write('{"a": 1}\n{broken\n{"a": "text"}\n{"a": 3}\n')
    good, seen = FS.count_bad(FS.jsonl_rows(spark, d, _parse_datatype_string("a int")))
    assert sorted(r.a for r in good.collect()) == [1, 3] and seen.get == {"bad_lines": 2}


def test_line_states():
    assert [CS.ends_inside(s, False) for s in ('a,b', 'a,"b', '"a""', '"a"""', 'x"y,z', 'a,"b",c"', '"a"b,"c')] == [False, True, True, False, False, False, True]
    assert [CS.ends_inside(s, True) for s in ('a,b', 'a",b', 'a"",b', 'a","b', '"",x"', '"')] == [True, False, True, True, False, False]


def test_dates_and_lost_rows(spark):
    from pyspark.sql import Observation
    shapes = {"27/02/2022": "2022-02-27 00:00:00", "February 27, 2022": "2022-02-27 00:00:00", "2/27/22": "2022-02-27 00:00:00", "27-Feb-2022": "2022-02-27 00:00:00",
              "20220227": "2022-02-27 00:00:00", "1651777811": "2022-05-05 19:10:11", "1651777811000": "2022-05-05 19:10:11", "02/03/2022": "2022-02-03 00:00:00",
              "27/02/2022 13:05": "2022-02-27 13:05:00", "27.02.2022": "2022-02-27 00:00:00", "2022-02-27T10:00:00Z": "2022-02-27 10:00:00"}
    rows = [(f"u{i}", t, "x") for i, t in enumerate(shapes)] + [("a", "notadate", "x"), ("b", "99/99/2022", "x"), ("c", None, "x"), (None, "2022-01-01", "x"), ("d", "2022-01-01", None)]
    seen = Observation("lost")
    posts = FS.to_posts(spark.createDataFrame(rows, "user_id string, timestamp string, post_content string"), lost=seen)
    got = {r.user_id: str(r.timestamp) for r in posts.collect()}
    assert got == {f"u{i}": v for i, v in enumerate(shapes.values())}
    assert seen.get == {"rows": 16, "no_user": 1, "no_timestamp": 1, "unread_timestamp": 2, "no_content": 1}
