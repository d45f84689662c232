"""Streams over tables of several files; phrases and tables that are made once."""
import os

from postlens.operators import phrases as P
from postlens.plans import catalog_compare, catalog_embed, catalog_io
from sample_paths import SF_SMALL


def test_stream_reads_one_file_and_folders(spark, tmp_path):
    rows = [(i, f"words number{'x' * i} standing here together", "en", "s", 30) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path / "folder")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    single = str(tmp_path / "single")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    part = next(f for f in os.listdir(tmp_path / "one") if f.endswith(".parquet"))
    os.makedirs(single)
    os.link(tmp_path / "one" / part, f"{single}/documents.parquet")
    for path in (folder, single):
        got = catalog_io.q_stream_tokens_documents(spark, path).collect()
        assert sorted(r.doc_id for r in got) == list(range(6))


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_few_phrases_are_broadcast_and_pairs_stay(spark):
    rows = [(i, ["new", "york", "city", f"w{i}"]) for i in range(30)] + [(99, ["new_york", "bay", "new", "york"])]
    tokens = spark.createDataFrame(rows, "post_id long, tokens array<string>")
    found = P.learn_phrases(tokens, 5, 0.05)
    joined = _plan(P.apply_phrases(tokens, found))
    assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in joined.splitlines())
    # "new york" is counted with the unigram spelled "new_york": 31 + 1 of 31 and 31 tokens.
    pairs = {(x, y) for _, t in rows for x, y in zip(t, t[1:], strict=False)}
    n = len({w for _, t in rows for w in t} | {f"{x}_{y}" for x, y in pairs})
    got = {r.phrase: r.score for r in found.collect()}
    assert abs(got["new_york"] - (32 - 5) / (31 * 31) * n) < 1e-9


def test_texts_are_read_once_for_the_topic_tables(spark):
    wa, wb = catalog_compare.word_tables(catalog_compare.doc_tokens(spark, SF_SMALL))
    terms = catalog_embed._label_terms(spark, SF_SMALL)[0]
    for df in (wa, wb, terms):
        assert not any("documents" in f for f in df.inputFiles())
