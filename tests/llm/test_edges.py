"""Defined results on odd rows and on empty tables, for every operator and stage."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from postlens.llm import bpe, chaining, lcp, licenses, mixing, setsketch, suffix, tokenfile, topk, toxicity
from postlens.llm.common import scratch_folder
from postlens.llm.queries import tokenizer_path

RUNS = {
    "licenses": lambda d, s: licenses.scan(d),
    "mixing": lambda d, s: mixing.mixture(d),
    "mixed": lambda d, s: mixing.mixed_documents(d),
    "toxicity": lambda d, s: toxicity.scores(d, s),
    "without_toxic": lambda d, s: toxicity.without_toxic(d, s),
    "bpe": lambda d, s: bpe.encode_decode(d, tokenizer_path()),
    "suffix": lambda d, s: suffix.passages(d),
    "without_repeats": lambda d, s: suffix.without_repeats(d),
    "chaining": lambda d, s: chaining.fuzzy_passages(d),
    "tokenfile": lambda d, s: tokenfile.token_files(d, tokenizer_path(), scratch_folder(d.sparkSession, "t")),
    "lcp": lambda d, s: lcp.edited_fingerprints(d),
    "setsketch": lambda d, s: setsketch.near_duplicates(d),
    "representatives": lambda d, s: setsketch.representatives(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(name, nothing, labels):
    assert RUNS[name](nothing, labels.limit(0)).collect() == []


def test_bpe_and_files_match_the_library(edges, edge_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids for _, t, *_ in edge_rows}
    got = sorted(((r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in RUNS["bpe"](edges, None).collect()))
    assert got == sorted((r[0] or 0, len(ids[r[1]]), np.array(ids[r[1]], "<u4").tobytes(), tok.decode(ids[r[1]], skip_special_tokens=False)) for r in edge_rows)
    start, want = 0, []
    for r in sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = [*ids[r[1]], 2]
        want.append((r[0], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    got = [tuple(r) for r in RUNS["tokenfile"](edges, None).orderBy("start").collect()]
    assert got == want


def test_toxicity_rows(edges, labels, edge_rows):
    rows = RUNS["toxicity"](edges, labels).collect()
    assert len(rows) == len(edge_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.score == 0 for r in RUNS["toxicity"](edges, labels.limit(0)).collect())


def test_mixing_bounds(edges, edge_rows):
    rows = RUNS["mixing"](edges, None).collect()
    assert len(rows) == len(edge_rows)
    assert all(r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size + 1e-9 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, RUNS["mixing"](edges, None).collect()))
    assert {(r.doc_id, r["size"]) for r in rows} >= {(3, 0), (4, 0), (8, 0), (5, 2)}


def test_near_duplicates(edges, edge_rows):
    rows = RUNS["setsketch"](edges, None).collect()
    assert len(rows) == len(edge_rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert by[3].n_shingles == by[4].n_shingles == by[8].n_shingles == 0 and by[4].kept and by[3].kept
    assert by[5].n_shingles == 1 and by[None].kept and by[None].component_id is None
    kept = RUNS["representatives"](edges, None)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_passages(edges):
    spans = {(r.doc_id, r.removed): (r.start, r.stop) for r in RUNS["suffix"](edges, None).collect()}
    assert spans[2, True] == (0, 120)  # all of it stands in document 1
    left = {r.doc_id: r.text for r in RUNS["without_repeats"](edges, None).collect()}
    assert 2 not in left and left[4] is None and left[5] == "one two"


def test_fuzzy_passage(spark):
    words = [f"w{i * 7919 % 10007}" for i in range(200)]
    changed = list(words)
    for i in range(30, 200, 31):
        changed[i] = "other"
    rows = [(1, "start " + " ".join(words)), (2, " ".join(f"q{i}" for i in range(80)) + " " + " ".join(changed)), (3, "clean text"), (4, None), (None, " ".join(words))]
    got = chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_doc) for r in got] == [(2, 1)]
    assert got[0].start <= 85 and got[0].stop >= 275 and 0.95 < got[0].identity < 1


def test_fuzzy_passage_split_over_earlier_documents(spark):
    words = [f"p{i * 7919 % 10007}" for i in range(60)]

    def around(i, w):
        return i, " ".join([*(f"a{i}x{k}" for k in range(30)), *w, *(f"z{i}x{k}" for k in range(30))])
    rows = [around(1, words[:30]), around(2, words[30:]), around(3, words), around(4, words)]
    got = chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_doc, r.identity) for r in got] == [(4, 3, 1.0)]
    assert (got[0].start, got[0].stop, got[0].first_start, got[0].first_stop) == (30, 90, 30, 90)


def test_fingerprints(edges, edge_rows):
    rows = RUNS["lcp"](edges, None).collect()
    order = sorted(edge_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for k, r in enumerate(order):
        t, o = r[1] or "", order[(k + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + o[:len(t) // 2]
        want.append((r[0] or 0, len(t), hashlib.sha256(edited.encode()).hexdigest(), lcp.fingerprints([t])[0], lcp.fingerprints([edited])[0]))
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in rows) == sorted(want)


def test_top_k(spark):
    from math import floor, isfinite

    rows = [(50, [1.0, 0.5]), (50, [1.0, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, [1e12, 1.0]), (7, []), (100, [0.1, -0.3]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [floor(256 * c) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and isfinite(c) for c in v)}
    want = []
    for q in (50, 100):
        pairs = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(pairs, 1)]
    got = [tuple(r) for r in topk.top_k(table, table.vec_id % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == want
    assert topk.top_k(table.limit(0), table.vec_id % 50 == 0).collect() == []


def test_licence_lines(spark):
    rows = [(1, "prose here\nLicensed under the Apache License, Version 2.0."), (2, "the license plate of a car"), (3, None), (4, "Released under the MIT License.")]
    got = {r.doc_id: (r.paragraph, r.family, r.confirmed) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, "apache", True) and got[4] == (0, "mit", True)


def test_stages_keep_the_columns(spark, edges, tmp_path, edge_rows):
    sf = str(tmp_path)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    edges.select(names).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == names
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
