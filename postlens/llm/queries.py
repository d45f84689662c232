"""Registered queries of the subpackage: each applies one operator, with its
production parameters, to a whole input table.  SQL twins are in ``ORACLES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, bpe, chaining, decontaminate, lcp, licenses, mixing, ranked, setsketch, suffix, tokenfile, topk, toxicity
from .common import documents, scratch_folder, table


def tokenizer_path() -> str:
    """Vocabulary file of the contracts; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path(), digests=True)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.passages(documents(spark, sf_dir))


def op7_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.fuzzy_passages(documents(spark, sf_dir))


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(documents(spark, sf_dir), tokenizer_path(), scratch_folder(spark, "tokens"))


def op9_lcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.edited_fingerprints(documents(spark, sf_dir))


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(documents(spark, sf_dir))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_topk": op2_topk,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_suffix": op6_suffix,
    "op7_chaining": op7_chaining,
    "op8_tokenfile": op8_tokenfile,
    "op9_lcp": op9_lcp,
    "op10_setsketch": op10_setsketch,
    "op11_ranked": op11_ranked,
    "op12_decontaminate": op12_decontaminate,
    "op13_audit": op13_audit,
}

_OP2_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP11_SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
q AS (SELECT item_id, t AS term, CAST(count(*) AS BIGINT) AS times
      FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
f AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
      FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY 1, 2, 3),
g AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(c.docs AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS weight
      FROM f, c GROUP BY term, c.docs),
s AS (SELECT q.item_id, f.doc_id,
             CAST(sum(q.times * g.weight * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * f.n * c.docs) // c.terms)))) AS BIGINT) AS score
      FROM f JOIN g USING (term) JOIN q USING (term), c GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

_OP12_SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, a, a + least(len(w), 10) - 1) AS words
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS a FROM i WHERE len(w) > 0)),
r AS (SELECT doc_id, a, size, list_slice(w, a, a + size - 1) AS words
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS a FROM d, (SELECT DISTINCT size FROM p))),
h AS (SELECT DISTINCT r.doc_id, r.a, r.size, p.item_id FROM r JOIN p ON r.size = p.size AND r.words = p.words),
n AS (SELECT doc_id, CAST(count(DISTINCT spot) AS BIGINT) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + size)) AS spot FROM h) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(o.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)"""


def _op13_sql() -> str:
    """Every order and step by itself: the filters before it, and all documents of each part."""
    from itertools import permutations

    bit = {c: 1 << i for i, c in enumerate(audit.NAMES)}
    steps = ", ".join(f"('{''.join(o)}', {k + 1}, {sum(bit[c] for c in o[:k])}, {bit[o[k]]})" for o in permutations(audit.NAMES) for k in range(len(o)))
    return rf"""
WITH l AS (SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INTEGER)) AS good, max(CAST(coalesce(toxic, 0) = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > low THEN 16 ELSE 0 END AS failed FROM w),
c AS (SELECT part, failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
s AS (SELECT * FROM (VALUES {steps}) AS s(filter_order, step, before, bit)),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN failed & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN failed & before <> 0 AND failed & bit <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN n * good ELSE 0 END) AS good_lost,
             sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN n * toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""


ORACLES: dict[str, str] = {
    "op2_topk": _OP2_SQL,
    "op11_ranked": _OP11_SQL,
    "op12_decontaminate": _OP12_SQL,
    "op13_audit": _op13_sql(),
}
