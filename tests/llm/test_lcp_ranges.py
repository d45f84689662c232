"""Operator 9 over many ranges, wide, null and repeated ids, against a plain version."""
import hashlib

import pytest

from postlens.llm import lcp


def plain(rows):
    """Every result by a loop over the sorted rows; ids here are unlike, or their texts equal."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 2] + other[:len(t) // 2]
        a, b, c = lcp.fingerprints([t, edited, other])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, lcp.likeness(a, b), lcp.likeness(a, c)))
    return out


def text(i):
    return " ".join(f"w{(i * 31 + k * k) % 211}" for k in range(5 + i % 60))


CASES = {
    "wide": [(-9 * 10**18, text(1)), (9 * 10**18, text(2)), (0, text(3)), (2**63 - 1, text(4)), (-2**63, text(5))],
    "outlier": [*((i, text(i)) for i in range(700)), (10**18, "far away")],
    "null ids": [*((None, "same words here") for _ in range(400)), *((i, text(i)) for i in range(30))],
    "one id": [*((7, "copy of a text") for _ in range(500)), (1, "before it"), (9, "after it")],
    "single": [(3, "alone in the table")],
}


@pytest.mark.parametrize("case", CASES)
def test_ranges_equal_a_plain_loop(spark, case):
    rows = CASES[case]
    got = lcp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))


def test_many_ranges_without_coalescing(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        for rows in (CASES["outlier"], CASES["one id"], CASES["wide"]):
            got = lcp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
