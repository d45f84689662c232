"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, optional).  Each query is fully evaluated with
the ``noop`` sink (no collect).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "suspicious_users_posts",
    "user_scores_events",
    "user_temporal_events",
    "lda_term_counts_documents",
    "tfidf_documents",
    "multilingual_term_counts",
    "clean_chain_pages",
    "phrases_posts",
    "vocabulary_user_week",
    "token_positions_user_week",
    "duplicate_ratio_by_source",
    "similar_pairs_documents_by_lang",
    "coherence_cv_lang_topics",
    "lda_fit_user_week",
    "embed_topics_ctfidf",
    "compare_narrowness_events",
    "topic_similarity_matrix_events",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from postlens.plans.registry import all_queries
    from postlens.session import get_spark

    spark = get_spark(f"local[{cpus}]", max(cpus, 8))
    qs = all_queries()
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else [n for n in HEADLINE if n in qs]
    times, failed = {}, {}
    for name in names:
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
        except Exception as e:  # keep measuring the others; report the failure
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"# {name}: FAILED {failed[name]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      **({"failed": failed} if failed else {})}))


if __name__ == "__main__":
    main()
