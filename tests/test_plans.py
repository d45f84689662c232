"""Plan checks: no cartesian / nested-loop joins, no Python UDF outside the
MLlib bridge, column pruning and filter push-down on the scans."""
import pytest

from sample_paths import SF_SMALL
from postlens.plans.registry import ROWS_ONLY, all_queries

QUERIES = all_queries()


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ROWS_ONLY)))
def test_no_cartesian_no_python(spark, name):
    p = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p, name
    assert "BroadcastNestedLoopJoin" not in p, name
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F
    from postlens.sources import fixtures as FX
    df = FX.table(spark, SF_SMALL, "events").filter(F.col("event_id") % 2 == 0).select("user_id", "ts")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in p
    d = FX.table(spark, SF_SMALL, "documents").filter(F.col("lang") == "en").select("doc_id")
    p = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p


def test_filter_on_merged_tokens_stays_above_the_merge(spark):
    from pyspark.sql import functions as F
    from postlens.operators import phrases as P
    tok = spark.createDataFrame([(1, ["a", "b", "c"])], "post_id long, tokens array<string>")
    phr = spark.createDataFrame([("a", "b")], "a string, b string")
    out = P.apply_phrases(tok, phr).filter(F.size("tokens") >= 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter (" in line]
    assert any("size(tokens" in line for line in filters) and not any("transform" in line for line in filters)
    assert plan.count("concat_ws(_, ") == 1
