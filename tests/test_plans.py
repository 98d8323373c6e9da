import re

import pytest

import __spark_entry__ as E
from sample_tables import SF_SMALL


def _plan(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["seeded_permutation", "cluster_batch_order", "assign_batches", "dense_row_id"])
def test_global_orders_have_no_single_partition_window_over_rows(spark, key):
    lines = _plan(spark, key).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            # the only single-partition exchange feeds the per-partition count table
            assert "HashAggregate" in below and "_pid" in below, (key, line, below)


def test_parquet_scan_prunes(spark):
    df = E.queries()["scan_parquet"](spark, SF_SMALL)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert re.search(r"ReadSchema: struct<page_id:bigint,url:string>", plan)


@pytest.mark.parametrize("key", ["ova_topk", "predict_and_eval", "hard_negatives", "rai_joint"])
def test_retrieval_plans_are_blocked_with_group_limit(spark, key):
    plan = _plan(spark, key)
    assert "MapInArrow" in plan and "FlatMapCoGroupsInArrow" not in plan and "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
