"""Plan properties of registered queries: no Python UDFs, no cartesian products or nested-loop joins,
and scans read only the columns a query needs."""

import pytest

import __spark_entry__ as E
from conftest import SF

PLAN_QUERIES = [
    "column_profile", "numeric_stats", "categorical_top_values", "histogram_40", "histogram_by_group",
    "correlation_matrix", "box_stats", "ols_trendline", "duplicate_rows", "stratified_split",
    "classification_metrics", "roc_auc", "roc_curve", "confusion_matrix", "regression_metrics",
    "cluster_profile", "trust_log", "impute_median", "feature_kinds", "report_metric_table",
]
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_plans_stay_in_the_jvm_without_cartesian_products(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad} in plan"


def test_histogram_scan_reads_one_column(spark):
    plan = _plan(E.queries()["histogram_40"](spark, SF))
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert scans and all("ReadSchema: struct<l_extendedprice:double>" in s for s in scans)


def test_box_stats_scan_prunes_columns(spark):
    plan = _plan(E.queries()["box_stats"](spark, SF))
    for s in [line for line in plan.split("\n") if "FileScan parquet" in line]:
        assert "l_orderkey" not in s and "l_shipdate" not in s
