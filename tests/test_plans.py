"""Plans that must hold at scale: pruned scans, reused shuffles, no cross joins, no Python."""

import re

import pytest

from rowhelm.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"

PLANNED = [
    "table_profile", "duplicate_rows", "numeric_quartiles", "top_values", "column_profile", "daily_numeric",
    "daily_category_share", "detect_all", "detect_distribution", "enriched_detect_distribution",
    "enriched_detect_all_texts", "planned_vs_detected",
    "compare_profiles", "has_changes", "quality_issues", "synth_order_totals",
]


def plan_of(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "CollectLimit"):
        assert operator not in plan


def test_day_count_reads_the_date_column_only(spark):
    plan = plan_of(QUERIES["daily_volume"](spark, SF_DIR))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["l_shipdate:timestamp_ntz"]


def test_share_counts_are_shuffled_once(spark):
    plan = plan_of(QUERIES["daily_category_share"](spark, SF_DIR), run=True)
    assert "ReusedExchange" in plan and len(re.findall("FileScan", plan)) == 2


def test_enriched_shares_join_once(spark):
    # As for tables too large to broadcast.
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        plan = plan_of(QUERIES["enriched_detect_all_texts"](spark, SF_DIR), run=True)
    finally:
        spark.conf.unset(threshold)
    assert "ReusedExchange" in plan and len(re.findall("FileScan", plan)) == 3


def test_top_values_are_cut_before_the_shuffle(spark):
    assert re.search(r"WindowGroupLimit \[.*Partial", plan_of(QUERIES["top_values"](spark, SF_DIR)))


def test_detect_all_reads_the_table_three_times_at_most(spark):
    plan = plan_of(QUERIES["detect_all"](spark, SF_DIR), run=True)
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert len(scans) == 3 and "ts:timestamp_ntz" in min(scans, key=len)


def test_planned_tables_are_made_once(spark):
    # The profiles of orders and items have many parts; none of them makes the tables anew.
    plan = plan_of(QUERIES["planned_vs_detected"](spark, SF_DIR))
    assert plan.count("/events.parquet") == 1 and plan.count("/part.parquet") == 0
