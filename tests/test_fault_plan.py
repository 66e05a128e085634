"""Synthetic tables made under a plan of faults by day."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from rowhelm.operators import synth

NEGATIVE, MISSING, DROP, SHIFT = "negative_prices", "null_customers", "volume_drop", "category_shift"


def days(spark, number=8):
    day = F.date_add(F.lit(datetime.date(2024, 1, 1)), F.col("id").cast("int"))
    return spark.range(number).select(day.alias("day"), F.col("id").alias("day_idx"))


@pytest.fixture(scope="module")
def made(spark):
    plan = synth.fault_plan(spark, {1: DROP, 2: [NEGATIVE, MISSING], 3: SHIFT, 99: DROP})
    planned = synth.with_faults(days(spark), plan)
    orders = synth.synth_orders(synth.synth_daily_volume(planned, 400))
    products = synth.synth_products(spark.range(60))
    return planned, orders, synth.synth_items(orders, products), products


def by_day(df, value):
    return {r["day"].day - 1: r["v"] for r in df.groupBy(F.to_date("order_date").alias("day")).agg(value.alias("v")).collect()}


def test_faults_are_on_their_days_only(spark, made):
    planned, orders, items, products = made
    plain = synth.synth_daily_volume(days(spark), 400)
    usual = {r["day_idx"]: r["order_count"] for r in plain.collect()}
    counts = by_day(orders, F.count("*"))
    assert counts == usual | {1: usual[1] // 2}
    missing = by_day(orders, F.avg(F.col("customer_id").isNull().cast("int")))
    assert 0.12 < missing.pop(2) < 0.28 and set(missing.values()) == {0.0}
    lines = items.join(orders.select("order_id", "order_date"), "order_id").join(products.select("product_id", "category"), "product_id")
    negative = by_day(lines, F.avg((F.col("unit_price") < 0).cast("int")))
    assert 0.02 < negative.pop(2) < 0.09 and set(negative.values()) == {0.0}
    electronics = by_day(lines, F.avg((F.col("category") == "Electronics").cast("int")))
    assert 0.5 < electronics.pop(3) < 0.7 and max(electronics.values()) < 0.35


def test_ground_truth_and_totals(made):
    planned, orders, items, _ = made
    truth = [(r["day"].day - 1, r["fault"]) for r in synth.planted_faults(planned).orderBy("day", "fault").collect()]
    assert truth == [(1, DROP), (2, NEGATIVE), (2, MISSING), (3, SHIFT)]
    totals = synth.synth_order_totals(orders, items)
    sums = items.groupBy("order_id").agg(F.sum("line_total").alias("s")).join(totals, "order_id")
    assert sums.filter(F.abs(F.col("s") - F.col("total_amount")) > 0.005).count() == 0
    assert totals.filter("total_amount < 0").count() > 0


def test_an_empty_plan_changes_nothing(spark):
    plain = synth.synth_orders(synth.synth_daily_volume(days(spark), 50))
    nothing = synth.with_faults(days(spark), synth.fault_plan(spark, {}))
    planned = synth.synth_orders(synth.synth_daily_volume(nothing, 50))
    products = synth.synth_products(spark.range(60))
    assert sorted(planned.drop("faults").collect()) == sorted(plain.collect())
    assert sorted(synth.synth_items(planned, products).collect()) == sorted(synth.synth_items(plain, products).collect())
    assert synth.planted_faults(nothing).count() == 0


def test_unknown_faults_are_refused(spark):
    with pytest.raises(ValueError, match="typo"):
        synth.fault_plan(spark, {1: "typo"})


def test_made_rows_are_spread_and_never_broadcast(spark):
    # Few blocks are few bytes: adaptive execution would make all rows in one task, and broadcast them.
    orders = synth.synth_orders(synth.synth_daily_volume(days(spark), 400))
    assert orders.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = synth.synth_items(orders, synth.synth_products(spark.range(60)))
    items.collect()
    plan = items._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"SortMergeJoin \[category#\d+, rank#", plan) and not re.search(r"BroadcastHashJoin \[category#\d+, rank#", plan)
