"""Shares of an enriched table, counted before the joins."""

import datetime

import pytest
from pyspark.sql import functions as F

from rowhelm.operators.daily import daily_category_share, daily_volume
from rowhelm.operators.enrich import Lookup, counted_rows, enriched_categories


def rows(df):
    return sorted(tuple(repr(round(v, 12) if isinstance(v, float) else v) for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    n = F.col("id")
    # A third of all lines has one part, another key is missing or has no partner.
    part = F.when(n % 3 == 0, 7).when(n % 11 == 0, F.lit(None)).when(n % 13 == 0, 999).otherwise(n % 40)
    lines = spark.range(3000).select((n % 500).alias("l_order"), part.alias("l_part"), F.when(n % 5 > 0, F.concat(F.lit("f"), (n % 3).cast("string"))).alias("flag"))
    day = F.date_add(F.lit(datetime.date(2024, 1, 1)), (n % 9).cast("int"))
    orders = spark.range(480).select(n.alias("o_key"), F.when(n % 17 > 0, day).alias("o_day"), F.concat(F.lit("s"), (n % 4).cast("string")).alias("status"))
    # Part 7 is there twice, so its lines count twice; brands are longer than a key may be.
    parts = spark.range(40).union(spark.range(7, 8)).select(n.alias("p_key"), F.concat(F.repeat(F.lit("brand "), 15), (n % 6).cast("string")).alias("brand"))
    return lines, orders, parts


def lookups(orders, parts):
    return [Lookup(orders, "l_order", "o_key"), Lookup(parts, "l_part", "p_key")]


@pytest.mark.parametrize("turned", [False, True])
def test_equal_to_the_joined_table(spark, tables, turned):
    lines, orders, parts = tables
    sides = lookups(orders, parts)[:: -1 if turned else 1]
    shares, volume = enriched_categories(lines, sides, "o_day", ["flag", "status", "brand"])
    joined = lines.join(orders, F.col("l_order") == F.col("o_key")).join(parts, F.col("l_part") == F.col("p_key"))
    joined = joined.select("o_day", "flag", "status", "brand")
    expected = daily_volume(joined, "o_day")
    assert rows(volume) == rows(expected) and expected.count() == 9
    assert rows(shares) == rows(daily_category_share(joined, "o_day", volume=expected).select(*shares.columns))


def test_hot_key_is_few_rows_at_its_join(spark, tables):
    lines, orders, parts = tables
    counted = counted_rows(lines, lookups(orders, parts), "o_day", ["flag", "status", "brand"])
    hot = counted.filter(F.col("brand").endswith(" 1"))
    assert hot.count() < hot.agg(F.sum("_rows")).first()[0] / 2


def test_text_columns_are_the_default_and_keys_are_not(spark, tables):
    lines, orders, parts = tables
    orders = orders.withColumn("buyer_id", F.lit("x"))
    shares, _ = enriched_categories(lines, lookups(orders, parts), "o_day")
    assert {r["column"] for r in shares.select("column").distinct().collect()} == {"flag", "status", "brand"}


def test_date_of_the_fact_table_and_empty_tables(spark, tables):
    lines, orders, _ = tables
    dated = orders.withColumn("kind", F.lit("k"))
    kinds = spark.createDataFrame([("s0", "even"), ("s2", "even"), ("s1", "odd")], "name string, parity string")
    shares, volume = enriched_categories(dated, [Lookup(kinds, "status", "name")], "o_day", ["kind", "parity"])
    assert volume.agg(F.sum("row_count")).first()[0] == orders.filter("o_day is not null and status <> 's3'").count()
    assert {r["column"] for r in shares.collect()} == {"kind", "parity"}
    shares, volume = enriched_categories(dated.limit(0), [Lookup(kinds, "status", "name")], "o_day", ["kind", "parity"])
    assert shares.count() == volume.count() == 0
