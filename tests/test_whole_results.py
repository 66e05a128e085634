"""No row, field or date is lost, and equal values have one key whatever the width of the row."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rowhelm.operators.compare import compare_schema
from rowhelm.operators.profile import column_profile, duplicate_rows, text_profile
from rowhelm.operators.synth import synth_items, synth_order_totals
from rowhelm.plans.runs import detect_directory, profile_directory
from rowhelm.sources.csv import read_csv
from rowhelm.sources.dates import matching_formats, with_date_column


@pytest.mark.parametrize("extra", [0, 40])
def test_instants_of_the_clock_change_differ_in_rows_of_any_width(spark, extra):
    df = spark.range(2).select(F.timestamp_seconds(F.lit(1699162200) + F.col("id") * 3600).alias("t"))
    df = df.select("t", *[F.lit("some constant text").alias(f"c{i}") for i in range(extra)])
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert duplicate_rows(df).first().duplicate_rows == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_nested_values_keep_microseconds_and_ignore_map_order(spark):
    df = spark.sql(
        "SELECT struct(timestamp_ntz'2024-01-01 00:00:00.000001' AS t, map('a', 1, 'b', 2) AS m) AS s"
        " UNION ALL SELECT struct(timestamp_ntz'2024-01-01 00:00:00.000002', map('a', 1, 'b', 2))"
        " UNION ALL SELECT struct(timestamp_ntz'2024-01-01 00:00:00.000002', map('b', 2, 'a', 1))"
    )
    assert text_profile(df, 0).first().unique_count == 2
    assert duplicate_rows(df).first().duplicate_rows == 1


def test_csv_line_with_too_many_fields_is_an_error(spark, tmp_path):
    (tmp_path / "long.csv").write_text("id,v\n1,2\n2,4,5,6\n")
    (tmp_path / "short.csv").write_text("id,v\n1,2\n2\n")
    status = {r.dataset: r.status for r in profile_directory(spark, str(tmp_path)).status.collect()}
    assert status == {"long": "error", "short": "ok"}
    assert [tuple(r) for r in read_csv(spark, f"{tmp_path}/short.csv").orderBy("id").collect()] == [(1, 2), (2, None)]


def test_empty_directory(spark, tmp_path):
    assert profile_directory(spark, str(tmp_path)).status.count() == 0
    assert detect_directory(spark, str(tmp_path)).status.count() == 0


@pytest.mark.parametrize(
    "texts,day",
    [
        (["2024-01-01T00:00:00Z", "2024-01-02T01:00:00+02:00"], datetime(2024, 1, 1, 23)),
        (["1/2/2024", "13/1/2024"], datetime(2024, 1, 13)),
        (["1/2/2024", "1/13/2024"], datetime(2024, 1, 13)),
        (["05-01-2024", "05-31-2024"], datetime(2024, 5, 31)),
        (["2024-1-5", "2024-01-06"], datetime(2024, 1, 6)),
        (["Jan 5, 2024", "Feb 6, 2024"], datetime(2024, 2, 6)),
        (["5 March 2024", "6 April 2024"], datetime(2024, 4, 6)),
        (["2024-01-05 10:00:00.123456789", "2024-01-05 10:00:00.5"], datetime(2024, 1, 5, 10, 0, 0, 123456)),
    ],
)
def test_everyday_date_formats(spark, texts, day):
    df, name = with_date_column(spark.createDataFrame([(t,) for t in texts], "x string"))
    assert name == "x"
    assert day in [r.x for r in df.select("x").collect()]


def test_other_texts_are_no_dates(spark):
    df = spark.createDataFrame([("2024-13-01", "2024-01-01", "x" * 999)], "a string, b string, c string")
    df = df.union(spark.createDataFrame([("2024-01-01", "n/a", "2024-01-01")], df.schema))
    assert set(matching_formats(df, ["a", "b", "c"]).values()) == {None}


def test_items_without_products_in_some_categories(spark):
    products = spark.createDataFrame(
        [(i, f"P{i}", c, 10.0) for i, c in enumerate(["Electronics", "Books", "Books"])],
        "product_no long, product_id string, category string, base_price double",
    )
    orders = spark.range(200).select(F.format_string("O%d", "id").alias("order_id"), (F.col("id") % 3).alias("item_count"))
    orders = orders.filter("item_count > 0").union(spark.createDataFrame([("none", 1)], orders.schema))
    items = synth_items(orders, products)
    assert items.count() == orders.agg(F.sum("item_count")).first()[0]
    totals = synth_order_totals(orders, items.filter("order_id <> 'none'"))
    assert totals.count() == orders.count() and totals.filter("order_id = 'none'").first().total_amount == 0


def test_missing_column_belongs_to_the_current_dataset(spark):
    base = column_profile(spark.range(3).select("id", F.lit(1).alias("gone")), "base")
    changes = compare_schema(column_profile(spark.range(3).toDF("id"), "now"), base).collect()
    assert [(r.dataset, r.column) for r in changes] == [("now", "gone")]
