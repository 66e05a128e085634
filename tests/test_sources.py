"""CSV and Parquet sources, date detection, whole-directory runs and synthetic data."""

import datetime

import pytest
from pyspark.sql import functions as F

from rowhelm.operators import inject, synth
from rowhelm.operators.detect import in_report_order
from rowhelm.plans import reports
from rowhelm.plans.runs import detect_directory, profile_directory
from rowhelm.sources.csv import find_csv_datasets, read_csv, write_csv
from rowhelm.sources.dates import find_date_column, parse_dates_by_name, with_date_column


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_missing_values(spark, tmp_path):
    path = write(
        tmp_path / "t.csv",
        'id,price,flag,note,empty,mixed\n1,1.5,True,"a, ""b""",,1\n2,NA,False,null,,x\n3,2e3,True,"N/A",,NaN\n',
    )
    df = read_csv(spark, path)
    assert df.dtypes == [("id", "bigint"), ("price", "double"), ("flag", "boolean"), ("note", "string"), ("empty", "double"), ("mixed", "string")]
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [(1, 1.5, True, 'a, "b"', None, "1"), (2, None, False, None, None, "x"), (3, 2000.0, True, None, None, None)]


def test_csv_newline_in_quotes(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'id,note\n1,"two\nlines"\n2,one\n')
    assert [tuple(r) for r in read_csv(spark, path).orderBy("id").collect()] == [(1, "two\nlines"), (2, "one")]


def test_csv_round_trip_and_discovery(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, s string")
    write_csv(df, str(tmp_path / "b.csv"))
    write(tmp_path / "a.csv", "x\n1\n")
    write(tmp_path / "notes.txt", "no")
    assert list(find_csv_datasets(spark, str(tmp_path))) == ["a", "b"]
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "b.csv")).collect())) == [(1, "a"), (2, None)]


def test_dates_by_name_are_all_or_nothing(spark):
    rows = [("2024-01-01", "2024-01-01", "2024-01-01", 5), ("2024-02-30", "2024-01-02 10:00", "2024-01-02", 6), (None, None, None, 7)]
    df = spark.createDataFrame(rows, "bad_date string, mixed_time string, created string, lifetime_value int")
    types = dict(parse_dates_by_name(df).dtypes)
    assert types == {"bad_date": "string", "mixed_time": "string", "created": "timestamp_ntz", "lifetime_value": "int"}


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2024-03-05", datetime.datetime(2024, 3, 5)),
        ("2024-03-05T07:08", datetime.datetime(2024, 3, 5, 7, 8)),
        ("2024-03-05 07:08:09", datetime.datetime(2024, 3, 5, 7, 8, 9)),
        ("2024-03-05T07:08:09.25", datetime.datetime(2024, 3, 5, 7, 8, 9, 250000)),
        ("2024/03/05", datetime.datetime(2024, 3, 5)),
        ("03/05/2024", datetime.datetime(2024, 3, 5)),
        ("1", None),
        ("2024", None),
        ("yesterday", None),
    ],
)
def test_date_formats(spark, value, expected):
    df = spark.createDataFrame([("k", value)], "other string, made string")
    parsed, name = with_date_column(df)
    assert (parsed.first()["made"] if name else None) == expected


def test_typed_date_column_wins(spark):
    df = spark.createDataFrame([("2024-01-01", datetime.date(2024, 1, 1))], "text string, day date")
    assert find_date_column(df) == ("day", None)
    assert find_date_column(df.drop("day"))[0] == "text"
    assert find_date_column(spark.createDataFrame([(1,)], "a int")) == (None, None)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """The synthetic shop as CSV, with three planted faults, next to unusable files."""
    root = tmp_path_factory.mktemp("shop")
    start = datetime.date(2024, 1, 1)
    days = spark.createDataFrame([(start + datetime.timedelta(days=i), i) for i in range(30)], "day date, day_idx bigint")
    products = synth.synth_products(spark.range(100))
    orders = synth.synth_orders(synth.synth_daily_volume(days, 400))
    items = synth.synth_items(orders, products)
    orders = synth.synth_order_totals(orders, items)
    orders = inject.inject_volume_drop(orders, "order_date", start + datetime.timedelta(days=10), "order_id")
    orders = inject.inject_negative(orders, "order_date", start + datetime.timedelta(days=15), "order_id", "total_amount")
    background = (F.dayofmonth("order_date") % 3) / F.lit(100.0)
    orders = inject.inject_nulls(orders, "order_date", start + datetime.timedelta(days=20), "order_id", "customer_id", background=background)
    for name, df in {"orders": orders, "order_items": items, "products": products}.items():
        write_csv(df, str(root / f"{name}.csv"))
    write(root / "short.csv", "day,x\n2024-01-01,1\n2024-01-02,2\n")
    (root / "broken.csv").write_bytes(b"")
    return str(root)


def test_synthetic_tables_are_consistent(spark):
    products = synth.synth_products(spark.range(5000))
    ranked = synth.ranked_products(products).groupBy("category").agg(
        F.countDistinct("rank").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.max("category_size").alias("size")
    )
    assert all(r["n"] == r["size"] == r["high"] + 1 and r["low"] == 0 for r in ranked.collect())
    days = spark.createDataFrame([(datetime.date(2024, 1, 1), 0), (datetime.date(2024, 1, 2), 1)], "day date, day_idx bigint")
    volume = synth.synth_daily_volume(days, 30_000)
    orders = synth.synth_orders(volume)
    wanted = {r["day"]: r["order_count"] for r in volume.collect()}
    assert {r[0]: r[1] for r in orders.groupBy(F.to_date("order_date")).count().collect()} == wanted
    assert orders.select("order_id").distinct().count() == sum(wanted.values())
    items = synth.synth_items(orders, products)
    assert items.count() == orders.agg(F.sum("item_count")).first()[0]
    shares = {r["status"]: r["count"] / sum(wanted.values()) for r in orders.groupBy("status").count().collect()}
    assert abs(shares["completed"] - 0.75) < 0.02


def test_detect_directory(spark, shop):
    result = detect_directory(spark, shop)
    status = {r["dataset"]: r["status"] for r in result.status.collect()}
    assert status["orders"] == "ok" and status["short"] == "short_history"
    assert status["products"] == status["order_items"] == "no_date"
    assert status["broken"] == "error"
    found = in_report_order(result.anomalies)
    hits = {(r["day"].day - 1, r["type"]) for r in found.collect()}
    assert {(10, "volume_drop"), (15, "negative_values"), (20, "null_rate_increase")} <= hits
    counts = {(r["scope"], r["name"]): r["anomalies"] for r in reports.anomaly_counts(result.anomalies).collect()}
    assert counts["total", "all"] == counts["dataset", "orders"] == found.count()
    lines = reports.anomaly_report(result.anomalies).orderBy("day", "line_no").collect()
    assert lines and all(r["headline"].startswith("[") for r in lines)


def test_profile_directory(spark, shop):
    result = profile_directory(spark, shop)
    status = {r["dataset"]: r["status"] for r in result.status.collect()}
    assert status.pop("broken") == "error" and set(status.values()) == {"ok"}
    names = {p.table.first()["dataset"] for p in result.profiles}
    assert {"orders", "order_items", "products", "short"} <= names
    issues = {(r["dataset"], r["column"], r["issue"]) for r in result.issues.collect()}
    assert ("orders", "total_amount", "negative_values") in issues
