"""Date formats, types of text columns in one pass, and failures that stay with their dataset."""

import datetime
import re

from pyspark.sql import functions as F

from rowhelm.plans import runs
from rowhelm.sources.csv import infer_tables
from rowhelm.sources.dates import DATE_FORMATS, find_date_columns, format_mask, parse_column

MOMENTS = {
    "20240105": (2024, 1, 5),
    "2024-01-01T00:00Z": (2024, 1, 1),
    "2024-01-01 10:00:00 UTC": (2024, 1, 1, 10),
    "2024-01-01 10:00:00+0200": (2024, 1, 1, 8),
    "2024-01-01T10:00:00.5-05:30": (2024, 1, 1, 15, 30, 0, 500_000),
    "01/02/2024 10:30": (2024, 1, 2, 10, 30),
    "13/02/2024 10:30": (2024, 2, 13, 10, 30),
    "01/02/2024 1:30 PM": (2024, 1, 2, 13, 30),
    "01/02/2024 12:05 AM": (2024, 1, 2, 0, 5),
    "Mon, 05 Jan 2024 10:00:00": (2024, 1, 5, 10),
    "Mon, 05 Jan 2024 10:00:00 +0100": (2024, 1, 5, 9),
    "Fri, 05 Jan 2024 10:00:00 GMT": (2024, 1, 5, 10),
    "1/2/24": (2024, 1, 2),
    "13/2/70": (1970, 2, 13),
    "2024.01.05": (2024, 1, 5),
    "5-Jan-2024": (2024, 1, 5),
    "2024/03/10 02:30": (2024, 3, 10, 2, 30),
    "2024-03-10 02:30:00": (2024, 3, 10, 2, 30),
}
NO_DATES = ["1", "2024", "12345678", "2024-13-01", "25/25/2024", "01/02/2024 25:00", "01/02/2024 13:00 PM", "yesterday", "x" * 100, ""]


def test_everyday_formats_in_one_pass(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    values = [*MOMENTS, *NO_DATES]
    rows = [(str(i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i string, v string")
    tables = {v: df.filter(F.col("i") == i).select(F.lit("k").alias("other"), "v") for i, v in rows}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # results don't depend on it
        found = find_date_columns(tables)
        parsed = [parse_column(tables[v], "v", found[v][1]).select(F.lit(v).alias("text"), "v") for v in MOMENTS if found[v][0]]
        union = parsed[0]
        for one in parsed[1:]:
            union = union.union(one)
        got = {r["text"]: r["v"] for r in union.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {v: datetime.datetime(*t) for v, t in MOMENTS.items()}
    assert {v: found[v] for v in NO_DATES} == dict.fromkeys(NO_DATES, (None, None))


def test_one_value_of_another_format_decides(spark):
    df = spark.createDataFrame([("01/02/2024", "01/02/2024"), ("13/02/2024", "2024-02-13"), (None, None)], "a string, b string")
    assert find_date_columns({"t": df})["t"] == ("a", "d/M/yyyy")
    assert find_date_columns({"t": df.select("b"), "none": df.limit(0)}) == {"t": (None, None), "none": (None, None)}


def test_types_of_texts(spark):
    rows = [("1", "1", "true", "2024-01-05", "1", None, "9" * 30), ("-2", "2.5e3", "False", "2024-01-06", "x", None, "1")]
    names = ["whole", "real", "flag", "day", "text", "empty", "huge"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    wanted = {"whole": ("bigint", None), "real": ("double", None), "flag": ("boolean", None), "day": ("string", "iso day"), "text": ("string", None), "empty": ("double", None), "huge": ("double", None)}
    assert infer_tables({"a": df})["a"] == wanted
    both = infer_tables({"a": df, "b": df.unionByName(df.limit(1).withColumn("flag", F.lit(None).cast("string")))})
    assert both["a"] == wanted and both["b"]["flag"] == ("string", None)


def test_impossible_dates_and_plain_numbers_fail_by_patterns(spark):
    # A failing parse or cast costs far more than a pattern; what the masks say does not change.
    texts = ["01/25/2024", "25/01/2024", "01/02/2024", "25/25/2024", "1/2/24", "13/2/24", "0/1/2024"]
    wanted = [("M/d/yyyy",), ("d/M/yyyy",), ("M/d/yyyy", "d/M/yyyy"), (), ("M/d/yy", "d/M/yy"), ("d/M/yy",), ()]
    assert re.match(DATE_FORMATS["d/M/yyyy"], "01/25/2024") is None and re.match(DATE_FORMATS["M/d/yyyy"], "25/01/2024") is None
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", format_mask(F.col("v")).alias("mask"))
    got = [tuple(name for j, name in enumerate(DATE_FORMATS) if r["mask"] >> j & 1) for r in df.orderBy("i").collect()]
    assert got == wanted


def days(spark, n, fails_at=None):
    df = spark.range(n * 4).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % n).cast("int")).alias("day"), F.col("id").cast("double").alias("x"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind")
    )
    if fails_at is not None:
        broken = F.when(F.col("x") == fails_at, F.raise_error(F.lit("value out of place")).cast("double")).otherwise(F.col("x"))
        df = df.withColumn("x", broken)
    return df


def test_a_failure_while_running_stays_with_its_dataset(spark):
    def missing():
        raise ValueError("no such file")

    loaders = {"good": lambda: days(spark, 8), "bad": lambda: days(spark, 8, fails_at=5), "gone": missing, "short": lambda: days(spark, 2)}
    result = runs.profile_datasets(spark, loaders)
    status = {r["dataset"]: (r["status"], r["error"]) for r in result.status.collect()}
    assert status["good"] == status["short"] == ("ok", None) and status["gone"] == ("error", "no such file")
    assert status["bad"][0] == "error" and "value out of place" in status["bad"][1]
    assert {p.table.first()["dataset"]: p.columns.count() for p in result.profiles} == {"good": 3, "short": 3}
    assert result.issues.count() == 0
    found = runs.detect_datasets(spark, loaders)
    status = {r["dataset"]: (r["status"], r["days"]) for r in found.status.collect()}
    assert status == {"good": ("ok", 8), "bad": ("error", 8), "gone": ("error", None), "short": ("short_history", 2)}
    assert found.anomalies.filter("dataset = 'bad'").count() == 0


def test_a_failing_date_column_does_not_stop_the_search_for_others(spark):
    text = days(spark, 8).select(F.date_format("day", "MM/dd/yyyy").alias("day"), "x")
    bad = text.withColumn("day", F.when(F.col("x") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("day")))
    status, usable = runs.dataset_status(spark, {"a": lambda: text, "b": lambda: bad})
    assert {r["dataset"]: r["status"] for r in status.collect()} == {"a": "ok", "b": "error"} and set(usable) == {"a"}


def test_results_come_in_the_order_of_the_tasks(spark):
    done = runs.side_by_side(spark, {str(n): (lambda n=n: spark.range(n).count()) for n in range(5)})
    assert list(done.items()) == [(str(n), (n, None)) for n in range(5)]
    assert runs.side_by_side(spark, {}) == {}


def test_findings_are_made_while_the_dataset_is_tried(spark):
    found = runs.detect_datasets(spark, {"good": lambda: days(spark, 8)})
    assert found.anomalies.columns[0] == "dataset" and found.anomalies.count() >= 0
