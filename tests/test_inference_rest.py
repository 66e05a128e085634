"""Types of columns whose first rows rule out most of them: all rows count, by less work."""

import pytest
from pyspark.sql import functions as F

from rowhelm.sources import csv, dates

ODD = [
    "01/02/2020 10:30", "12/31/1999 23:59", "13/01/2020 10:30", "02/29/2020 00:00", "02/29/2021 00:00", "1/2/2020 1:30", "01/02/2020 24:00",
    "01/02/2020 10:60", "01/02/2020 10:30\n", "01/02/0000 10:30", "01/02/2020", "31/01/2020", "01/02/2020 10:30:61", "01/02/2020 10:30:59", "x", "", None,
]


def test_is_of_equals_parse(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").repartition(2)
    for name in dates.DATE_FORMATS:
        both = df.select(dates.is_of(F.col("t"), name).alias("a"), F.coalesce(dates._parsed(F.col("t"), name).isNotNull(), F.lit(False)).alias("b"))
        assert both.filter("a != b").count() == 0, name


def test_masks_of_some_bits_are_those_of_all(spark):
    texts = [*ODD, "5", "-5", "+5", "007", "9223372036854775808", "1.5", "5.", ".5", "1e5", "inf", "-Infinity", "True", "FALSE", "20200102", "2020-01-02", " 5", "5\n", "5 ", "1.5 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for bits in (1, 2, 3, 4, 7, 1 << 3, 1 << 13 | 3, (1 << 36) - 1):
        both = df.select("t", csv._mask_of(F.col("t"), bits).alias("a"), csv._type_and_date_mask(F.col("t")).bitwiseAND(F.lit(bits).cast("bigint")).alias("b"))
        assert both.filter("not (a <=> b)").collect() == [], bits


@pytest.mark.parametrize("last, kind", [("5", ("bigint", None)), ("5.5", ("double", None)), ("x", ("string", None)), (None, ("bigint", None))])
def test_last_row_counts(spark, last, kind):
    df = spark.range(3000, numPartitions=1).select(F.when(F.col("id") == 2999, F.lit(last)).otherwise(F.col("id").cast("string")).alias("a b"))
    assert csv.infer_tables({"t": df}) == {"t": {"a b": kind}}


def test_nulls_at_first_rule_out_nothing(spark):
    df = spark.range(3000, numPartitions=1).select(F.when(F.col("id") > 2000, "01/31/2020 10:30").alias("d"), F.lit(None).cast("string").alias("n"), F.when(F.col("id") > 2000, "true").alias("b"))
    assert csv.infer_tables({"t": df}) == {"t": {"d": ("string", "M/d/yyyy H:mm"), "n": ("double", None), "b": ("string", None)}}


def test_what_the_first_rows_rule_out_is_not_looked_for(spark):
    expression = lambda bits: csv._mask_of(F.col("t"), bits)._jc.toString()
    assert "RLIKE" not in expression(0).upper() and len(expression(3)) < len(csv._type_and_date_mask(F.col("t"))._jc.toString()) / 10
