"""Readable report rows. Texts are ours; numbers are those of the profiled frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.operators.detect import column_label


def profile_report(columns: DataFrame) -> DataFrame:
    """``(dataset, position, column, dtype, nulls, stats)``, one line per column."""
    nulls = F.format_string("%,d (%.1f%%)", "null_count", "null_percent")
    stats = (
        F.when(
            F.col("mean").isNotNull(),
            F.concat(
                F.format_string("mean %.2f", "mean"),
                F.when(F.col("std").isNull(), "").otherwise(F.format_string(", std %.2f", "std")),
                F.format_string(", %.2f to %.2f", "min_value", "max_value"),
            ),
        )
        .when(
            F.col("unique_count").isNotNull(),
            F.format_string("%,d distinct (%.1f%%)", "unique_count", "unique_percent"),
        )
        .when(
            F.col("min_date").isNotNull(),
            F.concat(F.substring("min_date", 1, 10), F.lit(" to "), F.substring("max_date", 1, 10)),
        )
        .otherwise("-")
    )
    return columns.select(
        "dataset", "position", "column", "dtype", nulls.alias("nulls"), stats.alias("stats")
    )


def compare_report(changes: DataFrame) -> DataFrame:
    """One line per change, with ``-`` where a change has no such value."""

    def shown(value: Column, pattern: str = "%.4f") -> Column:
        return F.when(value.isNull(), "-").otherwise(F.format_string(pattern, value))

    return changes.select(
        "dataset",
        "position",
        "rule",
        "type",
        F.coalesce("column", F.lit("-")).alias("column"),
        shown(F.col("baseline")).alias("baseline"),
        shown(F.col("current")).alias("current"),
        shown(F.coalesce("change_percent", "change"), "%.2f%%").alias("change"),
        F.upper(F.coalesce("severity", F.lit("low"))).alias("severity"),
    )


def anomaly_report(anomalies: DataFrame) -> DataFrame:
    """``(dataset, day, line_no, headline, detail)``, numbered within each day.

    A day has at most a few findings per column, so numbering it is a small window.
    """
    order = Window.partitionBy("dataset", "day").orderBy("detector_ord", "column", "category")
    label = column_label(F.col("column"), F.col("category"))
    headline = F.concat(
        F.lit("["), F.upper("severity"), F.lit("] "), F.col("type"),
        F.when(label.isNull(), "").otherwise(F.concat(F.lit(" ["), label, F.lit("]"))),
    )
    detail = F.concat(
        F.col("message"),
        F.when(F.col("z_score") == 0, "").otherwise(F.format_string(" (z %.2f)", "z_score")),
    )
    return anomalies.select(
        "dataset",
        "day",
        F.row_number().over(order).cast("bigint").alias("line_no"),
        headline.alias("headline"),
        detail.alias("detail"),
    )


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    """``(scope, name, anomalies)``: in total, by dataset and by type, from one pass."""
    sets = anomalies.groupingSets([[], ["dataset"], ["type"]], "dataset", "type").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("anomalies")
    )
    return sets.select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "dataset").otherwise("type").alias("scope"),
        F.when(F.col("gid") == 3, "all").otherwise(F.coalesce("dataset", "type")).alias("name"),
        "anomalies",
    )


def quick_stats(fact: DataFrame, date_column: str, nullable: str, amount: str) -> DataFrame:
    """Headline numbers of a fact table; the daily average uses the days really spanned."""
    day = F.to_date(F.col(date_column))
    return fact.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.count_if(F.col(nullable).isNull()).alias("null_count"),
        F.count_if(F.col(amount) < 0).alias("negative_count"),
    ).withColumn(
        "rows_per_day",
        F.when(
            F.col("row_count") > 0, F.col("row_count") / (F.datediff("last_day", "first_day") + 1)
        ),
    )
