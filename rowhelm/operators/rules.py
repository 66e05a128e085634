"""Quality issues read off a profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowhelm.operators.profile import TableSummary

# The limits beyond which a profile shows an issue (percent).
TABLE_NULL_LIMIT = 5.0
COLUMN_NULL_LIMIT = 20.0


def table_issues(table: DataFrame) -> DataFrame:
    nulls, repeats = F.col("null_cell_percent"), F.col("duplicate_rows")
    issues = F.array_compact(
        F.array(
            F.when(
                nulls > TABLE_NULL_LIMIT,
                F.struct(F.lit("high_null_rate").alias("issue"), nulls.cast("double").alias("value")),
            ),
            F.when(
                repeats > 0,
                F.struct(F.lit("duplicate_rows").alias("issue"), repeats.cast("double").alias("value")),
            ),
        )
    )
    return table.select("dataset", F.lit(None).cast("string").alias("column"), F.inline(issues))


def column_issues(columns: DataFrame) -> DataFrame:
    nulls, smallest = F.col("null_percent"), F.col("min_value")
    issues = F.array_compact(
        F.array(
            F.when(
                nulls > COLUMN_NULL_LIMIT,
                F.struct(F.lit("column_null_rate").alias("issue"), nulls.cast("double").alias("value")),
            ),
            F.when(
                smallest < 0,
                F.struct(F.lit("negative_values").alias("issue"), smallest.cast("double").alias("value")),
            ),
        )
    )
    return columns.select("dataset", "column", F.inline(issues))


def quality_issues(profiles: list[TableSummary]) -> DataFrame:
    """``(dataset, column, issue, value)`` over all profiled datasets."""
    parts = [part for p in profiles for part in (table_issues(p.table), column_issues(p.columns))]
    return reduce(DataFrame.unionByName, parts)
