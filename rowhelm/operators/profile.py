"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowhelm.functions.scalars import (
    as_number,
    as_text,
    clean,
    percent,
    row_digest,
    whole_days_between,
)
from rowhelm.operators.frequency import distinct_stats, value_frequency
from rowhelm.operators.melt import rows_from_structs
from rowhelm.operators.quantiles import exact_quantiles
from rowhelm.operators.ranking import text_statistics
from rowhelm.types import fixed_width, is_datetime, is_numeric, numeric_columns, text_columns

NUMERIC_STATS = ["mean", "std", "min_value", "max_value"]
QUARTILES = {0.25: "percentile_25", 0.5: "percentile_50", 0.75: "percentile_75"}

# What to compute: quartiles and distinct values cost passes of their own.
ALL_STATISTICS = ("numeric", "quartiles", "text", "top_values", "datetime")
COMPARED_STATISTICS = ("numeric", "text")
RULE_STATISTICS = ("numeric",)


@dataclass(frozen=True)
class TableSummary:
    """A profiled dataset: one ``table`` row and one ``columns`` row per column."""

    table: DataFrame
    columns: DataFrame


def _filled_counts(df: DataFrame) -> list[Column]:
    return [F.count(clean(f)).alias(f"filled_{i}") for i, f in enumerate(df.schema)]


NULL_COUNTS = ["position", "dtype", "count", "null_count", "null_percent"]
DATE_STATS = ["min_date", "max_date", "date_range_days"]


def column_basics(df: DataFrame, nulls: bool = True, numeric: bool = True, datetime: bool = True) -> DataFrame:
    """All statistics that need no distinct values or ranks, from one scan of the table.

    One row per column: null counts, ``NUMERIC_STATS`` and ``DATE_STATS``, as asked for;
    what does not apply to the type of a column is NULL.
    """
    wanted = {
        f.name: (numeric and is_numeric(f.dataType), datetime and is_datetime(f.dataType)) for f in df.schema
    }
    aggregates = [F.count(F.lit(1)).alias("count")]
    structs = []
    for i, field in enumerate(df.schema):
        has_numbers, has_dates = wanted[field.name]
        parts = {"column": F.lit(field.name)}
        if nulls:
            aggregates.append(F.count(clean(field)).alias(f"filled_{i}"))
            missing = F.col("count") - F.col(f"filled_{i}")
            parts |= {
                "position": F.lit(i).cast("bigint"),
                "dtype": F.lit(field.dataType.simpleString()),
                "null_count": missing,
                "null_percent": F.round(percent(missing, F.col("count")), 2),
            }
        if has_numbers:
            value = as_number(field)
            functions = dict(zip(NUMERIC_STATS, (F.avg, F.stddev_samp, F.min, F.max)))
            aggregates += [function(value).alias(f"{stat}_{i}") for stat, function in functions.items()]
        if has_dates:
            moment = clean(field).cast("timestamp_ntz")
            aggregates += [F.min(moment).alias(f"first_{i}"), F.max(moment).alias(f"last_{i}")]
        if numeric:
            for stat in NUMERIC_STATS:
                number = F.round(F.col(f"{stat}_{i}"), 4) if has_numbers else F.lit(None)
                parts[stat] = number.cast("double")
        if datetime:
            first, last = (F.col(f"{edge}_{i}") if has_dates else F.lit(None) for edge in ("first", "last"))
            parts["min_date"], parts["max_date"] = first.cast("string"), last.cast("string")
            parts["date_range_days"] = whole_days_between(first, last) if has_dates else F.lit(None).cast("bigint")
        structs.append(F.struct(*[value.alias(name) for name, value in parts.items()]))
    return rows_from_structs(df.agg(*aggregates), ["count"], structs)


def column_nulls(df: DataFrame) -> DataFrame:
    """``(column, position, dtype, count, null_count, null_percent)``."""
    return column_basics(df, numeric=False, datetime=False).select("column", *NULL_COUNTS)


def numeric_stats(df: DataFrame) -> DataFrame:
    """``(column, mean, std, min_value, max_value)``; no row for all-null columns."""
    basics = column_basics(df, nulls=False, datetime=False)
    return basics.select("column", *NUMERIC_STATS).filter(F.col("mean").isNotNull())


def numeric_quartiles(df: DataFrame) -> DataFrame:
    """``(column, percentile_25, percentile_50, percentile_75)``, exact."""
    quantiles = exact_quantiles(df, numeric_columns(df), list(QUARTILES))
    return quantiles.groupBy("column").agg(
        *[
            F.round(F.max(F.when(F.col("probability") == p, F.col("value"))), 4).alias(name)
            for p, name in QUARTILES.items()
        ]
    )


def numeric_profile(df: DataFrame) -> DataFrame:
    return numeric_stats(df).join(numeric_quartiles(df), "column")


def text_profile(df: DataFrame, k: int = 5) -> DataFrame:
    """``(column, unique_count, unique_percent, avg_length, top_values)``; k = 0 leaves the last out.

    Ties among top values are in the order of the values.
    """
    names = text_columns(df)
    if k == 0:
        return distinct_stats(value_frequency(df, names), names)
    return text_statistics(df, names, k)


def datetime_profile(df: DataFrame) -> DataFrame:
    """``(column, min_date, max_date, date_range_days)``; no row for all-null columns."""
    basics = column_basics(df, nulls=False, numeric=False)
    return basics.select("column", *DATE_STATS).filter(F.col("min_date").isNotNull())


# The statistics of a column profile that depend on its type.
TYPED_STATISTICS = {
    **dict.fromkeys(NUMERIC_STATS + list(QUARTILES.values()), "double"),
    "unique_count": "bigint",
    "unique_percent": "double",
    "top_values": "array<struct<value: string, count: bigint>>",
    "avg_length": "double",
    "min_date": "string",
    "max_date": "string",
    "date_range_days": "bigint",
}


def column_profile(df: DataFrame, name: str = "dataset", statistics: Sequence[str] = ALL_STATISTICS) -> DataFrame:
    """The statistics of all columns; one that does not apply or is not asked for is NULL.

    The joined frames have one row per column of the table.
    """
    parts = []
    if numeric_columns(df) and "quartiles" in statistics:
        parts.append(numeric_quartiles(df))
    if text_columns(df) and "text" in statistics:
        parts.append(text_profile(df, 5 if "top_values" in statistics else 0))
    columns = column_basics(df, numeric="numeric" in statistics, datetime="datetime" in statistics)
    for part in parts:
        columns = columns.join(part, "column", "left")
    absent = {c: F.lit(None).cast(t) for c, t in TYPED_STATISTICS.items() if c not in columns.columns}
    return columns.withColumns(absent).select(
        F.lit(name).alias("dataset"),
        "position", "column", "dtype", "count", "null_count", "null_percent", *TYPED_STATISTICS,
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(row_count, duplicate_rows)``: rows that repeat an earlier row.

    Rows of any width are grouped by a 32-byte SHA-256 of all values. They are counted
    before the shuffle, so one row repeated many times does not load one task.
    """
    rows = df.select(row_digest(df.schema.fields).alias("digest"))
    return (
        rows.groupBy(*rows.columns)
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def _logical_bytes(df: DataFrame) -> Column:
    fixed = sum(fixed_width(f.dataType) or 0 for f in df.schema)
    total = F.count(F.lit(1)) * fixed
    for field in df.schema:
        if fixed_width(field.dataType) is None:
            text = clean(field) if isinstance(field.dataType, T.BinaryType) else as_text(field)
            total = total + F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0))
    return total


def estimated_bytes(df: DataFrame) -> DataFrame:
    """Logical size: type widths plus the UTF-8 length of the variable-width values."""
    return df.agg(_logical_bytes(df).alias("est_bytes"))


def table_profile(df: DataFrame, name: str = "dataset") -> DataFrame:
    """One row of table metrics: counts and sizes from one scan, duplicates from another."""
    width = len(df.columns)
    missing = sum((F.col("row_count") - F.col(f"filled_{i}") for i in range(width)), F.lit(0))
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"), _logical_bytes(df).alias("est_bytes"), *_filled_counts(df)
    ).select("row_count", "est_bytes", missing.cast("bigint").alias("total_null_cells"))
    repeats = duplicate_rows(df).select("duplicate_rows")
    # Two frames of one row each, put side by side.
    return (
        counts.unionByName(repeats, allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in ("row_count", "est_bytes", "total_null_cells", "duplicate_rows")])
        .select(
            F.lit(name).alias("dataset"),
            "row_count",
            F.lit(width).cast("bigint").alias("column_count"),
            "est_bytes",
            "total_null_cells",
            percent(F.col("total_null_cells"), F.col("row_count") * width).alias("null_cell_percent"),
            "duplicate_rows",
            F.current_timestamp().alias("profiled_at"),
        )
    )


def profile(df: DataFrame, name: str = "dataset", statistics: Sequence[str] = ALL_STATISTICS) -> TableSummary:
    return TableSummary(table_profile(df, name), column_profile(df, name, statistics))
