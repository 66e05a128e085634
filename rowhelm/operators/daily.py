"""Per-day summaries of a table: volume, null rates, numeric statistics, category shares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.functions.scalars import DIGEST_PREFIX, INLINE_KEY_BYTES, as_number, as_text, clean, day_of, percent, quoted, value_key
from rowhelm.operators.frequency import spelled_out, value_frequency
from rowhelm.operators.melt import column_name, melt, rows_from_structs
from rowhelm.types import categorical_columns, numeric_columns

DAY = "_day"


@dataclass(frozen=True)
class DailyProfile:
    """Daily tables of one or more datasets; everything the detectors read.

    ``volume``     dataset, day, day_idx, row_count
    ``columns``    dataset, day, day_idx, column, row_count, null_count, null_rate, mean,
                   min, max, std -- and one row per day with a NULL column for the table
    ``categories`` dataset, day, day_idx, n_days, column, key, cnt, share -- observed
                   values only; ``n_days`` is the number of days of the dataset
    ``texts``      dataset, column, key, text -- of the categories whose key is a digest; a frame that
                   was not stored may repeat rows
    """

    volume: DataFrame
    columns: DataFrame
    categories: DataFrame | None = None
    texts: DataFrame | None = None

    def union(self, other: "DailyProfile") -> "DailyProfile":
        def both(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
            return a.unionByName(b) if a is not None and b is not None else a if b is None else b

        return DailyProfile(
            self.volume.unionByName(other.volume),
            self.columns.unionByName(other.columns),
            both(self.categories, other.categories),
            both(self.texts, other.texts),
        )


def with_day(df: DataFrame, date_column: str) -> DataFrame:
    """Add the calendar day; rows without one belong to no day and are left out."""
    return df.withColumn(DAY, day_of(F.col(quoted(date_column)))).filter(F.col(DAY).isNotNull())


def _numbered(days: DataFrame, name: str) -> DataFrame:
    """Add the dataset name and the rank among observed days (one row per day here)."""
    order = Window.partitionBy("dataset").orderBy("day")
    return days.withColumn("dataset", F.lit(name)).withColumn(
        "day_idx", (F.row_number().over(order) - 1).cast("bigint")
    )


def daily_volume(df: DataFrame, date_column: str, name: str = "dataset") -> DataFrame:
    """``(dataset, day, day_idx, row_count)``; reads only the date column."""
    days = with_day(df, date_column).groupBy(F.col(DAY).alias("day")).agg(F.count(F.lit(1)).alias("row_count"))
    return _numbered(days, name).select("dataset", "day", "day_idx", "row_count")


def daily_columns(
    df: DataFrame,
    date_column: str,
    numeric: Sequence[str] | None = None,
    name: str = "dataset",
    with_table_row: bool = False,
) -> DataFrame:
    """One row per day and column, from a single scan and one shuffle of per-day totals.

    Numeric statistics are NULL on days on which the column has no value. With
    ``with_table_row`` every day has one more row for the table itself (NULL column).
    """
    numeric = [c for c in (numeric_columns(df) if numeric is None else numeric) if c in df.columns]
    tracked = [c for c in df.columns if c != date_column]
    aggregates = [F.count(F.lit(1)).alias("row_count")]
    for i, column in enumerate(tracked):
        aggregates.append(F.count(clean(df.schema[column])).alias(f"filled_{i}"))
        if column in numeric:
            value = as_number(df.schema[column])
            aggregates += [
                F.avg(value).alias(f"mean_{i}"),
                F.min(value).alias(f"min_{i}"),
                F.max(value).alias(f"max_{i}"),
                F.stddev_samp(value).alias(f"std_{i}"),
            ]
    days = with_day(df, date_column).groupBy(F.col(DAY).alias("day")).agg(*aggregates)
    structs = []
    for i, column in enumerate(tracked):
        missing = F.col("row_count") - F.col(f"filled_{i}")
        stats = {s: F.col(f"{s}_{i}") if column in numeric else F.lit(None) for s in ("mean", "min", "max", "std")}
        structs.append(
            F.struct(
                F.lit(column).alias("column"),
                missing.alias("null_count"),
                percent(missing, F.col("row_count")).alias("null_rate"),
                *[v.cast("double").alias(s) for s, v in stats.items()],
            )
        )
    if with_table_row:
        blank = {"column": "string", "null_count": "bigint", "null_rate": "double"}
        blank |= dict.fromkeys(("mean", "min", "max", "std"), "double")
        structs.append(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in blank.items()]))
    keep = ["dataset", "day", "day_idx", "row_count"]
    return rows_from_structs(_numbered(days, name), keep, structs)


def daily_category_share(
    df: DataFrame,
    date_column: str,
    columns: Sequence[str] | None = None,
    name: str = "dataset",
    volume: DataFrame | None = None,
) -> DataFrame:
    """``(dataset, day, day_idx, n_days, column, key, cnt, share)`` of the observed values.

    ``share`` is relative to the non-null rows of the day. That total is summed up from
    the value counts, not taken by a window, so the values of one busy day never have to
    meet in one task. ``key`` stands for the value (see ``value_key``).
    """
    if columns is None:
        columns = categorical_columns(df, date_column)
    if volume is None:
        volume = daily_volume(df, date_column, name)
    counts = value_frequency(with_day(df, date_column), columns, by=[DAY]).select(
        F.col(DAY).alias("day"), "col_no", "key", "cnt"
    )
    totals = counts.groupBy("day", "col_no").agg(F.sum("cnt").alias("filled"))
    days = volume.withColumn("n_days", F.count(F.lit(1)).over(Window.partitionBy("dataset")))
    totals = totals.join(days.select("dataset", "day", "day_idx", "n_days"), "day")
    return counts.join(totals, ["day", "col_no"]).select(
        "dataset",
        "day",
        "day_idx",
        "n_days",
        column_name(columns).alias("column"),
        "key",
        "cnt",
        (F.col("cnt") / F.col("filled")).alias("share"),
    )


def with_category_text(df: DataFrame, frame: DataFrame) -> DataFrame:
    """Add ``category``, the value of ``df`` behind each ``column`` and ``key`` of a small frame."""
    names = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    numbers = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)])
    return spelled_out(df, names, frame.withColumn("col_no", numbers[F.col("column")])).withColumnRenamed(
        "value", "category"
    ).drop("col_no")


def category_texts(df: DataFrame, date_column: str, columns: Sequence[str] | None = None, name: str = "dataset") -> DataFrame:
    """``(dataset, column, key, text)``: the dictionary of the values that are grouped by digest.

    A row for each such value and its repeats; ``save_daily`` keeps one of each, and findings look up theirs only.
    """
    if columns is None:
        columns = categorical_columns(df, date_column)
    return (
        melt(with_day(df, date_column), columns, as_text)
        .filter(F.octet_length("value") > INLINE_KEY_BYTES)
        .select(F.lit(name).alias("dataset"), column_name(columns).alias("column"), value_key(F.col("value")).alias("key"), F.col("value").alias("text"))
    )


def with_known_text(texts: DataFrame, frame: DataFrame) -> DataFrame:
    """Add ``category`` to a small frame with ``dataset``, ``column`` and ``key``: the text, or the key that is the value.

    The dictionary is read only if a digest is among the keys.
    """
    names = ["dataset", "column", "key"]
    digests = frame.filter(F.col("key").startswith(DIGEST_PREFIX)).select(*names).distinct()
    known = texts.join(digests, names, "left_semi").select(*names, "text").distinct()
    return frame.join(known, names, "left").withColumn("category", F.coalesce("text", "key")).drop("text")


def daily_profile(
    df: DataFrame,
    date_column: str,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    name: str = "dataset",
) -> DailyProfile:
    if categorical is None:
        categorical = categorical_columns(df, date_column)
    categorical = [c for c in categorical if c in df.columns]
    volume = daily_volume(df, date_column, name)
    return DailyProfile(
        volume,
        daily_columns(df, date_column, numeric, name, with_table_row=True),
        daily_category_share(df, date_column, categorical, name, volume) if categorical else None,
        category_texts(df, date_column, categorical, name) if categorical else None,
    )


def day_records(daily: DailyProfile) -> DataFrame:
    """Nested view, one record per day: the row count and six maps keyed by column.

    A map has at most one entry per column. Shares stay in their own table, since a day
    can have as many categories as rows.
    """

    def as_map(value: str) -> Column:
        entries = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("column", value)))
        return F.map_from_entries(F.array_sort(entries))

    per_column = (
        daily.columns.filter(F.col("column").isNotNull())
        .groupBy("dataset", "day", "day_idx", "row_count")
        .agg(
            as_map("null_count").alias("null_counts"),
            as_map("null_rate").alias("null_rates"),
            *[as_map(s).alias(f"{s}s") for s in ("mean", "min", "max", "std")],
        )
    )
    return per_column.orderBy("dataset", "day")
