"""Daily category shares of a fact table enriched by lookups, counted before and after the joins.

The enriched rows are never grouped as such. Once a lookup is joined its key is no longer needed, so
rows that now agree in day, categories and the keys still to come are counted into one before the
next join (eager aggregation). A key of a later lookup that holds a third of all rows is then a
bounded number of counted rows there: days x categories so far.

Calendar and totals come out of the same counts as the shares, so the joins run once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowhelm.functions.scalars import as_text, day_of, quoted, value_key
from rowhelm.operators.melt import column_name
from rowhelm.types import categorical_columns

_DAY, _ROWS = "_day", "_rows"
_CALENDAR = -1


@dataclass(frozen=True)
class Lookup:
    """A table joined by ``fact_key = key``; rows without a partner are left out."""

    table: DataFrame
    fact_key: str
    key: str


def _with_day(df: DataFrame, date_column: str) -> DataFrame:
    if date_column not in df.columns:
        return df
    return df.withColumn(_DAY, day_of(F.col(quoted(date_column)))).filter(F.col(_DAY).isNotNull()).drop(date_column)


def counted_rows(fact: DataFrame, lookups: Sequence[Lookup], date_column: str, columns: Sequence[str]) -> DataFrame:
    """``(_day, columns..., _rows)`` of the enriched table, equal rows counted into one where it pays."""
    wanted = [*columns, date_column, _DAY]

    def kept(df: DataFrame, more: Sequence[str]) -> list[str]:
        return [c for c in df.columns if c in wanted or c in more]

    rows = _with_day(fact.select(*[quoted(c) for c in kept(fact, [u.fact_key for u in lookups])]), date_column)
    rows = rows.withColumn(_ROWS, F.lit(1).cast("bigint"))
    for number, lookup in enumerate(lookups):
        later = [u.fact_key for u in lookups[number + 1 :]]
        side = lookup.table.select(F.col(quoted(lookup.key)).alias("_key"), *[quoted(c) for c in kept(lookup.table, later) if c != lookup.key or c in wanted])
        side = _with_day(side, date_column)
        if number:
            rows = rows.groupBy(*[quoted(c) for c in rows.columns if c != _ROWS]).agg(F.sum(_ROWS).alias(_ROWS))
        rows = rows.join(side, F.col(quoted(lookup.fact_key)) == F.col("_key"))
        rows = rows.select(*[quoted(c) for c in kept(rows, later)], _ROWS)
    return rows


def enriched_categories(
    fact: DataFrame, lookups: Sequence[Lookup], date_column: str, columns: Sequence[str] | None = None, name: str = "dataset"
) -> tuple[DataFrame, DataFrame]:
    """``(shares, volume)`` of the enriched table, as of ``daily_category_share`` and ``daily_volume``.

    ``columns`` are by default all string columns of the fact table and the lookups but keys (``*_id`` and those
    joined by). The tables have no column name in common but for keys. Rows without a date belong to no day.
    """
    tables = [fact, *[u.table for u in lookups]]
    if columns is None:
        keys = {k for u in lookups for k in (u.fact_key, u.key)}
        columns = list(dict.fromkeys(c for t in tables for c in categorical_columns(t, date_column) if c not in keys))
    fields: dict[str, T.StructField] = {f.name: f for t in tables for f in t.schema}
    rows = counted_rows(fact, lookups, date_column, columns)
    # One more cell a row counts the rows of the day.
    cells = [F.lit(len(columns) + 1), F.lit(_CALENDAR), F.lit("")]
    for number, column in enumerate(columns):
        cells += [F.lit(number), as_text(fields[column])]
    counts = (
        rows.select(F.col(_DAY).alias("day"), _ROWS, F.stack(*cells).alias("col_no", "value"))
        .select("day", "col_no", value_key(F.col("value")).alias("key"), _ROWS)
        .filter(F.col("key").isNotNull() & F.col("day").isNotNull())
        .groupBy("day", "col_no", "key")
        .agg(F.sum(_ROWS).alias("cnt"))
    )
    # The calendar's cell is taken by a condition, and below left out by one that names both sides of the join: a plain
    # filter would be pushed below the shuffle of one read, and the reads would no longer share it and the joins.
    totals = counts.groupBy("day", "col_no").agg(F.sum("cnt").alias("filled"))
    in_day = F.when(F.col("col_no") == _CALENDAR, F.col("filled"))
    order = Window.partitionBy("dataset").orderBy("day")
    volume = (
        totals.groupBy("day")
        .agg(F.max(in_day).alias("row_count"))
        .select(F.lit(name).alias("dataset"), "day", "row_count")
        .withColumn("day_idx", (F.row_number().over(order) - 1).cast("bigint"))
        .select("dataset", "day", "day_idx", "row_count")
    )
    days = volume.withColumn("n_days", F.count(F.lit(1)).over(Window.partitionBy("dataset")))
    of_day = totals.withColumnsRenamed({"day": "of_day", "col_no": "of_no"}).join(days.drop("row_count"), F.col("of_day") == F.col("day")).drop("day")
    shares = counts.join(of_day, (F.col("day") == F.col("of_day")) & (F.col("col_no") == F.col("of_no")))
    shares = shares.filter(F.greatest("col_no", "of_no") != _CALENDAR)
    return (
        shares.select(
            "dataset", "day", "day_idx", "n_days", column_name(columns).alias("column"), "key", "cnt",
            (F.col("cnt") / F.col("filled")).alias("share"),
        ),
        volume,
    )
