"""Value frequencies: the shared base of distinct counts, top values and daily shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.functions.scalars import DIGEST_PREFIX, INLINE_KEY_BYTES, as_text, value_key
from rowhelm.operators.melt import column_name, melt


def value_frequency(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., col_no, key, cnt, chars)`` with one row per distinct non-null value.

    One shuffle serves all columns. Values are counted before it, so a value holding a
    third of all rows arrives as one row per task, and the key is at most 71 bytes, so
    long texts are not shuffled here (``spelled_out`` may, see there).
    """
    return (
        melt(df, columns, as_text, by)
        .filter(F.col("value").isNotNull())
        .select(*by, "col_no", value_key(F.col("value")).alias("key"), F.length("value").alias("chars"))
        .filter(F.col("key").isNotNull())  # a join on the key asks for this; said here, the shuffle is still shared
        .groupBy(*by, "col_no", "key")
        .agg(F.count(F.lit(1)).alias("cnt"), F.max("chars").cast("bigint").alias("chars"))
    )


def spelled_out(df: DataFrame, columns: Sequence[str], keyed: DataFrame) -> DataFrame:
    """Put the whole text back in place of digest keys: adds ``value`` to ``keyed``.

    ``keyed`` is a small frame with ``col_no`` and ``key``. The table is read again only
    when a digest is among the keys; otherwise the join side is empty and adaptive
    execution drops the scan.
    """
    digests = (
        keyed.filter(F.col("key").startswith(DIGEST_PREFIX)).select("col_no", "key").distinct()
    )
    texts = (
        melt(df, columns, as_text)
        .filter(F.octet_length("value") > INLINE_KEY_BYTES)
        .withColumn("key", value_key(F.col("value")))
        .join(digests, ["col_no", "key"], "left_semi")
        .select("col_no", "key", F.col("value").alias("long_value"))
        .distinct()
    )
    return (
        keyed.join(texts, ["col_no", "key"], "left")
        .withColumn("value", F.coalesce("long_value", "key"))
        .drop("long_value")
    )


def distinct_stats(frequency: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, unique_count, unique_percent, avg_length)`` from a value frequency."""
    return (
        frequency.groupBy("col_no")
        .agg(
            F.count(F.lit(1)).alias("unique_count"),
            F.sum("cnt").alias("filled"),
            F.sum(F.col("chars") * F.col("cnt")).alias("total_chars"),
        )
        .select(
            column_name(columns).alias("column"),
            "unique_count",
            F.round(F.col("unique_count") / F.col("filled") * 100, 2).alias("unique_percent"),
            F.round(F.col("total_chars") / F.col("filled"), 2).alias("avg_length"),
        )
    )


def most_common(frequency: DataFrame, k: int = 5) -> DataFrame:
    """``(col_no, key, cnt, rank)`` of the k most frequent keys per column.

    Ties go to the smaller key. The rank filter sits right on the window, so each task
    keeps k rows per column before the shuffle.
    """
    order = Window.partitionBy("col_no").orderBy(F.desc("cnt"), "key")
    return (
        frequency.select("col_no", "key", "cnt")
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("rank") <= k)
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5, frequency: DataFrame | None = None) -> DataFrame:
    """``(column, rank, value, cnt)``: the k most frequent values of each column."""
    if frequency is None:
        frequency = value_frequency(df, columns)
    return spelled_out(df, columns, most_common(frequency, k)).select(
        column_name(columns).alias("column"), "rank", "value", "cnt"
    )
