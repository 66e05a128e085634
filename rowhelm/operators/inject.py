"""Plant known faults into a table, row by row and without a shuffle.

Whether a row is hit depends on a hash of its key, so a fault is the same on every run
and every cluster layout.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowhelm.functions.scalars import day_of, hash_fraction

# The fault names and their sizes.
FAULT_VOLUME_DROP = "volume_drop"
FAULT_NEGATIVE = "negative_prices"
FAULT_NULLS = "null_customers"
FAULT_CATEGORY_SHIFT = "category_shift"
KEEP_SHARE = 0.5
NEGATIVE_SHARE = 0.05
NULL_SHARE = 0.20
NORMAL_WEIGHTS = [0.25, 0.25, 0.20, 0.15, 0.15]
SHIFTED_WEIGHTS = [0.60, 0.15, 0.10, 0.10, 0.05]


def _on(day: date, date_column: str) -> Column:
    return F.coalesce(day_of(F.col(date_column)) == F.lit(day), F.lit(False))


def _hit(share: float, seed: int, salt: str, key: str) -> Column:
    return hash_fraction(seed, salt, F.col(key)) < share


def pick_weighted(fraction: Column, values: Sequence[str], weights: Sequence[float]) -> Column:
    """The value whose slice of [0, 1) holds ``fraction``."""
    picked = None
    total = 0.0
    for value, weight in zip(values[:-1], weights[:-1]):
        total += weight
        test = fraction < round(total, 9)
        picked = F.when(test, F.lit(value)) if picked is None else picked.when(test, F.lit(value))
    return F.lit(values[-1]) if picked is None else picked.otherwise(F.lit(values[-1]))


def inject_volume_drop(
    df: DataFrame, date_column: str, day: date, key: str, keep: float = KEEP_SHARE, seed: int = 42
) -> DataFrame:
    """Leave out part of the rows of one day."""
    return df.filter(~_on(day, date_column) | _hit(keep, seed, "drop", key))


def inject_negative(
    df: DataFrame, date_column: str, day: date, key: str, column: str, share: float = NEGATIVE_SHARE, seed: int = 42
) -> DataFrame:
    """Turn part of the numbers of one day negative."""
    hit = _on(day, date_column) & _hit(share, seed, "negative", key)
    return df.withColumn(column, F.when(hit, -F.abs(F.col(column))).otherwise(F.col(column)))


def inject_nulls(
    df: DataFrame,
    date_column: str,
    day: date,
    key: str,
    column: str,
    share: float = NULL_SHARE,
    background: Column | None = None,
    seed: int = 42,
) -> DataFrame:
    """Blank part of the values of one day, and a ``background`` share on the other days."""
    rate = F.when(_on(day, date_column), F.lit(share)).otherwise(F.lit(0.0) if background is None else background)
    hit = hash_fraction(seed, "null", F.col(key)) < rate
    return df.withColumn(column, F.when(~hit, F.col(column)))


def inject_category_shift(
    df: DataFrame,
    date_column: str,
    day: date,
    key: str,
    column: str,
    categories: Sequence[str],
    weights: Sequence[float] = SHIFTED_WEIGHTS,
    seed: int = 42,
) -> DataFrame:
    """Draw the categories of one day anew, with other weights."""
    drawn = pick_weighted(hash_fraction(seed, "shift", F.col(key)), categories, weights)
    return df.withColumn(column, F.when(_on(day, date_column), drawn).otherwise(F.col(column)))


def injected_faults(spark: SparkSession, faults: dict[date, str]) -> DataFrame:
    """The ground truth: ``(day, fault)``."""
    return spark.createDataFrame(sorted(faults.items()), "day date, fault string")


# The anomaly types by which a detector shows each fault.
FAULT_SIGNS = {
    FAULT_VOLUME_DROP: "volume_drop",
    FAULT_NEGATIVE: "negative_values",
    FAULT_NULLS: "null_rate_increase",
    FAULT_CATEGORY_SHIFT: "distribution_shift",
}


def injected_vs_detected(faults: DataFrame, anomalies: DataFrame) -> DataFrame:
    """``(day, fault, hits, detected)``: was each planted fault flagged on its day?"""
    signs = F.create_map(*[F.lit(x) for pair in FAULT_SIGNS.items() for x in pair])
    # Counted first: one row per day and type joins the handful of planted faults.
    flagged = anomalies.groupBy("day", "type").agg(F.count(F.lit(1)).alias("hits"))
    return (
        faults.withColumn("type", signs[F.col("fault")])
        .join(flagged, ["day", "type"], "left")
        .select("day", "fault", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))
        .withColumn("detected", F.col("hits") > 0)
    )
