"""Column classification, result schemas and the public thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Anomaly kinds, in the order their detectors report them.
VOLUME_DROP = "volume_drop"
VOLUME_SPIKE = "volume_spike"
NULL_RATE_INCREASE = "null_rate_increase"
NEGATIVE_VALUES = "negative_values"
MEAN_SHIFT = "mean_shift"
DISTRIBUTION_SHIFT = "distribution_shift"

# Severity labels.
LOW, MEDIUM, HIGH, CRITICAL = "low", "medium", "high", "critical"


@dataclass(frozen=True)
class DetectionThresholds:
    """Knobs of the day-over-history detectors (all comparisons are strict)."""

    volume_z: float = 2.5
    null_z: float = 2.5
    value_z: float = 3.0
    min_history_days: int = 5
    null_rate_floor: float = 1.0  # percent
    share_shift: float = 0.15
    share_shift_high: float = 0.25

    def __post_init__(self) -> None:
        if self.share_shift < 0:
            raise ValueError("share_shift must not be negative")
        if self.min_history_days < 0:
            raise ValueError("min_history_days must not be negative")


@dataclass(frozen=True)
class ComparisonThresholds:
    """Knobs of the profile-against-profile comparison (strict as well)."""

    null_rate: float = 0.05
    null_rate_high_points: float = 10.0
    mean: float = 0.10
    mean_high: float = 0.30
    row_count: float = 0.20
    row_count_high: float = 0.50
    unique_count: float = 0.20


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_complex(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_datetime(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    """Everything that is profiled by its distinct values."""
    return [f.name for f in df.schema if not is_numeric(f.dataType) and not is_datetime(f.dataType)]


def categorical_columns(df: DataFrame, date_column: str) -> list[str]:
    """String columns whose daily shares are tracked; keys (``*_id``) are not."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType)
        and f.name != date_column
        and not f.name.endswith("_id")
    ]


# Bytes one value of a fixed-width type occupies; other types are measured.
FIXED_WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.LongType: 8,
    T.FloatType: 4,
    T.DoubleType: 8,
    T.DateType: 4,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DecimalType: 16,
}


def fixed_width(dtype: T.DataType) -> int | None:
    return FIXED_WIDTHS.get(type(dtype))
