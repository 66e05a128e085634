"""Scalar column expressions shared by the operators. All are built-in, JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowhelm.types import CRITICAL, HIGH, LOW, MEDIUM, is_complex

# Values up to this many bytes are grouped as they are, longer ones by digest.
INLINE_KEY_BYTES = 64
DIGEST_PREFIX = "sha256:"
# Nested moments keep their microseconds, and instants do not depend on the session time zone.
JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timeZone": "UTC",
}


def quoted(name: str) -> str:
    """Column reference that survives dots and spaces in the name."""
    return "`" + name.replace("`", "``") + "`"


def clean(field: T.StructField) -> Column:
    """The column with NaN turned into NULL; a missing value has one spelling."""
    column = F.col(quoted(field.name))
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def as_number(field: T.StructField) -> Column:
    return clean(field).cast("double")


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype)
    return isinstance(dtype, T.MapType) or (isinstance(dtype, T.ArrayType) and _has_map(dtype.elementType))


def _maps_sorted(column: Column, dtype: T.DataType) -> Column:
    """Every map at any depth becomes its sorted entries, so that entry order does not matter."""
    if not _has_map(dtype):
        return column
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: _maps_sorted(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        inner = [_maps_sorted(column.getField(f.name), f.dataType).alias(f.name) for f in dtype]
        return F.when(column.isNotNull(), F.struct(*inner))
    entries = F.transform(
        F.map_entries(column),
        lambda e: F.struct(e["key"].alias("key"), _maps_sorted(e["value"], dtype.valueType).alias("value")),
    )
    return F.array_sort(entries)


def as_text(field: T.StructField) -> Column:
    """A string that is equal exactly when the values are equal."""
    column = clean(field)
    dtype = field.dataType
    if isinstance(dtype, T.StringType):
        return column
    if isinstance(dtype, T.BinaryType):
        return F.base64(column)
    if is_complex(dtype):
        return F.to_json(_maps_sorted(column, dtype), JSON_OPTIONS)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (column + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
    return column.cast("string")


def value_key(text: Column) -> Column:
    """Grouping key of bounded size: the value itself, or its SHA-256 when long.

    Inline keys are at most 64 bytes and digest keys are 71, so the two never meet.
    """
    digest = F.concat(F.lit(DIGEST_PREFIX), F.sha2(text, 256))
    return F.when(F.octet_length(text) <= INLINE_KEY_BYTES, text).otherwise(
        F.when(text.isNotNull(), digest)
    )


def row_digest(fields: Sequence[T.StructField]) -> Column:
    """32-byte SHA-256 over all columns, NULL equal to NULL."""
    parts = []
    for field in fields:
        text = as_text(field)
        # The length in front keeps ("a", "bc") and ("ab", "c") apart.
        parts.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))


def day_of(column: Column) -> Column:
    return F.to_date(column)


def whole_days_between(start: Column, end: Column) -> Column:
    """Elapsed full 24-hour periods, not the number of midnights crossed."""
    return F.timestamp_diff("DAY", start, end)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def zscore(value: Column, count: Column, mean: Column, std: Column) -> Column:
    """0 for fewer than two earlier points or a constant history."""
    return F.when((count >= 2) & (std > 0), (value - mean) / std).otherwise(F.lit(0.0))


def severity(z: Column) -> Column:
    size = F.abs(z)
    return (
        F.when(size >= 4, CRITICAL)
        .when(size >= 3, HIGH)
        .when(size >= 2, MEDIUM)
        .otherwise(LOW)
    )


def hash_fraction(seed: int, salt: str, *keys: Column) -> Column:
    """Uniform value in [0, 1) fixed by seed, salt and keys, on any cluster layout."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
