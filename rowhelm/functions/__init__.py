from rowhelm.functions.scalars import (
    as_number,
    as_text,
    day_of,
    hash_fraction,
    percent,
    row_digest,
    severity,
    value_key,
    whole_days_between,
    zscore,
)

__all__ = [
    "as_number",
    "as_text",
    "day_of",
    "hash_fraction",
    "percent",
    "row_digest",
    "severity",
    "value_key",
    "whole_days_between",
    "zscore",
]
