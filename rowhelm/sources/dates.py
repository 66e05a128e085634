"""Find and convert date columns that arrive as text.

A column is converted only if all its values are dates of one and the same format. Which formats a value fits
is a bit mask; masks are folded by ``bit_and``, so one aggregation tests all columns of all tables for all formats
(see ``inference``), and one result row a column is all that reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowhelm.functions.scalars import clean, quoted
from rowhelm.operators.melt import column_name, melt
from rowhelm.types import datetime_columns

# Parts of a column name that suggest a date.
DATE_WORDS = ["date", "time", "timestamp", "created", "updated"]

_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_ZONE = r"( ?Z| UTC| GMT| ?[+-]\d{2}:?\d{2})"
# Month and day with slashes. Months above 12 are left out here, since a failing parse costs far more than a pattern.
_MONTH_DAY = r"\d{1,2}/(?<!1[3-9]/|[2-9]\d/)\d{1,2}"
_DAY_MONTH = r"\d{1,2}/(0?[1-9]|1[0-2])"

# Accepted texts by format. Texts of ISO are cast; month-first goes before day-first.
# Other names are patterns of Spark; a weekday in front is left out, and a zone behind is added to the pattern's moment.
DATE_FORMATS = {
    "iso day": rf"^{_DAY}$",
    "iso minute": rf"^{_DAY} \d{{1,2}}:\d{{2}}$",
    "iso T minute": rf"^{_DAY}T\d{{1,2}}:\d{{2}}$",
    "iso second": rf"^{_DAY} \d{{1,2}}:\d{{2}}:\d{{2}}$",
    "iso T second": rf"^{_DAY}T\d{{1,2}}:\d{{2}}:\d{{2}}$",
    "iso fraction": rf"^{_DAY} \d{{1,2}}:\d{{2}}:\d{{2}}\.\d{{1,9}}$",
    "iso T fraction": rf"^{_DAY}T\d{{1,2}}:\d{{2}}:\d{{2}}\.\d{{1,9}}$",
    "zoned minute": rf"^{_DAY}[ T]\d{{1,2}}:\d{{2}}{_ZONE}$",
    "zoned second": rf"^{_DAY}[ T]\d{{1,2}}:\d{{2}}:\d{{2}}{_ZONE}$",
    "zoned fraction": rf"^{_DAY}[ T]\d{{1,2}}:\d{{2}}:\d{{2}}\.\d{{1,9}}{_ZONE}$",
    "yyyyMMdd": r"^\d{8}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "yyyy/M/d H:mm": r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$",
    "yyyy/M/d H:mm:ss": r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$",
    "yyyy.M.d": r"^\d{4}\.\d{1,2}\.\d{1,2}$",
    "M/d/yyyy": rf"^{_MONTH_DAY}/\d{{4}}$",
    "d/M/yyyy": rf"^{_DAY_MONTH}/\d{{4}}$",
    "M/d/yyyy H:mm": rf"^{_MONTH_DAY}/\d{{4}} \d{{1,2}}:\d{{2}}$",
    "d/M/yyyy H:mm": rf"^{_DAY_MONTH}/\d{{4}} \d{{1,2}}:\d{{2}}$",
    "M/d/yyyy H:mm:ss": rf"^{_MONTH_DAY}/\d{{4}} \d{{1,2}}:\d{{2}}:\d{{2}}$",
    "d/M/yyyy H:mm:ss": rf"^{_DAY_MONTH}/\d{{4}} \d{{1,2}}:\d{{2}}:\d{{2}}$",
    "M/d/yyyy h:mm a": rf"^{_MONTH_DAY}/\d{{4}} \d{{1,2}}:\d{{2}} [AP]M$",
    "M/d/yy": rf"^{_MONTH_DAY}/\d{{2}}$",
    "d/M/yy": rf"^{_DAY_MONTH}/\d{{2}}$",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Z][a-z]{2,8} \d{1,2}, \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Z][a-z]{2} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Z][a-z]{2,8} \d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$",
    "weekday d MMM yyyy H:mm:ss": r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4} \d{1,2}:\d{2}:\d{2}$",
    "weekday d MMM yyyy H:mm:ss zone": rf"^[A-Z][a-z]{{2}}, \d{{1,2}} [A-Z][a-z]{{2}} \d{{4}} \d{{1,2}}:\d{{2}}:\d{{2}}{_ZONE}$",
}

#: Years of two digits from this one on belong to the last century.
LAST_CENTURY_FROM = 69

# How formats begin: a text that begins otherwise is of none that begins so.
_BEGINNINGS = (r"^\d{4}", r"^\d{8}", r"^\d{1,2}/", r"^\d{1,2}-", r"^\d{1,2} ", "^[A-Z]")
# What the texts of all formats begin with; numbers and words fail here after few characters.
_BEGINS_AS_DATE = r"^(\d{4}[-/.]\d|\d{8}|\d{1,2}([-/]\d|[- ][A-Z])|[A-Z][a-z]{2,8},? \d)"

# So many formats are looked at in compiled code.
FEW_FORMATS = 4

# No date is longer; other texts are ruled out before any pattern is tried.
LONGEST_DATE = 40


def _whole(column: Column, pattern: str, group: int) -> Column:
    """A group of digits as a number; NULL if it is empty, which is asked first, since failing casts are dear."""
    digits = F.regexp_extract(column, pattern, group)
    return F.when(digits != "", digits.try_cast("int"))


def _offset(column: Column) -> Column:
    """The zone at the end of a text, as an interval east of UTC; Z, UTC and GMT are none."""
    zone = r"([+-])(\d{2}):?(\d{2})$"
    sign = F.regexp_extract(column, zone, 1)
    seconds = _whole(column, zone, 2) * 3600 + _whole(column, zone, 3) * 60
    return F.make_dt_interval(secs=F.coalesce(F.when(sign == "-", -seconds).otherwise(seconds), F.lit(0)))


def is_of(column: Column, name: str) -> Column:
    """Whether the text is of the format; the usual spelling with slashes is looked at as an ISO day, which is cast faster than a pattern is parsed."""
    slow = F.coalesce(_parsed(column, name).isNotNull(), F.lit(False))
    slashed = re.fullmatch(r"(M/d|d/M)/yyyy( H:mm(:ss)?)?", name)
    if not slashed:
        return slow
    clock = {None: "", " H:mm": r" ([01]\d|2[0-3]):[0-5]\d", " H:mm:ss": r" ([01]\d|2[0-3]):[0-5]\d:[0-5]\d"}[slashed[2]]
    month, day = (1, 4) if slashed[1] == "M/d" else (4, 1)
    iso = F.concat(F.substring(column, 7, 4), F.lit("-"), F.substring(column, month, 2), F.lit("-"), F.substring(column, day, 2))
    usual = column.rlike(rf"^\d{{2}}/\d{{2}}/[1-9]\d{{3}}{clock}\z")
    return F.when(usual, iso.try_cast("date").isNotNull()).otherwise(slow)


def _parsed(column: Column, name: str) -> Column:
    """The moment (in UTC if the text has a zone), or NULL if the text is not of this format."""
    plain = F.regexp_replace(column, _ZONE + "$", "")
    if name.startswith("iso"):
        moment = column.try_cast("timestamp_ntz")
    elif name.startswith("zoned"):
        moment = plain.try_cast("timestamp_ntz") - _offset(column)
    elif name.startswith("weekday"):
        pattern = name.removeprefix("weekday ").removesuffix(" zone")
        body = F.regexp_replace(plain if name.endswith("zone") else column, "^[A-Z][a-z]{2}, ", "")
        moment = _of_pattern(body, pattern)
        moment = moment - _offset(column) if name.endswith("zone") else moment
    else:
        moment = _of_pattern(column, name)
        if name.endswith("/yy"):
            moment = F.when(F.year(moment) >= 2000 + LAST_CENTURY_FROM, moment - F.make_ym_interval(F.lit(100))).otherwise(moment)
    return F.when(may_be_date(column) & column.rlike(DATE_FORMATS[name]), moment)


_CLOCK = r" (\d{1,2}):(\d{2}):?(\d{2})?( [AP]M)?$"


def _of_pattern(column: Column, pattern: str) -> Column:
    """The moment of a text by a pattern of Spark: its day, and the clock time counted on, which no time zone shifts."""
    day_pattern, *clock = re.split(" [Hh]:", pattern)
    day = F.try_to_date(F.regexp_replace(column, _CLOCK, "") if clock else column, day_pattern)
    if not clock:
        return day.cast("timestamp_ntz")
    hour, minute, second = (F.coalesce(_whole(column, _CLOCK, k), F.lit(0)) for k in (1, 2, 3))
    valid = (hour < 24) & (minute < 60) & (second < 60)
    if pattern.endswith(" a"):
        valid = valid & hour.between(1, 12)
        hour = hour % 12 + F.when(column.endswith("PM"), 12).otherwise(0)
    return F.when(valid, day.cast("timestamp_ntz") + F.make_dt_interval(hours=hour, mins=minute, secs=second))


def may_be_date(column: Column) -> Column:
    return F.octet_length(column) <= LONGEST_DATE


def format_mask(column: Column) -> Column:
    """Bit j is set if the text is of the j-th format; most texts are ruled out by how they begin."""
    any_format = "|".join(dict.fromkeys(DATE_FORMATS.values()))
    none = F.lit(0).cast("bigint")
    begins = {name: next(b for b in _BEGINNINGS if pattern.startswith(b)) for name, pattern in DATE_FORMATS.items()}

    def bits(text: Column) -> Column:
        alike = {b: [] for b in _BEGINNINGS}
        for j, name in enumerate(DATE_FORMATS):
            alike[begins[name]].append(F.when(_parsed(text, name).isNotNull(), F.lit(1 << j).cast("bigint")).otherwise(none))
        return reduce(Column.__add__, [F.when(text.rlike(b), reduce(Column.__add__, some)).otherwise(none) for b, some in alike.items()])

    # All formats in one expression are more code than one compiled method can hold; in a lambda they are interpreted.
    fits = F.element_at(F.transform(F.array(column), bits), 1)
    may_be = may_be_date(column) & column.rlike(_BEGINS_AS_DATE) & column.rlike(any_format)
    return F.when(column.isNotNull(), F.when(may_be, fits).otherwise(none))


def mask_of(column: Column, formats: int) -> Column:
    """``format_mask`` with the bits of ``formats`` alone."""
    none = F.lit(0).cast("bigint")
    names = [(j, name) for j, name in enumerate(DATE_FORMATS) if formats >> j & 1]
    if len(names) > FEW_FORMATS:
        return format_mask(column).bitwiseAND(F.lit(formats).cast("bigint"))
    bits = [F.when(is_of(column, name), F.lit(1 << j).cast("bigint")).otherwise(none) for j, name in names]
    return F.when(column.isNotNull(), reduce(Column.__add__, bits, none))


def format_of(mask: int | None) -> str | None:
    """The first format that is left in a folded mask."""
    return next((name for j, name in enumerate(DATE_FORMATS) if mask and mask >> j & 1), None)


def matching_formats(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The format that fits all non-null values of each column, if there is one."""
    return formats_of_tables({"": (df, columns)})[""]


def formats_of_tables(tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, dict[str, str | None]]:
    """``matching_formats`` of the named columns of many tables, from one job over all of them."""
    found = {name: dict.fromkeys(columns) for name, (_, columns) in tables.items()}
    if any(columns for _, columns in tables.values()):
        for row in folded_masks(tables, format_mask).collect():  # one row a column
            found[row["dataset"]][row["column"]] = format_of(row["mask"])
    return found


def folded_masks(tables: dict[str, tuple[DataFrame, list[str]]], mask: Callable[[Column], Column]) -> DataFrame:
    """``(dataset, column, n, filled, mask)``: the bits that all non-null values of a text column have.

    The cells of all tables are one frame, so there is one aggregation, and it needs no shuffle but of a row a column and task.
    """
    cells = [
        melt(df, columns, clean).select(F.lit(name).alias("dataset"), column_name(columns).alias("column"), "value")
        for name, (df, columns) in tables.items()
        if columns
    ]
    return reduce(DataFrame.unionByName, cells).groupBy("dataset", "column").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"), F.bit_and(mask(F.col("value"))).alias("mask")
    )


def parse_column(df: DataFrame, name: str, fitting: str) -> DataFrame:
    return df.withColumn(name, _parsed(F.col(quoted(name)), fitting))


def _text_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def parse_dates_by_name(df: DataFrame) -> DataFrame:
    """Convert the text columns whose name suggests a date and whose values all are dates."""
    named = [c for c in _text_names(df) if any(word in c.lower() for word in DATE_WORDS)]
    for name, pattern in matching_formats(df, named).items():
        if pattern:
            df = parse_column(df, name, pattern)
    return df


def find_date_columns(tables: dict[str, DataFrame]) -> dict[str, tuple[str | None, str | None]]:
    """``(column, pattern)`` of each table: the first datetime column, else the first text column of dates.

    The pattern is None for a column that needs no conversion. One job for all tables.
    """
    typed = {name: datetime_columns(df) for name, df in tables.items()}
    untyped = {name: (df, _text_names(df)) for name, df in tables.items() if not typed[name]}
    found = {name: (columns[0], None) for name, columns in typed.items() if columns}
    for name, formats in formats_of_tables(untyped).items():
        found[name] = next(((column, pattern) for column, pattern in formats.items() if pattern), (None, None))
    return found


def find_date_column(df: DataFrame) -> tuple[str | None, str | None]:
    return find_date_columns({"": df})[""]


def with_date_column(df: DataFrame) -> tuple[DataFrame, str | None]:
    """The table with its date column converted, and the name of that column."""
    name, pattern = find_date_column(df)
    return (parse_column(df, name, pattern) if name and pattern else df), name
