"""Wide rows to one row per cell, inside the scan stage (no shuffle)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def melt(
    df: DataFrame,
    columns: Sequence[str],
    cell: Callable[[T.StructField], Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by..., col_no, value)``; ``col_no`` indexes ``columns``.

    Every cell goes through ``cell`` first, so that all of them have one type. The
    column is carried as a number, which is cheaper to group by than its name.
    """
    args: list[Column] = [F.lit(len(columns))]
    for number, name in enumerate(columns):
        args += [F.lit(number), cell(df.schema[name])]
    return df.select(*by, F.stack(*args).alias("col_no", "value"))


def column_name(columns: Sequence[str], col_no: Column | None = None) -> Column:
    """The name behind a ``col_no`` of :func:`melt`."""
    names = F.array(*[F.lit(c) for c in columns])
    return F.element_at(names, (F.col("col_no") if col_no is None else col_no) + 1)


def rows_from_structs(df: DataFrame, keep: Sequence[str], structs: Sequence[Column]) -> DataFrame:
    """One row per struct and input row, used on aggregated (small) frames."""
    return df.select(*keep, F.inline(F.array(*structs)))
