"""Columns that an operator doesn't use, carried past it under one name that nothing else has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sealed(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The ``used`` columns and a struct of all others; and what restores the columns and their order.

    What restores takes a frame that has the struct, and columns that replace some of the used ones.
    """
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    name = "_foreign"
    while name in docs.columns:
        name += "_"
    foreign = [c for c in docs.columns if c not in used]
    numbers = {c: f"c{k}" for k, c in enumerate(foreign)}  # any names would do, these need no quotes
    rest = F.struct(F.lit(0).alias("none"), *(quoted[c].alias(n) for c, n in numbers.items()))

    def opened(df: DataFrame, **new: Column) -> DataFrame:
        return df.select(*(F.col(f"{name}.{numbers[c]}").alias(c) if c in numbers else new.get(c, F.col(c)).alias(c) for c in docs.columns))

    return docs.select(*used, rest.alias(name)), opened
