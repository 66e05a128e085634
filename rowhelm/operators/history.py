"""Daily statistics that can be merged: a new day, or late rows of an old one, need no look at the raw table again.

The state has one row per day and column: counts, mean, the sum of squared deviations (M2), minimum and maximum,
and two sketches of bounded size: HyperLogLog for distinct values and KLL for quantiles. Two states of the same
day merge into the state of all its rows; states of different days merge into that of a longer time. The exact
statistics merge exactly (moments up to rounding); the sketches within their stated errors:

- distinct values: relative standard error 1.04 / sqrt(2 ** HLL_LOG2) with the default, 1.6 %;
- quantiles: a rank error of about 1.65 % with the default ``KLL_SIZE``, with 99 % confidence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowhelm.functions.scalars import as_number, as_text, clean, percent
from rowhelm.operators.daily import DAY, DailyProfile, with_day
from rowhelm.operators.melt import rows_from_structs
from rowhelm.types import is_numeric, numeric_columns

HLL_LOG2 = 12
KLL_SIZE = 200

KEYS = ["dataset", "day", "column"]
MOMENTS = "struct<n: bigint, mean: double, m2: double>"
STATE_SCHEMA = (
    "dataset string, day date, column string, position int, is_number boolean, row_count bigint, filled bigint, "
    "mean double, m2 double, min double, max double, distincts binary, quantiles binary"
)


def daily_state(df: DataFrame, date_column: str, name: str = "dataset", numeric: Sequence[str] | None = None) -> DataFrame:
    """The state of each day of a table, from one scan and one shuffle of a row a day and task.

    Numbers have moments and both sketches, other columns counts and distinct values. The row without a column is
    the table itself.
    """
    numeric = [c for c in (numeric_columns(df) if numeric is None else numeric) if c in df.columns and is_numeric(df.schema[c].dataType)]
    tracked = [c for c in df.columns if c != date_column]
    aggregates = [F.count(F.lit(1)).alias("row_count")]
    for i, column in enumerate(tracked):
        field = df.schema[column]
        aggregates += [F.count(clean(field)).alias(f"filled_{i}"), F.hll_sketch_agg(as_text(field), F.lit(HLL_LOG2)).alias(f"distincts_{i}")]
        if column in numeric:
            value = as_number(field)
            aggregates += [
                F.avg(value).alias(f"mean_{i}"), (F.var_pop(value) * F.count(value)).alias(f"m2_{i}"),
                F.min(value).alias(f"min_{i}"), F.max(value).alias(f"max_{i}"), F.kll_sketch_agg_double(value, F.lit(KLL_SIZE)).alias(f"quantiles_{i}"),
            ]
    days = with_day(df, date_column).groupBy(F.col(DAY).alias("day")).agg(*aggregates).withColumn("dataset", F.lit(name))
    kinds = {"mean": "double", "m2": "double", "min": "double", "max": "double", "quantiles": "binary"}

    def struct(i: int | None, column: str | None) -> Column:
        number = column in numeric
        parts = {
            "column": F.lit(column).cast("string"),
            "position": F.lit(i).cast("int"),
            "is_number": F.lit(number),
            "filled": F.col("row_count") if i is None else F.col(f"filled_{i}"),
            "distincts": F.lit(None).cast("binary") if i is None else F.col(f"distincts_{i}"),
        } | {s: F.col(f"{s}_{i}") if number else F.lit(None).cast(t) for s, t in kinds.items()}
        return F.struct(*[value.alias(s) for s, value in parts.items()])

    structs = [struct(None, None), *(struct(i, column) for i, column in enumerate(tracked))]
    return _in_order(rows_from_structs(days, ["dataset", "day", "row_count"], structs))


def _in_order(state: DataFrame) -> DataFrame:
    return state.select([c.split()[0] for c in STATE_SCHEMA.split(", ")])


def _merged_moments(parts: Column) -> Column:
    """Count, mean and M2 of the union of parts, one after the other; each has its own mean, so nothing cancels out."""

    def both(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        merged = F.struct(
            n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2")
        )
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(merged)

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.array_sort(parts), start.cast(MOMENTS), both)


def merge_states(*states: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """One state of the rows of all ``states``, by day and column or by other columns of the state.

    A group has a row for each state, or for each of its days: only summaries meet.
    """
    parts = F.struct(F.when(F.col("mean").isNotNull(), F.col("filled")).otherwise(0).cast("bigint").alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2"))
    merged = (
        reduce(DataFrame.unionByName, states)
        .groupBy(*by)
        .agg(
            F.min("position").alias("position"),
            F.max("is_number").alias("is_number"),
            F.sum("row_count").alias("row_count"),
            F.sum("filled").alias("filled"),
            _merged_moments(F.collect_list(parts)).alias("moments"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.hll_union_agg("distincts").alias("distincts"),
            F.kll_merge_agg_double("quantiles").alias("quantiles"),
        )
    )
    has = F.col("is_number") & (F.col("moments.n") > 0)
    return merged.withColumns({"mean": F.when(has, F.col("moments.mean")), "m2": F.when(has, F.col("moments.m2"))}).drop("moments")


def profile_of_state(state: DataFrame) -> DailyProfile:
    """What the series detectors read: the volume and the columns of each day, as ``daily_columns`` gives them."""
    order = Window.partitionBy("dataset").orderBy("day")  # a row a day and column; the sketches stay out of it
    state = state.drop("distincts", "quantiles").withColumn("day_idx", (F.dense_rank().over(order) - 1).cast("bigint"))
    missing = F.col("row_count") - F.col("filled")
    named = F.col("column").isNotNull()
    columns = state.select(
        "dataset", "day", "day_idx", "row_count", "column",
        F.when(named, missing).alias("null_count"),
        F.when(named, percent(missing, F.col("row_count"))).alias("null_rate"),
        "mean", "min", "max",
        F.when(F.col("is_number") & (F.col("filled") > 1), F.sqrt(F.col("m2") / (F.col("filled") - 1))).alias("std"),
    )
    return DailyProfile(columns.filter(~named).select("dataset", "day", "day_idx", "row_count"), columns)


def approximate_statistics(state: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(dataset, column, filled, unique_count, quantiles)`` over all days of a state, from its sketches alone."""
    whole = merge_states(state.filter(F.col("column").isNotNull()), by=["dataset", "column"])
    wanted = F.array(*map(F.lit, probabilities))
    return whole.select(
        "dataset", "column", "position", "filled", F.hll_sketch_estimate("distincts").alias("unique_count"),
        F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", wanted)).alias("quantiles"),
    )


def append_days(df: DataFrame, date_column: str, path: str, name: str = "dataset", late: bool = False) -> None:
    """Add the days of ``df`` to a stored state; only their partitions are written.

    A day that is there is replaced, so that a failed or repeated load does no harm. With ``late``, the rows are added
    to those of the day; that reads the partitions of these days and no others.
    """
    spark = df.sparkSession
    state = daily_state(df, date_column, name)
    if late:
        days = state.filter(F.col("column").isNull()).select("dataset", "day").collect()  # one row a day
        known = load_state(spark, path).filter(F.col("dataset") == name).filter(F.col("day").isin([r["day"] for r in days]))
        # written apart first: a partition can't be read and replaced at once
        state = spark.createDataFrame(_in_order(merge_states(state, known)).collect(), STATE_SCHEMA)  # days x columns of the load
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "day").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(path)
