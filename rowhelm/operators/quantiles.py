"""Exact quantiles of many columns without sorting or collecting them.

Three passes count values by ever finer buckets that keep the order of the values, each
pass only inside the buckets that hold a wanted rank:

1. by sign and logarithm, in steps of 1/128 octave: under 2^19 buckets per column;
2. by the upper bits of the 64-bit sort key of a double: under 2^24 buckets per rank,
   since such a step holds under 2^47 doubles;
3. by the whole key: under 2^24 again, and each bucket is a single value.

So a pass shuffles a bounded number of counters, however many rows there are and however
they are spread, and rows outside the wanted buckets drop out inside the scan stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.functions.scalars import as_number
from rowhelm.operators.melt import column_name, melt

STEPS_PER_OCTAVE = 128
ABOVE_ALL_STEPS = 200_000
KEY_SHIFT = 23

# Fixed values of the double format.
FRACTION_BITS = 52
EXPONENT_BIAS = 1023
SMALLEST_NORMAL = 2.0**-1022


def _sign() -> Column:
    return F.when(F.col("value") < 0, F.lit(-1)).otherwise(F.lit(1))


def _never_null(column: Column) -> Column:
    """Tell the optimizer that there is no NULL, or it would filter on a second copy of
    the whole expression."""
    return F.coalesce(column, F.lit(0))


def _logarithm_step() -> Column:
    """Grows with the value; zero has no logarithm and is in the middle."""
    step = F.floor(F.least(F.log2(F.abs("value")) * STEPS_PER_OCTAVE, F.lit(0.9 * ABOVE_ALL_STEPS)))
    return F.when(F.col("value") == 0, F.lit(0)).otherwise(_never_null(_sign() * (step + ABOVE_ALL_STEPS)))


def _add_sort_key(cells: DataFrame) -> DataFrame:
    """Add ``key``: a BIGINT ordered like the double ``value``, one per distinct value.

    The logarithm may miss the exponent by one next to a power of two, which the ratio
    shows and ``step`` corrects; all other steps are exact in double arithmetic.
    """
    size = F.abs("value")
    guess = F.floor(F.log2(size))
    cells = cells.withColumn("guess", F.greatest(F.least(guess, F.lit(1023)), F.lit(-1022)).cast("double"))
    cells = cells.withColumn("ratio", size / F.pow(F.lit(2.0), F.col("guess")))
    step = F.when(F.col("ratio") >= 2, F.lit(1.0)).when(F.col("ratio") < 1, F.lit(-1.0)).otherwise(F.lit(0.0))
    scale = F.when(F.col("ratio") >= 2, F.lit(0.5)).when(F.col("ratio") < 1, F.lit(2.0)).otherwise(F.lit(1.0))
    unit = float(1 << FRACTION_BITS)
    exponent = (F.col("guess") + step + (EXPONENT_BIAS - 1)).cast("bigint")
    normal = F.shiftleft(exponent, FRACTION_BITS) + (F.col("ratio") * scale * unit).cast("bigint")
    subnormal = (size * 2.0**537 * 2.0**537).cast("bigint")
    magnitude = (
        F.when(size == F.lit(float("inf")), F.lit((2 * EXPONENT_BIAS + 1) << FRACTION_BITS))
        .when(size < SMALLEST_NORMAL, subnormal)
        .otherwise(normal)
    )
    return cells.withColumn("key", _never_null(magnitude * _sign())).drop("guess", "ratio")


def _position(total: Column, probability: float) -> Column:
    return (total - 1) * F.lit(float(probability))


def _wanted(total: Column, probabilities: Sequence[float]) -> Column:
    """Zero-based ranks to look up: two neighbours per probability."""
    targets = []
    for number, p in enumerate(probabilities):
        for upper, rank in ((False, F.floor), (True, F.ceil)):
            targets.append(
                F.struct(
                    F.lit(number).alias("number"),
                    F.lit(upper).alias("upper"),
                    rank(_position(total, p)).cast("bigint").alias("rank"),
                )
            )
    return F.array(*targets)


def _counters() -> list[Column]:
    return [F.count(F.lit(1)).alias("cnt"), F.min("value").alias("low"), F.max("value").alias("high")]


def _hit_buckets(histogram: DataFrame, within: Sequence[str]) -> DataFrame:
    """Buckets that hold a wanted rank, with the ranks counted from the bucket start."""
    running = Window.partitionBy("col_no", *within).orderBy("bucket")
    before = F.coalesce(F.sum("cnt").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def inside(target: Column) -> Column:
        return (target["rank"] >= F.col("before")) & (target["rank"] < F.col("before") + F.col("cnt"))

    return (
        histogram.withColumn("before", before)
        .withColumn("targets", F.filter("targets", inside))
        .filter(F.size("targets") > 0)
        .withColumn(
            "targets",
            F.transform("targets", lambda t: t.withField("rank", t["rank"] - F.col("before"))),
        )
        .select("col_no", "low", "high", "total", "targets")
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """``(column, probability, value)`` by linear interpolation between neighbours."""
    cells = melt(df, columns, as_number).filter(F.col("value").isNotNull())
    histogram = cells.groupBy("col_no", _logarithm_step().alias("bucket")).agg(*_counters())
    histogram = histogram.withColumn(
        "total", F.sum("cnt").over(Window.partitionBy("col_no"))
    ).withColumn("targets", _wanted(F.col("total"), probabilities))
    hits = _hit_buckets(histogram, [])
    for shift in (KEY_SHIFT, 0):
        # Each wanted rank lies in one bucket: at most 2 * probabilities rows per column,
        # with value ranges that do not overlap.
        wanted = F.broadcast(
            hits.select("col_no", F.col("low").alias("from"), F.col("high").alias("to"), "total", "targets")
        )
        inside = cells.join(wanted, "col_no").filter(F.col("value").between(F.col("from"), F.col("to")))
        histogram = (
            _add_sort_key(inside).groupBy("col_no", "from", "total", "targets", F.shiftright("key", shift).alias("bucket")).agg(*_counters())
        )
        hits = _hit_buckets(histogram, ["from"])
    lower = F.max(F.when(~F.col("upper"), F.col("low")))
    upper = F.max(F.when(F.col("upper"), F.col("low")))
    labels = F.array(*[F.lit(float(p)) for p in probabilities])
    return (
        hits.select("col_no", "total", "low", F.inline("targets"))
        .groupBy("col_no", "number")
        .agg(lower.alias("lower"), upper.alias("upper"), F.max("total").alias("total"))
        .withColumn("probability", F.element_at(labels, F.col("number") + 1))
        .withColumn("position", (F.col("total") - 1) * F.col("probability"))
        .select(
            column_name(columns).alias("column"),
            "probability",
            F.when(F.col("lower") == F.col("upper"), F.col("lower"))
            .otherwise(
                F.col("lower")
                + (F.col("upper") - F.col("lower")) * (F.col("position") - F.floor("position"))
            )
            .alias("value"),
        )
    )
