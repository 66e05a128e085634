"""Detectors: each day against all earlier observed days of the same series.

They work on the daily tables, whose size depends on days, columns and categories but not
on the rows behind them. Earlier anomalous days stay in the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.functions.scalars import severity, zscore
from rowhelm.operators.daily import DailyProfile, with_category_text, with_known_text
from rowhelm.types import (
    DISTRIBUTION_SHIFT,
    HIGH,
    MEAN_SHIFT,
    MEDIUM,
    NEGATIVE_VALUES,
    NULL_RATE_INCREASE,
    VOLUME_DROP,
    VOLUME_SPIKE,
    DetectionThresholds,
)

DEFAULTS = DetectionThresholds()

ANOMALY_COLUMNS = [
    "dataset", "day", "detector_ord", "type", "severity", "column", "category",
    "message", "expected", "actual", "z_score",
]


def earlier_days(*partition: str) -> Window:
    """All earlier observed days of a series (days without rows do not exist)."""
    return (
        Window.partitionBy("dataset", *partition)
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def with_history(series: DataFrame, values: dict[str, str], partition: tuple[str, ...] = ()) -> DataFrame:
    """Add count, mean, population deviation and minimum of the earlier values, and the z-score.

    ``values`` maps a prefix for the added columns to the column looked at; all of them
    share one sort and one window. Days on which a value is missing do not count.
    """
    past = earlier_days(*partition)
    series = series.withColumns({v: F.col(v).cast("double") for v in values.values()})
    history = []
    for prefix, value in values.items():
        history += [
            F.count(value).over(past).alias(f"{prefix}_hist_count"),
            F.avg(value).over(past).alias(f"{prefix}_hist_mean"),
            F.stddev_pop(value).over(past).alias(f"{prefix}_hist_std"),
            F.min(value).over(past).alias(f"{prefix}_hist_min"),
        ]
    scores = {
        f"{prefix}_z": zscore(
            F.col(value),
            F.col(f"{prefix}_hist_count"),
            F.col(f"{prefix}_hist_mean"),
            F.col(f"{prefix}_hist_std"),
        )
        for prefix, value in values.items()
    }
    return series.select("*", *history).withColumns(scores)


def _finding(
    order: int, kind: Column, level: Column, message: Column, expected: Column, actual: Column, z: Column
) -> Column:
    return F.struct(
        F.lit(order).alias("detector_ord"),
        kind.alias("type"),
        level.alias("severity"),
        message.alias("message"),
        expected.cast("double").alias("expected"),
        actual.cast("double").alias("actual"),
        z.cast("double").alias("z_score"),
    )


def _volume_finding(t: DetectionThresholds) -> Column:
    z = F.col("rows_z")
    drop = z < -t.volume_z
    text = F.format_string(
        "%,d rows on this day, against %,.0f on average before (deviation %,.0f)",
        F.col("row_count").cast("bigint"), F.col("rows_hist_mean"), F.col("rows_hist_std"),
    )
    finding = _finding(
        0, F.when(drop, VOLUME_DROP).otherwise(VOLUME_SPIKE), severity(z), text,
        F.col("rows_hist_mean"), F.col("row_count"), F.round(z, 2),
    )
    return F.when((F.col("day_idx") >= t.min_history_days) & (drop | (z > t.volume_z)), finding)


def _null_finding(t: DetectionThresholds) -> Column:
    z, rate = F.col("null_z"), F.col("null_rate")
    gate = (F.col("day_idx") >= t.min_history_days) & (F.col("null_hist_count") >= t.min_history_days)
    text = F.format_string(
        "%.1f%% of the values are missing, against %.1f%% on average before", rate, F.col("null_hist_mean")
    )
    finding = _finding(
        1, F.lit(NULL_RATE_INCREASE), severity(z), text, F.col("null_hist_mean"), rate, F.round(z, 2)
    )
    return F.when(gate & (z > t.null_z) & (rate > t.null_rate_floor), finding)


def _negative_finding(t: DetectionThresholds) -> Column:
    past, today = F.col("min_hist_min"), F.col("min")
    text = F.format_string("smallest value is %.2f, it was never below %.2f before", today, past)
    finding = _finding(2, F.lit(NEGATIVE_VALUES), F.lit(HIGH), text, past, today, F.lit(0.0))
    # NULL when there is no earlier value at all, which is no finding.
    return F.when((F.col("day_idx") >= t.min_history_days) & (past >= 0) & (today < 0), finding)


def _mean_finding(t: DetectionThresholds) -> Column:
    z, mean = F.col("mean_z"), F.col("mean")
    gate = (F.col("day_idx") >= t.min_history_days) & (F.col("mean_hist_count") >= t.min_history_days)
    text = F.format_string(
        "daily mean %s to %.2f, from %.2f on average before",
        F.when(z > 0, "increased").otherwise("decreased"), mean, F.col("mean_hist_mean"),
    )
    finding = _finding(3, F.lit(MEAN_SHIFT), severity(z), text, F.col("mean_hist_mean"), mean, F.round(z, 2))
    return F.when(gate & mean.isNotNull() & (F.abs(z) > t.value_z), finding)


def _findings(series: DataFrame, findings: list[Column]) -> DataFrame:
    return (
        series.select("dataset", "day", "column", F.explode(F.array_compact(F.array(*findings))).alias("f"))
        .select("dataset", "day", "column", "f.*", F.lit(None).cast("string").alias("category"))
        .select(*ANOMALY_COLUMNS)
    )


def detect_volume(volume: DataFrame, thresholds: DetectionThresholds = DEFAULTS) -> DataFrame:
    """Days with unusually few or many rows."""
    series = with_history(volume.withColumn("column", F.lit(None).cast("string")), {"rows": "row_count"})
    return _findings(series, [_volume_finding(thresholds)])


def detect_null_rate(columns: DataFrame, thresholds: DetectionThresholds = DEFAULTS) -> DataFrame:
    """Columns whose share of missing values jumped up."""
    series = with_history(columns.filter(F.col("column").isNotNull()), {"null": "null_rate"}, ("column",))
    return _findings(series, [_null_finding(thresholds)])


def detect_negative(columns: DataFrame, thresholds: DetectionThresholds = DEFAULTS) -> DataFrame:
    """Columns that were never negative before and are now."""
    series = with_history(columns.filter(F.col("column").isNotNull()), {"min": "min"}, ("column",))
    return _findings(series, [_negative_finding(thresholds)])


def detect_mean_shift(columns: DataFrame, thresholds: DetectionThresholds = DEFAULTS) -> DataFrame:
    """Columns whose daily mean moved away from the earlier daily means."""
    series = with_history(columns.filter(F.col("column").isNotNull()), {"mean": "mean"}, ("column",))
    return _findings(series, [_mean_finding(thresholds)])


def detect_series(columns: DataFrame, thresholds: DetectionThresholds = DEFAULTS) -> DataFrame:
    """Volume, null rate, negative values and mean shift from one window over all series.

    The series of the table itself is the one with the NULL column.
    """
    values = {"rows": "row_count", "null": "null_rate", "min": "min", "mean": "mean"}
    series = with_history(columns, values, ("column",))
    table = F.col("column").isNull()
    rules = [_null_finding, _negative_finding, _mean_finding]
    findings = [F.when(table, _volume_finding(thresholds))]
    findings += [F.when(~table, rule(thresholds)) for rule in rules]
    return _findings(series, findings)


def share_candidates(categories: DataFrame, limit: float) -> DataFrame:
    """``(dataset, column, key)`` of the categories that can be flagged at all.

    A finding needs a share, or a mean of earlier shares, above the limit, so the category's share is above it on
    some day. A day has at most ``1 / limit`` of these in a column: their number depends on days and columns only.
    """
    return categories.filter(F.col("share") > limit).select("dataset", "column", "key").distinct()


def share_history(categories: DataFrame, thresholds: DetectionThresholds = DEFAULTS) -> DataFrame:
    """``(dataset, day_idx, column, key, share, expected)`` wherever a share can be flagged.

    ``expected`` is the mean share over all earlier days, a day without the category
    counting as 0. Those days are not filled in one by one: after an observed day the sum
    of shares stays the same until the next one, so ``expected`` falls as sum / day_idx
    and exceeds the threshold only up to day sum / threshold. Just these days are made, and only
    for the categories that can be flagged (``share_candidates``).
    """
    limit = thresholds.share_shift
    if limit > 0:
        categories = categories.join(share_candidates(categories, limit), ["dataset", "column", "key"], "left_semi")
    first = max(thresholds.min_history_days, 1)
    past = Window.partitionBy("dataset", "column", "key").orderBy("day_idx")
    runs = (
        categories.withColumn(
            "before",
            F.coalesce(F.sum("share").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        )
        .withColumn("after", F.col("before") + F.col("share"))
        .withColumn("next_idx", F.coalesce(F.lead("day_idx").over(past), F.col("n_days")))
    )
    start = F.greatest(F.col("day_idx") + 1, F.lit(first).cast("bigint"))
    end = F.col("next_idx") - 1
    if limit > 0:
        end = F.least(end, F.ceil(F.col("after") / F.lit(limit)))
    absent = F.transform(
        F.sequence(start, end),
        lambda i: F.struct(i.alias("day_idx"), F.lit(0.0).alias("share"), (F.col("after") / i).alias("expected")),
    )
    seen = F.struct(
        "day_idx", "share", F.when(F.col("day_idx") > 0, F.col("before") / F.col("day_idx")).alias("expected")
    )
    days_of_run = F.when(start <= end, F.concat(F.array(seen), absent)).otherwise(F.array(seen))
    return (
        runs.select("dataset", "column", "key", F.inline(days_of_run))
        .filter(F.col("day_idx") >= first)
        .filter(F.abs(F.col("share") - F.col("expected")) > limit)
    )


def detect_distribution(
    categories: DataFrame,
    volume: DataFrame,
    thresholds: DetectionThresholds = DEFAULTS,
    source: DataFrame | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Categories whose share of the day moved away from their mean share before.

    Categories known by digest are spelled out from ``texts`` (see ``category_texts``) or the ``source`` table;
    without either they are named by their digest.
    """
    calendar = volume.select("dataset", "day_idx", "day")
    found = share_history(categories, thresholds).join(calendar, ["dataset", "day_idx"])
    if texts is not None:
        found = with_known_text(texts, found)
    elif source is not None:
        found = with_category_text(source, found)
    else:
        found = found.withColumn("category", F.col("key"))
    share, expected = F.col("share"), F.col("expected")
    size = F.abs(share - expected)
    text = F.format_string(
        "share of '%s' %s to %.1f%%, from %.1f%% on average before",
        F.col("category"), F.when(share > expected, "increased").otherwise("decreased"),
        share * 100, expected * 100,
    )
    return found.select(
        "dataset",
        "day",
        F.lit(4).alias("detector_ord"),
        F.lit(DISTRIBUTION_SHIFT).alias("type"),
        F.when(size < thresholds.share_shift_high, MEDIUM).otherwise(HIGH).alias("severity"),
        "column",
        "category",
        text.alias("message"),
        (expected * 100).alias("expected"),
        (share * 100).alias("actual"),
        F.lit(0.0).alias("z_score"),
    )


def detect_all(
    daily: DailyProfile,
    thresholds: DetectionThresholds = DEFAULTS,
    source: DataFrame | None = None,
) -> DataFrame:
    """The findings of all five detectors. Sort with :func:`in_report_order`.

    The share threshold is always the default one here; only ``detect_distribution``
    takes another. Long categories are spelled out from the daily profile; ``source`` serves profiles without texts.
    """
    found = detect_series(daily.columns, thresholds)
    if daily.categories is None:
        return found
    fixed_share = DetectionThresholds(min_history_days=thresholds.min_history_days)
    return found.unionByName(detect_distribution(daily.categories, daily.volume, fixed_share, source, daily.texts))


def in_report_order(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy("dataset", "day", "detector_ord", "column", "category")


def column_label(column: Column, category: Column) -> Column:
    """``column:category`` for a category, else the column alone."""
    return F.when(category.isNull(), column).otherwise(F.concat_ws(":", column, category))
