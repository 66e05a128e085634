"""Compare a current profile with a baseline profile.

Everything here works on profiles: one row per table and one per column. Statistics are
compared as profiled, that is rounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.operators.profile import TableSummary
from rowhelm.types import HIGH, MEDIUM, ComparisonThresholds

DEFAULTS = ComparisonThresholds()

COMPARED = ["position", "null_percent", "mean", "min_value", "unique_count"]
CHANGE_COLUMNS = [
    "dataset", "position", "rule", "type", "column", "baseline", "current",
    "change", "change_percent", "severity",
]


def _change(
    rule: int,
    kind: str,
    severity: Column | str,
    baseline: Column | None = None,
    current: Column | None = None,
    change: Column | None = None,
    change_percent: Column | None = None,
) -> Column:
    def number(value: Column | None) -> Column:
        return F.lit(None).cast("double") if value is None else value.cast("double")

    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(kind).alias("type"),
        number(baseline).alias("baseline"),
        number(current).alias("current"),
        number(change).alias("change"),
        number(change_percent).alias("change_percent"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
    )


def _relative(current: Column, baseline: Column) -> Column:
    return F.when(baseline != 0, (current - baseline) / F.abs(baseline))


def compare_row_count(
    current: DataFrame, baseline: DataFrame, thresholds: ComparisonThresholds = DEFAULTS
) -> DataFrame:
    """Row count change from two ``table`` profiles of one row each."""
    sides = current.select("dataset", F.col("row_count").alias("cur"), F.lit(None).cast("bigint").alias("base"))
    sides = sides.unionByName(
        baseline.select(
            F.lit(None).cast("string").alias("dataset"),
            F.lit(None).cast("bigint").alias("cur"),
            F.col("row_count").alias("base"),
        )
    )
    return _row_changes(sides.agg(F.max("dataset").alias("dataset"), F.max("cur").alias("cur"), F.max("base").alias("base")), thresholds)


def _row_changes(both: DataFrame, thresholds: ComparisonThresholds) -> DataFrame:
    change = F.when(F.col("base") > 0, (F.col("cur") - F.col("base")) / F.col("base"))
    severity = F.when(F.abs(change) > thresholds.row_count_high, HIGH).otherwise(MEDIUM)
    return (
        both.filter(F.abs(change) > thresholds.row_count)
        .select(
            "dataset",
            F.lit(-1).cast("bigint").alias("position"),
            F.lit(None).cast("string").alias("column"),
            F.inline(
                F.array(
                    _change(
                        0, "row_count_change", severity, F.col("base"), F.col("cur"),
                        change_percent=F.round(change * 100, 2),
                    )
                )
            ),
        )
        .select(*CHANGE_COLUMNS)
    )


def _paired(current: DataFrame, baseline: DataFrame) -> DataFrame:
    def side(columns: DataFrame, prefix: str) -> DataFrame:
        return columns.select(
            "column",
            F.col("dataset").alias(f"{prefix}_dataset"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in COMPARED],
        )

    both = side(current, "cur").join(side(baseline, "base"), "column", "full_outer")
    # A missing column has no current row, but its change belongs to the current dataset too.
    table = Window.partitionBy(F.lit(1))  # one row per column of the table
    return both.withColumn("cur_dataset", F.max("cur_dataset").over(table))


def _schema_rules() -> list[Column]:
    only_current, only_baseline = F.col("base_position").isNull(), F.col("cur_position").isNull()
    return [
        F.when(only_current, _change(1, "new_column", MEDIUM)),
        F.when(only_baseline, _change(6, "missing_column", HIGH)),
    ]


def _null_rule(t: ComparisonThresholds) -> Column:
    base, cur = F.col("base_null_percent"), F.col("cur_null_percent")
    change = cur - base
    severity = F.when(change > t.null_rate_high_points, HIGH).otherwise(MEDIUM)
    found = _change(2, "null_rate_change", severity, base, cur, change=F.round(change, 2))
    return F.when(F.abs(change) > t.null_rate * 100, found)


def _mean_rule(t: ComparisonThresholds) -> Column:
    base, cur = F.col("base_mean"), F.col("cur_mean")
    change = _relative(cur, base)
    severity = F.when(F.abs(change) > t.mean_high, HIGH).otherwise(MEDIUM)
    found = _change(3, "mean_change", severity, base, cur, change_percent=F.round(change * 100, 2))
    return F.when(F.abs(change) > t.mean, found)


def _negative_rule(t: ComparisonThresholds) -> Column:
    appeared = (F.col("base_min_value") >= 0) & (F.col("cur_min_value") < 0)
    return F.when(appeared, _change(4, "negative_values_appeared", HIGH, current=F.col("cur_min_value")))


def _unique_rule(t: ComparisonThresholds) -> Column:
    base, cur = F.col("base_unique_count"), F.col("cur_unique_count")
    change = _relative(cur, base)
    found = _change(5, "unique_count_change", MEDIUM, base, cur, change_percent=F.round(change * 100, 2))
    return F.when(F.abs(change) > t.unique_count, found)


def _paired_datasets(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Columns of many datasets side by side, matched by dataset and column."""

    def side(columns: DataFrame, prefix: str) -> DataFrame:
        return columns.select("dataset", "column", *[F.col(c).alias(f"{prefix}_{c}") for c in COMPARED])

    both = side(current, "cur").join(side(baseline, "base"), ["dataset", "column"], "full_outer")
    return both.withColumn("cur_dataset", F.col("dataset")).withColumn("base_dataset", F.col("dataset")).drop("dataset")


def _column_changes(current: DataFrame, baseline: DataFrame, rules: list[Column]) -> DataFrame:
    return _changes_of(_paired(current, baseline), rules)


def _changes_of(paired: DataFrame, rules: list[Column]) -> DataFrame:
    after_all = F.lit(1 << 32)  # missing columns come after the columns of the current table
    return (
        paired.select(
            F.coalesce("cur_dataset", "base_dataset").alias("dataset"),
            F.coalesce("cur_position", F.col("base_position") + after_all).alias("position"),
            "column",
            F.explode(F.array_compact(F.array(*rules))).alias("c"),
        )
        .select("dataset", "position", "column", "c.*")
        .select(*CHANGE_COLUMNS)
    )


def compare_schema(current: DataFrame, baseline: DataFrame) -> DataFrame:
    return _column_changes(current, baseline, _schema_rules())


def compare_null_rate(current: DataFrame, baseline: DataFrame, thresholds: ComparisonThresholds = DEFAULTS) -> DataFrame:
    return _column_changes(current, baseline, [_null_rule(thresholds)])


def compare_mean(current: DataFrame, baseline: DataFrame, thresholds: ComparisonThresholds = DEFAULTS) -> DataFrame:
    return _column_changes(current, baseline, [_mean_rule(thresholds)])


def compare_negative(current: DataFrame, baseline: DataFrame, thresholds: ComparisonThresholds = DEFAULTS) -> DataFrame:
    return _column_changes(current, baseline, [_negative_rule(thresholds)])


def compare_unique_count(current: DataFrame, baseline: DataFrame, thresholds: ComparisonThresholds = DEFAULTS) -> DataFrame:
    return _column_changes(current, baseline, [_unique_rule(thresholds)])


def compare_profiles(
    current: TableSummary, baseline: TableSummary, thresholds: ComparisonThresholds = DEFAULTS
) -> DataFrame:
    """All changes. Sorted by ``position`` and ``rule`` they read: row count, the columns
    of the current table in order, then the missing columns."""
    return compare_row_count(current.table, baseline.table, thresholds).unionByName(
        _column_changes(current.columns, baseline.columns, _all_rules(thresholds))
    )


def _all_rules(thresholds: ComparisonThresholds) -> list[Column]:
    return _schema_rules() + [rule(thresholds) for rule in (_null_rule, _mean_rule, _negative_rule, _unique_rule)]


def together(profiles: Sequence[TableSummary]) -> TableSummary:
    """The profiles of many datasets as one, told apart by ``dataset``."""
    return TableSummary(reduce(DataFrame.unionByName, [p.table for p in profiles]), reduce(DataFrame.unionByName, [p.columns for p in profiles]))


def compare_datasets(
    current: TableSummary,
    baseline: TableSummary,
    pairs: dict[str, str] | None = None,
    thresholds: ComparisonThresholds = DEFAULTS,
) -> DataFrame:
    """All changes of many datasets at once, each against its own baseline.

    ``pairs`` names the baseline of each current dataset; without it, datasets of the same name are paired.
    Datasets without a partner are not compared. Beside the columns of ``compare_profiles`` there are the
    ``baseline_dataset`` and ``compared_at``.
    """
    if pairs is not None:
        if not pairs:
            raise ValueError("no pairs to compare")
        named = {base: F.array(*[F.lit(c) for c, b in pairs.items() if b == base]) for base in dict.fromkeys(pairs.values())}
        names = F.create_map(*[x for base, currents in named.items() for x in (F.lit(base), currents)])
        renamed = lambda df: df.withColumn("dataset", F.explode(names[F.col("dataset")]))
        baseline = TableSummary(renamed(baseline.table), renamed(baseline.columns))
    tables = current.table.select("dataset", F.col("row_count").alias("cur")).join(baseline.table.select("dataset", F.col("row_count").alias("base")), "dataset")
    both = tables.select("dataset")
    paired = _paired_datasets(current.columns.join(both, "dataset", "left_semi"), baseline.columns.join(both, "dataset", "left_semi"))
    found = _row_changes(tables, thresholds).unionByName(_changes_of(paired, _all_rules(thresholds)))
    base_name = F.col("dataset") if pairs is None else F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[F.col("dataset")]
    return found.withColumn("baseline_dataset", base_name).withColumn("compared_at", F.current_timestamp())


def has_significant_changes(changes: DataFrame) -> DataFrame:
    """One row: ``(changes, has_changes)``."""
    return changes.agg(F.count(F.lit(1)).alias("changes")).withColumn("has_changes", F.col("changes") > 0)
