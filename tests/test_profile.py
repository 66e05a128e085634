"""Profiles, exact quantiles and comparisons."""

import random
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowhelm.operators import compare, profile, rules
from rowhelm.operators.frequency import top_values, value_frequency
from rowhelm.operators.quantiles import exact_quantiles
from rowhelm.plans import reports


def columns_of(df, **kwargs):
    return {r["column"]: r.asDict() for r in profile.column_profile(df, **kwargs).collect()}


def test_numeric_golden(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 10)], "x int")
    row = columns_of(df)["x"]
    assert [row[c] for c in ("percentile_25", "percentile_50", "percentile_75", "mean", "std")] == [2, 3, 4, 4, 3.5355]


def test_column_profile_by_type(spark):
    rows = [
        (1, "aé", datetime(2024, 1, 1, 23), True, float("nan"), [1, 2], None),
        (None, "b", datetime(2024, 1, 2, 1), False, 2.0, [1, 2], None),
        (3, "b", None, True, None, None, None),
    ]
    df = spark.createDataFrame(rows, "a int, s string, t timestamp_ntz, f boolean, d double, l array<int>, e double")
    p = columns_of(df)
    assert (p["a"]["count"], p["a"]["null_count"], p["a"]["null_percent"]) == (3, 1, 33.33)
    assert (p["d"]["null_count"], p["d"]["mean"], p["d"]["std"]) == (2, 2.0, None)
    assert p["e"]["mean"] is None and p["e"]["percentile_50"] is None and p["e"]["null_percent"] == 100.0
    assert (p["s"]["unique_count"], p["s"]["unique_percent"], p["s"]["avg_length"]) == (2, 66.67, 1.33)
    assert [tuple(v) for v in p["s"]["top_values"]] == [("b", 2), ("aé", 1)]
    assert [tuple(v) for v in p["f"]["top_values"]] == [("true", 2), ("false", 1)]
    assert p["l"]["unique_count"] == 1
    assert p["t"]["date_range_days"] == 0 and p["t"]["min_date"].startswith("2024-01-01 23:00:00")
    table = profile.table_profile(df, "t").first()
    assert (table["row_count"], table["column_count"], table["total_null_cells"]) == (3, 7, 8)
    assert round(table["null_cell_percent"], 4) == round(8 / 21 * 100, 4)
    lines = {r["column"]: r["stats"] for r in reports.profile_report(profile.column_profile(df, "t")).collect()}
    assert lines["e"] == "-" and lines["t"] == "2024-01-01 to 2024-01-02" and lines["d"].startswith("mean 2.00, 2.00")


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, s string, t date")
    table = profile.table_profile(df).first()
    assert (table["row_count"], table["null_cell_percent"], table["duplicate_rows"], table["est_bytes"]) == (0, 0, 0, 0)
    assert all(r["null_percent"] == 0 for r in columns_of(df).values())


def test_duplicates(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (1, "y")], "a int, b string")
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 1
    assert profile.duplicate_rows(df.unionAll(df)).first()["duplicate_rows"] == 3 + 1
    tricky = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a|2:bc", None), (None, "null"), ("null", None)], "a string, b string")
    assert profile.duplicate_rows(tricky).first()["duplicate_rows"] == 0
    doubles = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "a double")
    assert profile.duplicate_rows(doubles).first()["duplicate_rows"] == 2


def test_long_values_are_counted_by_digest_and_spelled_out(spark):
    long_text, other = "x" * 5000, "x" * 4999 + "y"
    df = spark.createDataFrame([(long_text, "k")] * 7 + [(other, "k")] * 3 + [("short", None)], "a string, b string")
    keys = [r["key"] for r in value_frequency(df, ["a", "b"]).collect()]
    assert max(map(len, keys)) == 71
    top = {(r["column"], r["rank"]): (r["value"], r["cnt"]) for r in top_values(df, ["a", "b"]).collect()}
    assert top == {("a", 1): (long_text, 7), ("a", 2): (other, 3), ("a", 3): ("short", 1), ("b", 1): ("k", 10)}


def _nasty_values(rng, n):
    values = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            values.append(struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0])
        elif kind < 0.6:
            values.append(rng.choice([-1, 1]) * 2.0 ** rng.randint(-1074, 1000) * (1 + rng.choice([0, 0, -1, 1]) * 2**-52))
        elif kind < 0.7:
            values.append(rng.choice([0.0, -0.0, 1.0, 1.0, 5e-324]))
        else:
            values.append(1.7e9 + rng.random() * 1000)
    return [v for v in values if v == v and abs(v) < 1e300]


@pytest.mark.parametrize("seed", range(2))
def test_quantiles_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    table = {"nasty": _nasty_values(rng, 3000), "prices": [round(rng.uniform(0, 500), 2) for _ in range(2000)]}
    table["one_hot"] = [7.0] * 900 + [rng.random() for _ in range(100)]
    table["single"] = [3.25]
    rows = [(name, v) for name, values in table.items() for v in values]
    df = spark.createDataFrame(rows, "name string, v double").select(
        *[F.when(F.col("name") == name, F.col("v")).alias(name) for name in table]
    )
    levels = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["column"], r["probability"]): r["value"] for r in exact_quantiles(df, list(table), levels).collect()}
    for name, values in table.items():
        for p, expected in zip(levels, np.quantile(values, levels)):
            assert got[name, p] == pytest.approx(expected, rel=1e-12)


def summary(spark, row_count=100, **columns):
    """A profile given by hand: column -> (null_percent, mean, min_value, unique_count)."""
    table = spark.createDataFrame([("t", row_count)], "dataset string, row_count bigint")
    rows = [("t", i, name, *stats) for i, (name, stats) in enumerate(columns.items())]
    schema = "dataset string, position bigint, column string, null_percent double, mean double, min_value double, unique_count bigint"
    return profile.TableSummary(table, spark.createDataFrame(rows, schema))


def changes(current, baseline):
    frame = compare.compare_profiles(current, baseline).orderBy("position", "rule")
    return [(r["type"], r["column"], r["severity"], r["change"], r["change_percent"]) for r in frame.collect()]


PLAIN = {"a": (0.0, None, None, None)}


@pytest.mark.parametrize("rows, severity", [(120, None), (121, "medium"), (150, "medium"), (151, "high"), (79, "medium"), (49, "high")])
def test_row_count_change(spark, rows, severity):
    got = changes(summary(spark, rows, **PLAIN), summary(spark, 100, **PLAIN))
    expected = [("row_count_change", None, severity, None, float(rows - 100))] if severity else []
    assert got == expected


def test_row_count_change_from_nothing_is_silent(spark):
    assert changes(summary(spark, 5, **PLAIN), summary(spark, 0, **PLAIN)) == []


@pytest.mark.parametrize("base, cur, severity", [(0.0, 5.0, None), (0.0, 5.01, "medium"), (0.0, 10.5, "high"), (30.0, 0.0, "medium")])
def test_null_rate_change(spark, base, cur, severity):
    got = changes(summary(spark, a=(cur, None, None, None)), summary(spark, a=(base, None, None, None)))
    assert got == ([("null_rate_change", "a", severity, round(cur - base, 2), None)] if severity else [])


@pytest.mark.parametrize(
    "base, cur, expected",
    [
        ((-10.0, -20.0), (-12.0, -20.0), [("mean_change", "medium", -20.0)]),
        ((10.0, 1.0), (14.0, 1.0), [("mean_change", "high", 40.0)]),
        ((10.0, 1.0), (11.0, 1.0), []),
        ((0.0, 0.0), (-1.0, -1.0), [("negative_values_appeared", "high", None)]),
        ((10.0, 1.0), (10.0, -1.0), [("negative_values_appeared", "high", None)]),
        ((-1.0, -1.0), (-1.0, -5.0), []),
    ],
)
def test_numeric_changes(spark, base, cur, expected):
    got = changes(summary(spark, a=(0.0, *cur, None)), summary(spark, a=(0.0, *base, None)))
    assert [(t, s, p) for t, _, s, _, p in got] == expected


@pytest.mark.parametrize("base, cur, hit", [(10, 12, False), (10, 13, True), (10, 7, True), (0, 5, False)])
def test_unique_count_change(spark, base, cur, hit):
    got = changes(summary(spark, a=(0.0, None, None, cur)), summary(spark, a=(0.0, None, None, base)))
    assert [g[0] for g in got] == (["unique_count_change"] if hit else [])


def test_schema_drift_and_order(spark):
    none = (0.0, None, None, None)
    current = summary(spark, 200, a=(50.0, None, None, None), c=none)
    baseline = summary(spark, 100, b=none, a=none)
    assert [(t, c, s) for t, c, s, *_ in changes(current, baseline)] == [
        ("row_count_change", None, "high"),
        ("null_rate_change", "a", "high"),
        ("new_column", "c", "medium"),
        ("missing_column", "b", "high"),
    ]
    lines = reports.compare_report(compare.compare_profiles(current, baseline)).orderBy("position", "rule").collect()
    assert [(r["column"], r["change"], r["severity"]) for r in lines][0] == ("-", "100.00%", "HIGH")
    assert compare.has_significant_changes(compare.compare_profiles(current, current)).first()["has_changes"] is False


def test_profile_equals_itself(spark):
    df = spark.createDataFrame([(i, str(i % 3), i / 7) for i in range(50)], "a int, b string, c double")
    p = profile.profile(df)
    assert compare.compare_profiles(p, p).count() == 0


def test_quality_issues(spark):
    df = spark.createDataFrame([(1, None), (1, None), (-3, "x"), (4, "y")], "a int, b string")
    got = {(r["column"], r["issue"]): r["value"] for r in rules.quality_issues([profile.profile(df, "t")]).collect()}
    assert got == {
        (None, "high_null_rate"): 25.0,
        (None, "duplicate_rows"): 1.0,
        ("b", "column_null_rate"): 50.0,
        ("a", "negative_values"): -3.0,
    }
