"""Detectors on hand-computed histories and against brute force."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rowhelm.operators import detect
from rowhelm.operators.daily import DailyProfile, daily_category_share, daily_profile, daily_volume, day_records
from rowhelm.sources.tables import load_daily, save_daily
from rowhelm.types import DetectionThresholds

START = datetime.date(2024, 1, 1)


def day(i):
    return START + datetime.timedelta(days=i)


def volume_frame(spark, counts):
    rows = [("t", day(i), i, c) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "dataset string, day date, day_idx bigint, row_count bigint")


def column_frame(spark, values, field):
    rows = []
    for i, v in enumerate(values):
        row = {"null_rate": 0.0, "mean": None, "min": None}
        row[field] = v
        rows.append(("t", day(i), i, "x", 100, row["null_rate"], row["mean"], row["min"]))
    return spark.createDataFrame(
        rows,
        "dataset string, day date, day_idx bigint, column string, row_count bigint, null_rate double, mean double, min double",
    )


def found(frame):
    return [(r["day"], r["type"], r["severity"], r["z_score"]) for r in frame.orderBy("day").collect()]


def test_volume_drop(spark):
    row = detect.detect_volume(volume_frame(spark, [100, 102, 98, 101, 99, 50])).first()
    assert (row["type"], row["severity"], row["z_score"]) == ("volume_drop", "critical", -35.36)
    assert (row["expected"], row["actual"], row["column"]) == (100.0, 50.0, None)
    assert "50" in row["message"]


def test_volume_spike(spark):
    assert found(detect.detect_volume(volume_frame(spark, [100, 102, 98, 101, 99, 104])))[0][1:3] == ("volume_spike", "medium")


@pytest.mark.parametrize("counts", [[100] * 5 + [50], [100, 102, 98, 101, 50], [100, 102, 98, 101, 99, 101]])
def test_volume_silent(spark, counts):
    assert found(detect.detect_volume(volume_frame(spark, counts))) == []


@pytest.mark.parametrize(
    "rates, expected",
    [
        ([0, 1, 0, 1, 0, 20], [(day(5), "null_rate_increase", "critical", 40.01)]),
        ([0, 0, 0, 0, 0, 20], []),
        ([0.1, 0.2, 0.1, 0.2, 0.1, 1.0], []),
        ([20, 21, 20, 21, 20, 0], []),
    ],
)
def test_null_rate(spark, rates, expected):
    frame = column_frame(spark, [float(r) for r in rates], "null_rate")
    assert found(detect.detect_null_rate(frame)) == expected


@pytest.mark.parametrize(
    "means, expected",
    [
        ([10, 11, 9, 10, 10, 12], [(day(5), "mean_shift", "high", 3.16)]),
        ([None, 11, 9, 10, 10, 12], []),  # only four days with a mean
        ([None, 10, 11, 9, 10, 10, 12], [(day(6), "mean_shift", "high", 3.16)]),
    ],
)
def test_mean_shift(spark, means, expected):
    frame = column_frame(spark, [None if m is None else float(m) for m in means], "mean")
    assert found(detect.detect_mean_shift(frame)) == expected


@pytest.mark.parametrize(
    "mins, days",
    [
        ([1, 2, 0, 3, 1, -0.5], [5]),
        ([1, 2, 0, 3, 1, -0.5, -3], [5]),
        ([1, -2, 0, 3, 1, -0.5], []),
        ([None, None, None, None, 1, -1], [5]),
        ([None, None, None, None, None, -1], []),
        ([1, 1, -1, 1, 1, 1], []),
    ],
)
def test_negative_values(spark, mins, days):
    frame = column_frame(spark, [None if m is None else float(m) for m in mins], "min")
    assert found(detect.detect_negative(frame)) == [(day(d), "negative_values", "high", 0.0) for d in days]


def rows_of_days(shares_per_day):
    """Rows with the given category counts per day; None stands for missing values."""
    rows = []
    for i, counts in enumerate(shares_per_day):
        for category, n in counts.items():
            rows += [(day(i), category)] * n
    return rows


def distribution(spark, counts, thresholds=DetectionThresholds()):
    df = spark.createDataFrame(rows_of_days(counts), "ts date, kind string")
    volume = daily_volume(df, "ts")
    frame = detect.detect_distribution(daily_category_share(df, "ts", volume=volume), volume, thresholds, source=df)
    return {
        (r["day"], r["category"]): (r["severity"], round(r["expected"], 6), round(r["actual"], 6))
        for r in frame.collect()
    }


@pytest.mark.parametrize(
    "history, today, expected",
    [
        ([{"A": 5, "B": 5}] * 5, {"A": 7, "B": 3}, {"A": ("medium", 50.0, 70.0), "B": ("medium", 50.0, 30.0)}),
        ([{"A": 5, "B": 5}] * 5, {"A": 8, "B": 2}, {"A": ("high", 50.0, 80.0), "B": ("high", 50.0, 20.0)}),
        ([{"A": 5}] * 5, {"A": 8, "C": 2}, {"A": ("medium", 100.0, 80.0), "C": ("medium", 0.0, 20.0)}),
        ([{"A": 5}] * 2 + [{None: 5}] + [{"A": 5}] * 2, {"A": 5}, {"A": ("medium", 80.0, 100.0)}),
        ([{"A": 5}] * 5, {None: 5}, {"A": ("high", 100.0, 0.0)}),
    ],
)
def test_distribution(spark, history, today, expected):
    assert distribution(spark, history + [today]) == {(day(5), c): v for c, v in expected.items()}


def brute_distribution(counts, thresholds):
    shares = []
    for per_day in counts:
        filled = sum(n for c, n in per_day.items() if c is not None)
        shares.append({c: n / filled for c, n in per_day.items() if c is not None})
    result = {}
    for i, today in enumerate(shares):
        if i < max(thresholds.min_history_days, 1):
            continue
        for c in set(today).union(*shares[:i]):
            expected = statistics.fmean(s.get(c, 0.0) for s in shares[:i])
            size = abs(today.get(c, 0.0) - expected)
            if size > thresholds.share_shift:
                level = "medium" if size < thresholds.share_shift_high else "high"
                result[(day(i), c)] = (level, round(expected * 100, 6), round(today.get(c, 0.0) * 100, 6))
    return result


@pytest.mark.parametrize("seed", range(4))
def test_distribution_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    counts = []
    for _ in range(40):
        chosen = rng.sample(["a", "b", "c", "d", None, "x" * 100], rng.randint(1, 5))
        counts.append({c: rng.randint(1, 9) for c in chosen})
    thresholds = DetectionThresholds(
        min_history_days=rng.choice([0, 1, 5]), share_shift=[0.15, 0.0, 0.4, 0.07][seed]
    )
    assert distribution(spark, counts, thresholds) == brute_distribution(counts, thresholds)


def test_negative_share_threshold_is_rejected():
    with pytest.raises(ValueError):
        DetectionThresholds(share_shift=-0.1)


def random_table(spark, days, seed=0, parts=8):
    rng = random.Random(seed)
    rows = []
    for i in range(days):
        for _ in range(rng.randint(5, 40)):
            value = None if rng.random() < 0.1 else rng.gauss(10, 6)
            rows.append((day(i), rng.choice("abc"), value, float("nan") if rng.random() < 0.1 else 1.0, rng.choice(["u", None])))
    schema = "ts date, kind string, value double, other double, user_id string"
    return spark.createDataFrame(rows, schema).repartition(parts)


def all_found(df):
    rows = detect.in_report_order(detect.detect_all(daily_profile(df, "ts"), source=df)).collect()
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows]


def test_combined_detector_equals_single_ones(spark):
    df = random_table(spark, 25)
    days = daily_profile(df, "ts")
    single = [
        detect.detect_volume(days.volume),
        detect.detect_null_rate(days.columns),
        detect.detect_negative(days.columns),
        detect.detect_mean_shift(days.columns),
    ]
    rows = sorted(str(r) for f in single for r in f.collect())
    assert rows == sorted(str(r) for r in detect.detect_series(days.columns).collect())


def test_layout_does_not_matter(spark):
    assert all_found(random_table(spark, 25, parts=1)) == all_found(random_table(spark, 25, parts=7))


def test_later_days_do_not_change_earlier_findings(spark):
    df = random_table(spark, 25)
    early = df.filter(F.col("ts") < F.lit(day(15)))
    assert all_found(early) == [row for row in all_found(df) if row[1] < day(15)]


def test_daily_profile_tables(spark):
    df = spark.createDataFrame(
        [
            (day(0), "a", 1.0), (day(0), "a", 3.0), (day(0), None, None), (day(0), "b", float("nan")),
            (day(2), None, None), (None, "z", 9.0),
        ],
        "ts date, kind string, value double",
    )
    days = daily_profile(df, "ts", name="t")
    assert [(r["day"], r["day_idx"], r["row_count"]) for r in days.volume.orderBy("day").collect()] == [(day(0), 0, 4), (day(2), 1, 1)]
    columns = {(r["day_idx"], r["column"]): r for r in days.columns.collect()}
    value = columns[0, "value"]
    assert (value["null_count"], value["null_rate"], value["mean"], value["min"], value["max"]) == (2, 50.0, 2.0, 1.0, 3.0)
    assert round(value["std"], 4) == 1.4142
    assert columns[1, "value"]["mean"] is None and columns[1, "value"]["null_rate"] == 100.0
    shares = {(r["day_idx"], r["key"]): (r["cnt"], r["share"], r["n_days"]) for r in days.categories.collect()}
    assert shares == {(0, "a"): (2, 2 / 3, 2), (0, "b"): (1, 1 / 3, 2)}
    records = day_records(days).collect()
    assert records[0]["means"] == {"value": 2.0} and records[1]["means"] == {}
    assert records[1]["null_rates"] == {"kind": 100.0, "value": 100.0}


def test_column_choices_are_honoured(spark):
    df = random_table(spark, 6)
    days = daily_profile(df, "ts", numeric=["value", "absent"], categorical=[])
    assert days.categories is None
    assert {r["column"] for r in days.columns.filter("mean IS NOT NULL").collect()} == {"value"}


def test_stored_days_give_the_same_findings(spark, tmp_path):
    df = random_table(spark, 20)
    days = daily_profile(df, "ts")
    save_daily(days, str(tmp_path / "days"))
    stored = load_daily(spark, str(tmp_path / "days"))
    assert isinstance(stored, DailyProfile)

    def shown(d):
        return sorted(str(r.asDict()) for r in detect.detect_all(d).select("day", "type", "column", "category", "z_score").collect())

    assert shown(stored) == shown(days)
