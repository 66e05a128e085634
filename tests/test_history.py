"""Mergeable daily states: appended, late and replaced days against the whole table computed at once."""

import math
import random
from datetime import date, timedelta

import pytest

from rowhelm.operators import history
from rowhelm.operators.daily import daily_columns, daily_volume
from rowhelm.operators.detect import detect_series

START = date(2024, 1, 1)


def table(spark, n_days=10, seed=1, faulty=8):
    rng = random.Random(seed)
    rows = []
    for day in range(n_days):
        for k in range(40 + rng.randrange(6) + 100 * (day == faulty)):
            x = None if rng.random() < (0.3 if day == faulty else 0.02) else rng.gauss(50 + 30 * (day == faulty), 1) - 200 * (day == faulty and k == 0)
            rows.append((START + timedelta(days=day), x, rng.choice(["a", "b", None]), float("nan") if k == 3 else 1e9 + rng.random(), rng.randrange(500)))
    return spark.createDataFrame(rows, "day date, x double, kind string, big double, code int")


def cells(df):
    rows = []
    for r in df.collect():
        rows.append(tuple(None if v is None else float(f"{v:.6g}") if isinstance(v, float) else v for v in r))
    return sorted(rows, key=str)


def plain(df, name="shop"):
    return daily_columns(df, "day", name=name, with_table_row=True)


def same(spark, state, df):
    profile = history.profile_of_state(state)
    assert cells(profile.volume) == cells(daily_volume(df, "day", "shop"))
    assert cells(profile.columns) == cells(plain(df).select(*profile.columns.columns))
    assert cells(detect_series(profile.columns)) == cells(detect_series(plain(df)))


def test_merged_states_equal_the_whole_table(spark):
    df = table(spark)
    parts = df.randomSplit([0.5, 0.3, 0.2], seed=3)
    state = history.merge_states(*[history.daily_state(p, "day", "shop") for p in parts])
    same(spark, state, df)
    assert detect_series(history.profile_of_state(state).columns).count() > 0
    assert history.daily_state(df.limit(0), "day").count() == 0


def test_days_are_appended_replaced_and_filled_up(spark, tmp_path):
    path = str(tmp_path / "state")
    df = table(spark)
    cut = START + timedelta(days=7)
    first, second = df.filter(df["day"] < cut), df.filter(df["day"] >= cut)
    history.append_days(first, "day", path, "shop")
    history.append_days(second.filter(second["code"] < 100), "day", path, "shop")  # a load that broke off
    history.append_days(second, "day", path, "shop")  # again, whole
    history.append_days(first.limit(0), "day", path, "shop")
    same(spark, history.load_state(spark, path), df)
    late = table(spark, n_days=2, seed=5, faulty=99)
    history.append_days(late, "day", path, "shop", late=True)
    same(spark, history.load_state(spark, path), df.unionByName(late))
    history.append_days(late, "day", path, "other")
    assert history.load_state(spark, path).filter("dataset = 'shop' and column is null").count() == 10


def test_sketches_of_days_are_those_of_the_month(spark):
    n = 60_000
    rng = random.Random(2)
    values = [rng.lognormvariate(0, 2) for _ in range(n)]
    df = spark.createDataFrame([(START + timedelta(days=k % 30), v, str(k % 7000)) for k, v in enumerate(values)], "day date, x double, name string")
    wanted = [0.01, 0.25, 0.5, 0.9, 0.99]
    found = {r["column"]: r for r in history.approximate_statistics(history.daily_state(df, "day"), wanted).collect()}
    assert found["name"]["quantiles"] is None and found["name"]["filled"] == n
    error = 1.04 / 2 ** (history.HLL_LOG2 / 2)
    assert abs(found["name"]["unique_count"] / 7000 - 1) < 3 * error
    assert abs(found["x"]["unique_count"] / len(set(values)) - 1) < 3 * error
    ordered = sorted(values)
    for p, value in zip(wanted, found["x"]["quantiles"]):
        rank = sum(v <= value for v in ordered) / n
        assert abs(rank - p) < 0.02


@pytest.mark.parametrize("parts", [1, 5])
def test_moments_don_t_cancel_out(spark, parts):
    rows = [(START, 1e12 + k) for k in range(100)]
    df = spark.createDataFrame(rows, "day date, x double")
    loads = [df.filter(f"cast(x as bigint) % {parts} = {k}") for k in range(parts)]
    columns = history.profile_of_state(history.merge_states(*[history.daily_state(p, "day") for p in loads])).columns
    assert math.isclose(columns.filter("column = 'x'").first()["std"], 29.011491975882016, rel_tol=1e-6)
