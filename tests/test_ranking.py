"""Top values whose ties are settled by the values themselves, stored category texts, pruned share histories."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rowhelm.operators import ranking
from rowhelm.operators.daily import daily_category_share, daily_profile, daily_volume
from rowhelm.operators.detect import detect_all, detect_distribution, share_candidates, share_history
from rowhelm.operators.profile import column_profile
from rowhelm.sources.tables import load_daily, save_daily
from rowhelm.types import DetectionThresholds


def expected(values, k):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k]


def long_values(seed):
    rng = random.Random(seed)
    heads = ["", "é" * 40, "a" * 63, "a" * 64, "a" * 65, "same head " * 30, "same head " * 300]
    values = []
    for _ in range(120):
        values += [rng.choice(heads) + rng.choice(["", "b", "B", "ü", "z" * 500, "z" * 499 + "y"]) + rng.choice(["", "1", "22"])] * rng.choice([1, 1, 1, 2])
    return values + [None] * 3


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("k", [1, 5, 9])
def test_ties_are_in_the_order_of_the_values(spark, seed, k):
    values = long_values(seed)
    rows = [(v, "k" if i % 2 else None) for i, v in enumerate(values)]
    found = defaultdict(list)
    for row in ranking.exact_top_values(spark.createDataFrame(rows, "a string, b string").repartition(5), ["a", "b"], k).orderBy("column", "rank").collect():
        found[row["column"]].append((row["value"], row["cnt"]))
    assert found == {"a": expected(values, k), "b": expected([b for _, b in rows], k)}


def test_distinct_long_values_that_share_a_long_beginning(spark):
    values = ["x" * 10_000 + f"{i:03d}" + "y" * 2000 for i in range(300)]
    df = spark.createDataFrame([(v,) for v in reversed(values)], "a string")
    assert [r["value"] for r in ranking.exact_top_values(df, ["a"]).orderBy("rank").collect()] == values[:5]
    top = column_profile(df).first()
    assert [v["value"] for v in top["top_values"]] == values[:5] and top["unique_count"] == 300


def test_no_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "a string")
    assert ranking.exact_top_values(df, ["a"]).count() == 0
    assert ranking.exact_top_values(df.limit(0), ["a"]).count() == 0
    assert column_profile(df).first()["top_values"] is None


def kinds(spark, n_days=12, name=lambda k: k):
    rng = random.Random(5)
    rows = []
    for day in range(n_days):
        weights = [1, 1, 1, rng.random() * 3, 6 * (day == 8)]
        for kind in rng.choices("abcde", weights, k=60):
            rows.append((date(2024, 1, 1) + timedelta(days=day + day // 5), name(kind), f"once {len(rows)}"))
    return spark.createDataFrame(rows, "day date, kind string, note string")


@pytest.mark.parametrize("limit", [0.0, 0.02, 0.1, 0.3])
def test_pruned_history_equals_the_whole_one(spark, limit):
    df = kinds(spark)
    volume = daily_volume(df, "day")
    shares = daily_category_share(df, "day", volume=volume)
    found = {(r["column"], r["key"], r["day_idx"]): (round(r["share"], 9), round(r["expected"], 9)) for r in share_history(shares, DetectionThresholds(share_shift=limit)).collect()}
    dense = defaultdict(dict)
    for r in shares.collect():
        dense[r["column"], r["key"]][r["day_idx"]] = r["share"]
    whole = {}
    for key, own in dense.items():
        for day in range(5, 12):
            share, mean = own.get(day, 0.0), sum(own.get(d, 0.0) for d in range(day)) / day
            if abs(share - mean) > limit:
                whole[(*key, day)] = (round(share, 9), round(mean, 9))
    assert found == whole
    if limit:
        days = df.select("day").distinct().count()
        assert share_candidates(shares, limit).groupBy("column").count().agg(F.max("count")).first()[0] <= days / limit


def test_only_candidates_reach_the_window(spark):
    df = kinds(spark)
    shares = daily_category_share(df, "day", ["note", "kind"])
    found = share_history(shares)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    window = plan.index("Window ")
    assert 0 < window < plan.index("LeftSemi")  # the join is below the window


def test_category_texts_survive_storing(spark, tmp_path):
    long_name = lambda k: f"kind {k} " + "described at length " * 10
    df = kinds(spark, name=long_name)
    daily = daily_profile(df, "day", name="events")
    path = str(tmp_path / "daily")
    save_daily(daily, path)
    loaded = load_daily(spark, path)
    fresh = {tuple(r) for r in detect_all(daily).collect()}
    assert fresh == {tuple(r) for r in detect_all(loaded).collect()} == {tuple(r) for r in detect_all(daily, source=df).collect()}
    named = {r[6] for r in fresh if r[6] is not None}
    assert named and named <= {long_name(k) for k in "abcde"}
    texts = loaded.texts.count()
    assert texts == 5
    save_daily(daily, path, "append")  # a dictionary grows by new texts only
    assert load_daily(spark, path).texts.count() == texts
    other = daily_profile(kinds(spark, name=lambda k: "other " + long_name(k)), "day", name="events")
    save_daily(other, path, "append")
    assert load_daily(spark, path).texts.count() == 2 * texts


def test_digests_stay_without_texts(spark):
    df = kinds(spark, name=lambda k: k * 80)
    volume = daily_volume(df, "day")
    found = detect_distribution(daily_category_share(df, "day", volume=volume), volume)
    assert {r["category"][:7] for r in found.collect()} == {"sha256:"}
