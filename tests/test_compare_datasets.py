"""Comparison of many datasets at once."""

from rowhelm.operators.compare import compare_datasets, compare_profiles, together
from rowhelm.operators.profile import COMPARED_STATISTICS, profile


def summary(spark, name, rows, columns="x double, kind string"):
    return profile(spark.createDataFrame(rows, columns), name, COMPARED_STATISTICS)


def test_each_dataset_has_its_own_baseline(spark):
    low = [(1.0 + k % 2, "a") for k in range(10)]
    high = [(100.0 + k % 2, "b") for k in range(10)]
    a, b = summary(spark, "a", low), summary(spark, "b", high)
    both = together([a, b])
    assert compare_datasets(both, both).count() == 0  # not compared across datasets
    a_now = summary(spark, "a_now", [(x * 2, "a") for x, _ in low] * 2)
    b_now = summary(spark, "b_now", [(x,) for x, _ in high], "x double")
    pairs = {"a_now": "a", "b_now": "b", "again": "a"}
    found = compare_datasets(together([a_now, b_now, summary(spark, "left out", low)]), both, pairs).collect()
    got = {(r["dataset"], r["baseline_dataset"], r["type"], r["column"]) for r in found}
    assert got == {("a_now", "a", "row_count_change", None), ("a_now", "a", "mean_change", "x"), ("b_now", "b", "missing_column", "kind")}
    assert all(r["compared_at"] is not None for r in found)
    alone = {tuple(r)[1:] for r in compare_profiles(a_now, a).collect()}
    assert {tuple(r[c] for c in compare_profiles(a_now, a).columns)[1:] for r in found if r["dataset"] == "a_now"} == alone


def test_one_baseline_may_serve_many(spark):
    rows = [(1.0, "a"), (2.0, "b")]
    base = summary(spark, "base", rows)
    now = together([summary(spark, "one", rows), summary(spark, "two", [(5.0, "a"), (6.0, "b")])])
    found = compare_datasets(now, base, {"one": "base", "two": "base"}).collect()
    assert [(r["dataset"], r["type"], r["column"]) for r in found] == [("two", "mean_change", "x")]
