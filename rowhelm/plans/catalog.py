"""The registered queries: every operator over the whole test tables.

Faults are planted into ``events`` where an operator looks for something that the tables
do not contain (missing values, newly negative values, drift).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowhelm.functions.scalars import hash_fraction, severity
from rowhelm.operators import compare, daily, detect, enrich, frequency, history, inject, profile, ranking, rules, synth
from rowhelm.operators.daily import daily_profile
from rowhelm.plans import reports, runs
from rowhelm.sources.csv import infer_tables
from rowhelm.sources.dates import find_date_columns, parse_dates_by_name
from rowhelm.sources.tables import read_table
from rowhelm.types import DetectionThresholds, is_datetime, text_columns

Query = Callable[[SparkSession, str], DataFrame]

ALL_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

FIRST_DAY = date(2024, 1, 1)
DROP_DAY, NEGATIVE_DAY, NULL_DAY, SHIFT_DAY = (FIRST_DAY + timedelta(days=d) for d in (10, 15, 20, 25))
FAULTS = {
    DROP_DAY: inject.FAULT_VOLUME_DROP,
    NEGATIVE_DAY: inject.FAULT_NEGATIVE,
    NULL_DAY: inject.FAULT_NULLS,
    SHIFT_DAY: inject.FAULT_CATEGORY_SHIFT,
}
EVENT_TYPES = ["purchase", "click", "view", "signup", "error"]
DRIFT_DAY = date(2024, 1, 16)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _background_nulls() -> Column:
    return (F.dayofmonth("ts") % 3) / F.lit(100.0)


def nulled_events(events: DataFrame) -> DataFrame:
    return inject.inject_nulls(events, "ts", NULL_DAY, "event_id", "user_id", background=_background_nulls())


def faulty_events(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` with all four faults, each on its day."""
    events = nulled_events(read_table(spark, sf, "events"))
    events = inject.inject_negative(events, "ts", NEGATIVE_DAY, "event_id", "value")
    events = inject.inject_category_shift(events, "ts", SHIFT_DAY, "event_id", "event_type", EVENT_TYPES)
    return inject.inject_volume_drop(events, "ts", DROP_DAY, "event_id")


def baseline_and_current(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """First and second half of the month, the second one drifted.

    The baseline is its whole half. The current half has planted drift: lost rows, missing
    users, higher and partly negative values, fewer distinct props, other columns.
    """
    events = read_table(spark, sf, "events")
    later = F.to_date("ts") >= F.lit(DRIFT_DAY)

    def fraction(salt: str) -> Column:
        return hash_fraction(7, salt, F.col("event_id"))

    value = F.when(fraction("negative") < 0.05, -F.col("value")).otherwise(F.col("value") * 1.6)
    current = events.filter(later & (fraction("keep") < 0.4)).select(
        "event_id",
        "ts",
        F.when(fraction("null") >= 0.12, F.col("user_id")).alias("user_id"),
        "event_type",
        value.alias("value"),
        F.concat(F.lit("k"), (F.col("event_id") % 60).cast("string")).alias("props"),
        F.concat("event_type", F.lit("/"), (F.col("event_id") % 3).cast("string")).alias("channel"),
    )
    return events.filter(~later).withColumn("origin", F.col("event_type")), current


def _compared(spark: SparkSession, sf: str) -> tuple[profile.TableSummary, profile.TableSummary]:
    baseline, current = baseline_and_current(spark, sf)
    return (
        profile.profile(current, "current", profile.COMPARED_STATISTICS),
        profile.profile(baseline, "baseline", profile.COMPARED_STATISTICS),
    )


CHANGE_OUT = ["type", "column", "baseline", "current", "change", "change_percent", "severity"]
ANOMALY_OUT = ["day", "type", "severity", "column", "category", "expected", "actual", "z_score"]


def _changes(changes: DataFrame) -> DataFrame:
    return changes.select(*CHANGE_OUT)


def _anomalies(found: DataFrame) -> DataFrame:
    return _rounded(found.select(*ANOMALY_OUT), "expected", "actual")


# ---- loading -------------------------------------------------------------------------


def orders_as_text(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` as a CSV file would bring it: the date is text."""
    return read_table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_totalprice", F.col("o_orderpriority").alias("updated_by"),
    )


def date_parse_by_name(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_dates_by_name(orders_as_text(spark, sf))
    types = dict(parsed.dtypes)
    return parsed.groupBy(F.to_date("o_orderdate").alias("day"), "updated_by").agg(
        F.count(F.lit(1)).alias("cnt")
    ).select(
        "day", "updated_by", "cnt",
        F.lit(types["o_orderdate"] == "timestamp_ntz").alias("date_converted"),
        F.lit(types["updated_by"] == "timestamp_ntz").alias("text_converted"),
    )


def date_column_detect(spark: SparkSession, sf: str) -> DataFrame:
    tables = {n: read_table(spark, sf, n) for n in ALL_TABLES} | {"orders_text": orders_as_text(spark, sf)}
    rows = [(name, found[0]) for name, found in find_date_columns(tables).items()]
    return spark.createDataFrame(rows, "dataset string, date_column string")


def texts_of(df: DataFrame) -> DataFrame:
    """The table as a CSV file would bring it, with texts in all columns."""
    return df.select(*[F.date_format(f.name, "MM/dd/yyyy HH:mm").alias(f.name) if is_datetime(f.dataType) else F.col(f.name).cast("string").alias(f.name) for f in df.schema])


def csv_types(spark: SparkSession, sf: str) -> DataFrame:
    tables = {n: texts_of(read_table(spark, sf, n)) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")}
    rows = [(name, column, *found) for name, columns in infer_tables(tables).items() for column, found in columns.items()]
    return spark.createDataFrame(rows, "dataset string, column string, type string, date_format string")


def dataset_status(spark: SparkSession, sf: str) -> DataFrame:
    loaders = {n: (lambda n=n: read_table(spark, sf, n)) for n in ALL_TABLES}
    return runs.dataset_status(spark, loaders)[0].select("dataset", "status", "date_column", "days")


def daily_null_date_dropped(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events")
    lost = hash_fraction(42, "date", F.col("event_id")) < 0.1
    events = events.withColumn("ts", F.when(~lost, F.col("ts")))
    return daily.daily_volume(events, "ts").select("day", "day_idx", "row_count")


# ---- profiles ------------------------------------------------------------------------


def _named_tables(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return {n: faulty_events(spark, sf) if n == "faulty_events" else read_table(spark, sf, n) for n in names}


def _per_table(spark: SparkSession, sf: str, build: Callable[[DataFrame], DataFrame], *names: str) -> DataFrame:
    tables = _named_tables(spark, sf, *names)
    return _stack([build(df).select(F.lit(n).alias("dataset"), "*") for n, df in tables.items()])


def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    names = ("faulty_events", "documents", "lineitem", "pages")
    tables = _named_tables(spark, sf, *names)
    return _rounded(
        _stack([profile.table_profile(df, n) for n, df in tables.items()]).drop("profiled_at"), "null_cell_percent"
    )


def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_table(spark, sf, "documents").drop("doc_id")
    lines = read_table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    customers = read_table(spark, sf, "customer")
    frames = {"documents": documents, "lines": lines, "customer_twice": customers.unionAll(customers)}
    return _stack([profile.duplicate_rows(df).withColumn("dataset", F.lit(n)) for n, df in frames.items()])


def est_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, profile.estimated_bytes, "documents", "orders", "customer", "faulty_events", "pages")


def column_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, profile.column_nulls, "faulty_events", "lineitem", "embeddings").drop("dtype")


def numeric_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, profile.numeric_profile, "orders", "customer", "faulty_events")


def numeric_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return profile.numeric_quartiles(read_table(spark, sf, "lineitem"))


def _distinct(df: DataFrame) -> DataFrame:
    names = text_columns(df)
    return frequency.distinct_stats(frequency.value_frequency(df, names), names)


def string_uniques(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, _distinct, "documents", "customer", "part", "embeddings").drop("avg_length")


def avg_length(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, _distinct, "documents", "pages", "conversations").select(
        "dataset", "column", "avg_length"
    )


def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, lambda df: frequency.top_values(df, text_columns(df)), "documents", "orders", "conversations")


def top_values_by_text(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(
        spark, sf, lambda df: ranking.exact_top_values(df, text_columns(df)), "documents", "pages", "benchmark", "conversations", "orders"
    )


def datetime_span_days(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, profile.datetime_profile, "events", "orders", "lineitem").select(
        "dataset", "column", F.to_date("min_date").alias("first_day"), F.to_date("max_date").alias("last_day"),
        "date_range_days",
    )


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    columns = profile.column_profile(faulty_events(spark, sf), "events")
    first = F.get("top_values", F.lit(0))
    return columns.select(
        "dataset", "position", "column", "count", "null_count", "null_percent", "mean", "std", "min_value",
        "max_value", "percentile_25", "percentile_50", "percentile_75", "unique_count", "unique_percent",
        "avg_length", first["value"].alias("top_value"), first["count"].alias("top_count"), "date_range_days",
    )


# ---- days ----------------------------------------------------------------------------


def daily_volume(spark: SparkSession, sf: str) -> DataFrame:
    return daily.daily_volume(read_table(spark, sf, "lineitem"), "l_shipdate").drop("dataset")


def daily_null_rates(spark: SparkSession, sf: str) -> DataFrame:
    days = daily.daily_columns(nulled_events(read_table(spark, sf, "events")), "ts")
    return _rounded(days.select("day", "day_idx", "column", "null_count", "null_rate"), "null_rate")


def daily_numeric(spark: SparkSession, sf: str) -> DataFrame:
    days = daily.daily_columns(read_table(spark, sf, "lineitem"), "l_shipdate").filter(F.col("mean").isNotNull())
    return _rounded(days.select("day", "day_idx", "column", "mean", "min", "max", "std"), "mean", "std")


def daily_category_share(spark: SparkSession, sf: str) -> DataFrame:
    shares = daily.daily_category_share(read_table(spark, sf, "orders"), "o_orderdate")
    return _rounded(shares.select("day", "day_idx", "column", F.col("key").alias("category"), "cnt", "share"), "share")


def daily_profile_records(spark: SparkSession, sf: str) -> DataFrame:
    days = daily_profile(faulty_events(spark, sf), "ts", name="events")
    records = daily.day_records(days).select(
        "day",
        "day_idx",
        "row_count",
        F.col("null_counts")["user_id"].alias("null_users"),
        F.round(F.col("null_rates")["user_id"], 6).alias("null_user_rate"),
        *[F.round(F.col(f"{s}s")["value"], 6).alias(f"{s}_value") for s in ("mean", "min", "max", "std")],
        F.size("means").cast("bigint").alias("numeric_columns"),
    )
    kinds = days.categories.filter(F.col("column") == "event_type").groupBy("day").agg(
        F.count(F.lit(1)).alias("event_types"), F.round(F.max("share"), 6).alias("top_share")
    )
    return records.join(kinds, "day")


def _state_in_loads(spark: SparkSession, sf: str, table: str, date_column: str, key: str) -> DataFrame:
    """The daily state of a table that comes in three loads, rows of one day in any of them."""
    rows = read_table(spark, sf, table)
    loads = [rows.filter(F.col(key) % 3 == k) for k in range(3)]
    return history.merge_states(*[history.daily_state(load, date_column, table) for load in loads])


def merged_daily_numeric(spark: SparkSession, sf: str) -> DataFrame:
    days = history.profile_of_state(_state_in_loads(spark, sf, "lineitem", "l_shipdate", "l_orderkey")).columns
    days = days.filter(F.col("mean").isNotNull()).select("day", "day_idx", "column", "null_count", "mean", "min", "max", "std")
    return _rounded(days, "mean", "std", digits=9)


def merged_detect_series(spark: SparkSession, sf: str) -> DataFrame:
    """The series detectors over the state of two loads, the second one the late rows of all days."""
    events = faulty_events(spark, sf)
    loads = [events.filter(F.col("event_id") % 4 != 0), events.filter(F.col("event_id") % 4 == 0)]
    state = history.merge_states(*[history.daily_state(load, "ts", "events") for load in loads])
    return _anomalies(detect.detect_series(history.profile_of_state(state).columns))


def approximate_distincts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values from the sketches of the days, and whether they are within three standard errors of the exact number."""
    found = history.approximate_statistics(_state_in_loads(spark, sf, "orders", "o_orderdate", "o_orderkey"))
    orders = read_table(spark, sf, "orders")
    names = [c for c in orders.columns if c != "o_orderdate"]
    exact = frequency.distinct_stats(frequency.value_frequency(orders, names), names)
    bound = 3 * 1.04 / 2 ** (history.HLL_LOG2 / 2)
    near = F.abs(found["unique_count"] - exact["unique_count"]) <= F.greatest(F.lit(1.0), exact["unique_count"] * bound)
    return found.join(exact, "column").select("column", "filled", exact["unique_count"], near.alias("within_bound"))


# ---- history -------------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str, table: str, date_column: str) -> DataFrame:
    days = daily.daily_volume(read_table(spark, sf, table), date_column)
    return detect.with_history(days, {"rows": "row_count"})


def zscore_expanding(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf, "orders", "o_orderdate").select(
        "day", F.col("row_count").cast("bigint").alias("row_count"), F.col("rows_hist_count").alias("hist_count"),
        F.col("rows_hist_mean").alias("hist_mean"), F.col("rows_hist_std").alias("hist_std"), F.col("rows_z").alias("z"),
    )
    return _rounded(scored, "hist_mean", "hist_std", "z")


def severity_bucket(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf, "lineitem", "l_shipdate")
    return scored.groupBy(severity(F.col("rows_z")).alias("severity")).agg(F.count(F.lit(1)).alias("days"))


def detect_volume(spark: SparkSession, sf: str) -> DataFrame:
    return _anomalies(detect.detect_volume(daily.daily_volume(read_table(spark, sf, "lineitem"), "l_shipdate")))


def detect_null_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _anomalies(detect.detect_null_rate(daily.daily_columns(nulled_events(read_table(spark, sf, "events")), "ts")))


def detect_negative(spark: SparkSession, sf: str) -> DataFrame:
    events = inject.inject_negative(read_table(spark, sf, "events"), "ts", NEGATIVE_DAY, "event_id", "value")
    return _anomalies(detect.detect_negative(daily.daily_columns(events, "ts")))


def detect_mean_shift(spark: SparkSession, sf: str) -> DataFrame:
    return _anomalies(detect.detect_mean_shift(daily.daily_columns(read_table(spark, sf, "lineitem"), "l_shipdate")))


def detect_distribution(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    volume = daily.daily_volume(orders, "o_orderdate")
    shares = daily.daily_category_share(orders, "o_orderdate", volume=volume)
    return _anomalies(detect.detect_distribution(shares, volume, source=orders))


def _faulty_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    events = faulty_events(spark, sf)
    return detect.detect_all(daily_profile(events, "ts", name="events"), source=events)


def detect_all(spark: SparkSession, sf: str) -> DataFrame:
    return _anomalies(_faulty_anomalies(spark, sf))


def described_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events with planted faults; their type is a long description, another for each third of the users."""
    words = F.concat(F.lit("an event of the type "), "event_type", F.lit(", as the application describes it to group "))
    group = F.concat((F.col("event_id") % 3).cast("string"), F.lit(" of the users"))
    return faulty_events(spark, sf).withColumn("event_type", F.concat(words, group)).drop("props")


def detect_long_categories(spark: SparkSession, sf: str) -> DataFrame:
    events = described_events(spark, sf)
    low = DetectionThresholds(share_shift=0.05)
    days = daily_profile(events, "ts", name="events")
    return _anomalies(detect.detect_distribution(days.categories, days.volume, low, texts=days.texts))


def enriched_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with the day of their order and the brand of their part."""
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    parts = read_table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("o_orderdate", "l_extendedprice", "l_returnflag", "o_orderpriority", "p_brand")
    )


def enriched_detect_distribution(spark: SparkSession, sf: str) -> DataFrame:
    lines = enriched_lines(spark, sf)
    volume = daily.daily_volume(lines, "o_orderdate")
    shares = daily.daily_category_share(lines, "o_orderdate", volume=volume)
    return _anomalies(detect.detect_distribution(shares, volume))


def enriched_detect_all_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The share detector over the order lines with all text columns of lines, orders and parts."""
    lookups = [
        enrich.Lookup(read_table(spark, sf, "orders"), "l_orderkey", "o_orderkey"),
        enrich.Lookup(read_table(spark, sf, "part"), "l_partkey", "p_partkey"),
    ]
    shares, volume = enrich.enriched_categories(read_table(spark, sf, "lineitem"), lookups, "o_orderdate")
    return _anomalies(detect.detect_distribution(shares, volume))


# ---- comparison ----------------------------------------------------------------------


def cmp_row_count(spark: SparkSession, sf: str) -> DataFrame:
    current, baseline = _compared(spark, sf)
    return _changes(compare.compare_row_count(current.table, baseline.table))


def _column_comparison(rule: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        current, baseline = _compared(spark, sf)
        return _changes(rule(current.columns, baseline.columns))

    return query


def compare_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(compare.compare_profiles(*_compared(spark, sf)))


def compare_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Two datasets at once, each against its own baseline; the customers lose rows, a column and their positive balances."""
    now, before = _compared(spark, sf)
    customers = read_table(spark, sf, "customer")
    fewer = customers.filter(F.col("c_custkey") % 3 == 0).withColumn("c_acctbal", -F.abs("c_acctbal")).drop("c_mktsegment")
    current = compare.together([now, profile.profile(fewer, "customer_part", profile.COMPARED_STATISTICS)])
    baseline = compare.together([before, profile.profile(customers, "customer", profile.COMPARED_STATISTICS)])
    found = compare.compare_datasets(current, baseline, {"current": "baseline", "customer_part": "customer"})
    return found.select("dataset", "baseline_dataset", *CHANGE_OUT)


def has_changes(spark: SparkSession, sf: str) -> DataFrame:
    current, baseline = _compared(spark, sf)
    itself = compare.has_significant_changes(compare.compare_profiles(current, current))
    drifted = compare.has_significant_changes(compare.compare_profiles(current, baseline))
    return itself.withColumn("pair", F.lit("itself")).unionByName(drifted.withColumn("pair", F.lit("drifted")))


# ---- rules and reports ---------------------------------------------------------------


def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    unassigned = orders.withColumn(
        "o_custkey", F.when(hash_fraction(42, "customer", F.col("o_orderkey")) >= 0.4, F.col("o_custkey"))
    )
    tables = _named_tables(spark, sf, "customer", "supplier", "faulty_events") | {
        "orders": unassigned,
        "document_texts": read_table(spark, sf, "documents").drop("doc_id"),
    }
    return _rounded(rules.quality_issues([profile.profile(df, n, profile.RULE_STATISTICS) for n, df in tables.items()]), "value", digits=4)


def anomalies_by_type(spark: SparkSession, sf: str) -> DataFrame:
    events, orders = faulty_events(spark, sf), read_table(spark, sf, "orders")
    found = [
        detect.detect_all(daily_profile(df, day, name=name))
        for name, df, day in (("events", events, "ts"), ("orders", orders, "o_orderdate"))
    ]
    return reports.anomaly_counts(_stack(found))


def profile_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.profile_report(profile.column_profile(faulty_events(spark, sf), "events")).drop("dtype")


def compare_report(spark: SparkSession, sf: str) -> DataFrame:
    report = reports.compare_report(compare.compare_profiles(*_compared(spark, sf)))
    return report.select("type", "column", "baseline", "current", "change", "severity")


def anomaly_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.anomaly_report(_faulty_anomalies(spark, sf)).select("day", "line_no", "headline")


def fact_quick_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.quick_stats(faulty_events(spark, sf), "ts", "user_id", "value"), "rows_per_day")


# ---- test data -----------------------------------------------------------------------


def inject_volume_drop(spark: SparkSession, sf: str) -> DataFrame:
    events = inject.inject_volume_drop(read_table(spark, sf, "events"), "ts", DROP_DAY, "event_id")
    return daily.daily_volume(events, "ts").drop("dataset")


def inject_negative(spark: SparkSession, sf: str) -> DataFrame:
    events = inject.inject_negative(read_table(spark, sf, "events"), "ts", NEGATIVE_DAY, "event_id", "value")
    return events.select("event_id", F.to_date("ts").alias("day"), "value")


def inject_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return nulled_events(read_table(spark, sf, "events")).select("event_id", F.to_date("ts").alias("day"), "user_id")


def inject_category_shift(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events")
    shifted = inject.inject_category_shift(events, "ts", SHIFT_DAY, "event_id", "event_type", EVENT_TYPES)
    return shifted.select("event_id", F.to_date("ts").alias("day"), "event_type")


def injected_vs_detected(spark: SparkSession, sf: str) -> DataFrame:
    return inject.injected_vs_detected(inject.injected_faults(spark, FAULTS), _faulty_anomalies(spark, sf))


def _products(spark: SparkSession, sf: str) -> DataFrame:
    return synth.synth_products(read_table(spark, sf, "part"), "p_partkey")


def _volume(spark: SparkSession, sf: str) -> DataFrame:
    days = daily.daily_volume(read_table(spark, sf, "events"), "ts")
    return synth.synth_daily_volume(days, base=F.col("row_count"))


def synth_orders(spark: SparkSession, sf: str) -> DataFrame:
    return synth.synth_orders(_volume(spark, sf))


def synth_items(spark: SparkSession, sf: str) -> DataFrame:
    return synth.synth_items(synth_orders(spark, sf), _products(spark, sf))


def synth_order_totals(spark: SparkSession, sf: str) -> DataFrame:
    orders = synth_orders(spark, sf)
    return synth.synth_order_totals(orders, synth.synth_items(orders, _products(spark, sf)))


PLANNED_DAYS = {10: inject.FAULT_VOLUME_DROP, 15: inject.FAULT_NEGATIVE, 20: inject.FAULT_NULLS, 25: inject.FAULT_CATEGORY_SHIFT}


def _planned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(days with their faults, orders, items), made under the fault plan."""
    days = synth.with_faults(daily.daily_volume(read_table(spark, sf, "events"), "ts"), synth.fault_plan(spark, PLANNED_DAYS))
    orders = synth.synth_orders(synth.synth_daily_volume(days, base=F.col("row_count")))
    return days, orders, synth.synth_items(orders, _products(spark, sf))


def planned_orders(spark: SparkSession, sf: str) -> DataFrame:
    _, orders, items = _planned(spark, sf)
    return synth.synth_order_totals(orders.drop(synth.PLANNED), items)


def planned_items(spark: SparkSession, sf: str) -> DataFrame:
    return _planned(spark, sf)[2]


def planned_vs_detected(spark: SparkSession, sf: str) -> DataFrame:
    """Are the planned faults found in the orders and in the items, enriched by order date and category?

    The made tables are stored once for the many parts of both profiles, which would each make them anew.
    """
    from rowhelm.llm.storage import stored  # only here, as that subpackage is optional

    days, orders, items = _planned(spark, sf)
    orders = stored(orders.drop(synth.PLANNED), "planned_orders")
    # By their estimated sizes, of few days or of compressed keys, these would be broadcast.
    dates, categories = orders.select("order_id", "order_date"), _products(spark, sf).select("product_id", "category")
    lines = items.join(dates.hint("merge"), "order_id").join(categories.hint("merge"), "product_id")
    lines = stored(lines.select("order_date", "category", "quantity", "unit_price", "line_total"), "planned_lines")
    found = [detect.detect_all(daily_profile(df, "order_date", name=n)) for n, df in {"orders": orders, "items": lines}.items()]
    return inject.injected_vs_detected(synth.planted_faults(days), _stack(found))


QUERIES: dict[str, Query] = {
    "date_parse_by_name": date_parse_by_name,
    "date_column_detect": date_column_detect,
    "dataset_status": dataset_status,
    "csv_types": csv_types,
    "daily_null_date_dropped": daily_null_date_dropped,
    "table_profile": table_profile,
    "duplicate_rows": duplicate_rows,
    "est_bytes": est_bytes,
    "column_nulls": column_nulls,
    "numeric_profile": numeric_profile,
    "numeric_quartiles": numeric_quartiles,
    "string_uniques": string_uniques,
    "top_values": top_values,
    "top_values_by_text": top_values_by_text,
    "avg_length": avg_length,
    "datetime_span_days": datetime_span_days,
    "column_profile": column_profile,
    "daily_volume": daily_volume,
    "daily_null_rates": daily_null_rates,
    "daily_numeric": daily_numeric,
    "daily_category_share": daily_category_share,
    "daily_profile": daily_profile_records,
    "merged_daily_numeric": merged_daily_numeric,
    "merged_detect_series": merged_detect_series,
    "approximate_distincts": approximate_distincts,
    "zscore_expanding": zscore_expanding,
    "severity_bucket": severity_bucket,
    "detect_volume": detect_volume,
    "detect_null_rate": detect_null_rate,
    "detect_negative": detect_negative,
    "detect_mean_shift": detect_mean_shift,
    "detect_distribution": detect_distribution,
    "detect_all": detect_all,
    "detect_long_categories": detect_long_categories,
    "enriched_detect_distribution": enriched_detect_distribution,
    "enriched_detect_all_texts": enriched_detect_all_texts,
    "cmp_row_count": cmp_row_count,
    "cmp_null_rate": _column_comparison(compare.compare_null_rate),
    "cmp_mean": _column_comparison(compare.compare_mean),
    "cmp_negative": _column_comparison(compare.compare_negative),
    "cmp_unique": _column_comparison(compare.compare_unique_count),
    "schema_drift": _column_comparison(compare.compare_schema),
    "compare_profiles": compare_profiles,
    "compare_datasets": compare_datasets,
    "has_changes": has_changes,
    "quality_issues": quality_issues,
    "anomalies_by_type": anomalies_by_type,
    "profile_report": profile_report,
    "compare_report": compare_report,
    "anomaly_report": anomaly_report,
    "fact_quick_stats": fact_quick_stats,
    "inject_volume_drop": inject_volume_drop,
    "inject_negative": inject_negative,
    "inject_nulls": inject_nulls,
    "inject_category_shift": inject_category_shift,
    "injected_vs_detected": injected_vs_detected,
    "synth_products": _products,
    "synth_daily_volume": _volume,
    "synth_orders": synth_orders,
    "synth_items": synth_items,
    "synth_order_totals": synth_order_totals,
    "planned_orders": planned_orders,
    "planned_items": planned_items,
    "planned_vs_detected": planned_vs_detected,
}
