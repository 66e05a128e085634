"""Whole runs over many datasets: profile them, or look for anomalous days in them.

The loops go over datasets, never over rows. A dataset that fails does not stop the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowhelm.operators.daily import daily_profile, daily_volume
from rowhelm.operators.detect import detect_all
from rowhelm.operators.profile import TableSummary, profile
from rowhelm.operators.rules import quality_issues
from rowhelm.sources.csv import find_csv_datasets, read_csv
from rowhelm.sources.dates import find_date_columns, parse_column, parse_dates_by_name
from rowhelm.types import DetectionThresholds

OK, NO_DATE, SHORT_HISTORY, ERROR = "ok", "no_date", "short_history", "error"

STATUS_SCHEMA = "dataset string, status string, date_column string, days bigint, error string"

Loader = Callable[[], DataFrame]
T = TypeVar("T")


@dataclass(frozen=True)
class RunResult:
    """``status`` has one row per dataset; ``anomalies`` or ``issues`` is None if none ran."""

    status: DataFrame
    anomalies: DataFrame | None = None
    profiles: tuple[TableSummary, ...] = ()
    issues: DataFrame | None = None


def csv_loaders(spark: SparkSession, directory: str) -> dict[str, Loader]:
    return {
        name: (lambda path=path: read_csv(spark, path))
        for name, path in find_csv_datasets(spark, directory).items()
    }


def _message(error: Exception) -> str:
    """The first line that says what went wrong."""
    lines = [line.strip(" :") for line in str(error).splitlines() if line.strip(" :")]
    lines = [line for line in lines if not line.startswith("An error occurred while calling")]
    return lines[0] if lines else type(error).__name__


def side_by_side(spark: SparkSession, tasks: dict[str, Callable[[], T]], at_once: int = 8) -> dict[str, tuple[T | None, str | None]]:
    """The result or the first line of the error of each task, run in threads.

    The jobs of a task carry a tag of their own; a task that fails has its other jobs cancelled, and no others.
    """

    context = spark.sparkContext

    def run(name: str) -> tuple[T | None, str | None]:
        tag = f"rowhelm-{uuid.uuid4().hex}"
        context.addJobTag(tag)
        try:
            return tasks[name](), None
        except Exception as error:  # the caller reports it
            context.cancelJobsWithTag(tag)
            return None, _message(error)
        finally:
            context.removeJobTag(tag)

    # a wrapper each: it holds the thread's properties, the tag among them
    calls = [inheritable_thread_target(spark)(lambda name=name: run(name)) for name in tasks]
    with ThreadPool(max(1, min(at_once, len(tasks)))) as pool:
        return dict(zip(tasks, pool.map(lambda call: call(), calls)))


def _materialised(df: DataFrame) -> DataFrame:
    """The result of a job that has run, so that no error of this frame is left to others.

    It is written to the folder of ``spark.checkpoint.dir``. Where that is unset, the job only runs, and what it
    returns is computed again.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        df.write.format("noop").mode("overwrite").save()
        return df
    path = f"{folder.rstrip('/')}/rowhelm-run-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _local(df: DataFrame) -> DataFrame:
    """A frame of one row, or of one row a column, computed now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _day_counts(tables: dict[str, tuple[DataFrame, str]]) -> dict[str, int]:
    """Number of days of each table, from one job over all of them."""
    days = [daily_volume(df, column, name).select("dataset", "day") for name, (df, column) in tables.items()]
    counts = reduce(DataFrame.unionByName, days).groupBy("dataset").count()
    return {r["dataset"]: r["count"] for r in counts.collect()}


def _all_or_each(spark: SparkSession, tables: dict[str, T], job: Callable[[dict[str, T]], dict]) -> dict[str, tuple]:
    """(result, error) of each table from one job for all; if that fails, from one job each."""
    if not tables:
        return {}
    try:
        found = job(tables)
        return {name: (found.get(name), None) for name in tables}
    except Exception:  # some table's: each for itself then
        return side_by_side(spark, {name: (lambda name=name: job({name: tables[name]}).get(name)) for name in tables})


def dataset_status(
    spark: SparkSession, loaders: dict[str, Loader], min_history_days: int = 5
) -> tuple[DataFrame, dict[str, tuple[DataFrame, str]]]:
    """Which datasets can be searched for anomalies, and those tables with their date column.

    One job finds the date columns of all datasets, another counts their days.
    """
    loaded = side_by_side(spark, loaders)
    errors = {name: error for name, (_, error) in loaded.items() if error}
    tables = {name: df for name, (df, error) in loaded.items() if not error}
    dated, days = {}, {}
    for name, (found, error) in _all_or_each(spark, tables, find_date_columns).items():
        if error:
            errors[name] = error
        elif found[0] is not None:
            column, pattern = found
            dated[name] = (parse_column(tables[name], column, pattern) if pattern else tables[name], column)
    for name, (count, error) in _all_or_each(spark, dated, _day_counts).items():
        if error:
            errors[name] = error
        else:
            days[name] = count or 0
    rows, usable = [], {}
    for name in loaders:
        if name in errors:
            rows.append((name, ERROR, None, None, errors[name]))
        elif name not in dated:
            rows.append((name, NO_DATE, None, None, None))
        elif days[name] < min_history_days:
            rows.append((name, SHORT_HISTORY, dated[name][1], days[name], None))
        else:
            rows.append((name, OK, dated[name][1], days[name], None))
            usable[name] = dated[name]
    return spark.createDataFrame(rows, STATUS_SCHEMA), usable


def detect_datasets(
    spark: SparkSession, loaders: dict[str, Loader], thresholds: DetectionThresholds = DetectionThresholds()
) -> RunResult:
    status, usable = dataset_status(spark, loaders, DetectionThresholds().min_history_days)
    tasks = {
        name: (lambda name=name, df=df, column=column: _materialised(detect_all(daily_profile(df, column, name=name), thresholds)))
        for name, (df, column) in usable.items()
    }
    done = side_by_side(spark, tasks)
    failed = [(name, error) for name, (_, error) in done.items() if error]
    if failed:
        late = F.create_map(*[F.lit(x) for pair in failed for x in pair])[F.col("dataset")]
        status = status.select(
            "dataset", F.when(late.isNotNull(), ERROR).otherwise(F.col("status")).alias("status"), "date_column", "days", F.coalesce(late, "error").alias("error")
        )
    found = [df for df, error in done.values() if not error]
    return RunResult(status, reduce(DataFrame.unionByName, found) if found else None)


def profile_datasets(spark: SparkSession, loaders: dict[str, Loader]) -> RunResult:
    """Profiles of all datasets. Each is computed here, beside the others; one that fails while it runs is an error of its own."""

    def summary(name: str) -> TableSummary:
        made = profile(parse_dates_by_name(loaders[name]()), name)
        return TableSummary(_local(made.table), _local(made.columns))

    done = side_by_side(spark, {name: (lambda name=name: summary(name)) for name in loaders})
    rows = [(name, ERROR if error else OK, None, None, error) for name, (_, error) in done.items()]
    profiles = tuple(made for made, error in done.values() if not error)
    issues = quality_issues(profiles) if profiles else None
    return RunResult(spark.createDataFrame(rows, STATUS_SCHEMA), None, profiles, issues)


def detect_directory(
    spark: SparkSession, directory: str, thresholds: DetectionThresholds = DetectionThresholds()
) -> RunResult:
    """Search every CSV dataset of a directory for anomalous days."""
    return detect_datasets(spark, csv_loaders(spark, directory), thresholds)


def profile_directory(spark: SparkSession, directory: str) -> RunResult:
    """Profile every CSV dataset of a directory."""
    return profile_datasets(spark, csv_loaders(spark, directory))
