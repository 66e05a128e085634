"""Parquet tables and stored profiles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from rowhelm.operators.daily import DailyProfile


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, path: str, mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def save_texts(texts: DataFrame, path: str) -> None:
    """Add to a stored dictionary the texts of the keys that it doesn't have yet."""
    known = _stored(texts.sparkSession, path)
    if known is not None:
        texts = texts.join(known, ["dataset", "column", "key"], "left_anti")
    # Equal keys have equal texts, so whole rows can be told apart within each task first.
    write_table(texts.select("dataset", "column", "key", "text").distinct(), path, "append", ("dataset",))


def save_daily(daily: DailyProfile, path: str, mode: str = "error") -> None:
    """Store the daily tables, so that detectors can run again without the raw table.

    The dictionary of long category texts only grows: texts that it has are not written again.
    """
    write_table(daily.volume, f"{path}/volume", mode, ("dataset",))
    write_table(daily.columns, f"{path}/columns", mode, ("dataset",))
    if daily.categories is not None:
        write_table(daily.categories, f"{path}/categories", mode, ("dataset",))
    if daily.texts is not None:
        save_texts(daily.texts, f"{path}/texts")


def load_daily(spark: SparkSession, path: str, categories: bool = True) -> DailyProfile:
    return DailyProfile(
        spark.read.parquet(f"{path}/volume"),
        spark.read.parquet(f"{path}/columns"),
        spark.read.parquet(f"{path}/categories") if categories else None,
        _stored(spark, f"{path}/texts") if categories else None,
    )
