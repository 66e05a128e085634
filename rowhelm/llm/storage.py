"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset in a local session (tests).

    Executors of a cluster don't see the driver's temporary folder, so there it must be set.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="rowhelm-")
    return _own[context.applicationId]


def stored(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """``df`` written once as Parquet and read back: cuts the lineage, survives lost executors.

    With ``free``, the driver collects its garbage, so that Spark's cleaner drops the shuffle files of
    finished jobs now and not when the driver happens to need memory.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if free:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing will read again."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key``: the same rows whatever the layout."""
    from pyspark.sql import functions as F

    return df.orderBy(F.xxhash64(key, F.lit(17)), key).limit(n)
