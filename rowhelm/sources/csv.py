"""CSV datasets: discovery, reading with inferred types, and writing."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowhelm.functions.scalars import quoted
from rowhelm.sources.dates import DATE_FORMATS, folded_masks, format_mask, format_of, mask_of

# Texts that stand for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Texts of the inferred types. Infinities are numbers, as is 1e5.
INTEGER_TEXT = r"^[+-]?\d+$"
DOUBLE_TEXT = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)$"
BOOLEAN_TEXT = r"^([Tt]rue|[Ff]alse|TRUE|FALSE)$"


def find_csv_datasets(spark: SparkSession, directory: str) -> dict[str, str]:
    """Name and path of each ``*.csv`` file, or directory of part files, by sorted name."""
    root = directory.rstrip("/")
    try:
        files = spark.read.format("binaryFile").load(f"{root}/*.csv").inputFiles()  # names only
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.read.format("binaryFile").load(root)  # raises if the directory itself is missing
        files = []
    names = {m.group(1) for f in files if (m := re.search(r"/([^/]+)\.csv(/[^/]*)?$", unquote(f)))}
    return {name: f"{root}/{name}.csv" for name in sorted(names)}


def _reader(spark: SparkSession, multi_line: bool):
    return spark.read.options(header=True, escape='"', multiLine=multi_line, nullValue="", emptyValue="")


def _has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    row = spark.read.text(path).agg(F.max(quotes % 2).alias("odd")).first()
    return row["odd"] == 1


def _whole_lines(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The file as texts. A line with more fields than the header raises an error when it is read."""
    reader = _reader(spark, multi_line)
    names = reader.csv(path).columns
    if not names:
        raise ValueError(f"no columns in {path}")
    more = "_more"
    while more in names:
        more += "_"
    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, more]])
    extra = F.raise_error(F.lit(f"a line with more than {len(names)} fields in {path}")).cast("boolean")
    return reader.schema(fields).csv(path).filter(F.when(F.col(more).isNotNull(), extra).otherwise(True)).drop(more)


def _blank_missing(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.when(~F.col(quoted(c)).isin(MISSING_TEXTS), F.col(quoted(c))).alias(c) for c in df.columns]
    )


#: The types that a text can be of, from the most special one on: a bit each in the masks of inferred columns.
_TYPES = {"bigint": INTEGER_TEXT, "double": DOUBLE_TEXT, "boolean": BOOLEAN_TEXT}
# First characters of the texts of each type, looked at before the patterns.
_FIRST = {"bigint": "+-0123456789", "double": "+-.0123456789iI", "boolean": "tTfF"}


# Rows that are looked at for everything, before all rows are for what these leave.
HEAD = 1000


def type_mask(column: Column) -> Column:
    """Bit j is set if the text is of the j-th of the inferred types; a whole number is a double as well."""
    bits = F.lit(0).cast("bigint")
    first = F.substring(column, 1, 1)
    for j, (name, pattern) in enumerate(_TYPES.items()):
        fits = first.isin(*_FIRST[name]) & column.rlike(pattern) & column.try_cast(name).isNotNull()
        bits = bits + F.when(fits, F.lit(1 << j).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.when(column.isNotNull(), bits)


def _type_and_date_mask(column: Column) -> Column:
    return type_mask(column).bitwiseOR(F.shiftleft(format_mask(column), len(_TYPES)))


def _mask_of(column: Column, bits: int) -> Column:
    """``_type_and_date_mask`` with the given bits alone, by the work that these need."""
    names = list(_TYPES)
    none = F.lit(0).cast("bigint")
    one = {n: F.when(column.rlike(_TYPES[n]) & column.try_cast(n).isNotNull(), F.lit(1 << j).cast("bigint")).otherwise(none) for j, n in enumerate(names) if bits >> j & 1}
    mask = reduce(Column.__add__, one.values(), none)
    if bits & 3 == 3:
        # what a number is spelt like by Spark is a whole number and a double, and is found out without a pattern
        whole = F.coalesce(column.try_cast("bigint").cast("string") == column, F.lit(False))
        mask = F.when(whole, F.lit(3).cast("bigint")).otherwise(mask)
    if formats := bits >> len(names):
        mask = mask.bitwiseOR(F.shiftleft(mask_of(column, formats), len(names)))
    return F.when(column.isNotNull(), mask)


def _folded(tables: dict[str, DataFrame], left: dict[str, list[int]]) -> dict[str, list[tuple[int, int, int | None]]]:
    """(rows, filled rows, the bits that all filled ones have) of each column, of the bits that are ``left``. One job over all rows."""
    frames = []
    for name, df in tables.items():
        found = [c for k, (column, bits) in enumerate(zip(df.columns, left[name])) for c in (F.count(F.col(quoted(column))).alias(f"f{k}"), F.bit_and(_mask_of(F.col(quoted(column)), bits)).alias(f"m{k}"))]
        each = [F.struct(F.col("n"), F.col(f"f{k}").alias("filled"), F.col(f"m{k}").alias("mask")) for k in range(len(df.columns))]
        frames.append(df.agg(F.count(F.lit(1)).alias("n"), *found).select(F.lit(name).alias("dataset"), F.array(*each).alias("columns")))
    return {row["dataset"]: [tuple(c) for c in row["columns"]] for row in reduce(DataFrame.unionByName, frames).collect()}


def _inferred_type(n: int, filled: int, mask: int | None) -> str:
    if filled == 0:
        return "double"
    fits = [name for j, name in enumerate(_TYPES) if mask >> j & 1]
    if fits and (fits[0] != "boolean" or filled == n):
        return fits[0]
    return "string"


def infer_tables(tables: dict[str, DataFrame]) -> dict[str, dict[str, tuple[str, str | None]]]:
    """Type and date format of every column of all-text tables, from two jobs over all of them.

    A column is of a type, or of a format, if all its values are: each value has a mask of what it can be, and the
    masks of a column are folded by ``bit_and``. What the first rows rule out is not looked for in the others, all of
    which are read. The format is None unless the type is string. An empty column is a double.
    """
    found = {name: dict.fromkeys(df.columns, ("double", None)) for name, df in tables.items()}
    tables = {name: df for name, df in tables.items() if df.columns}
    if not tables:
        return found
    left = {name: [-1] * len(df.columns) for name, df in tables.items()}
    heads = {name: (df.limit(HEAD), df.columns) for name, df in tables.items()}
    for row in folded_masks(heads, _type_and_date_mask).collect():
        if row["mask"] is not None:
            left[row["dataset"]][tables[row["dataset"]].columns.index(row["column"])] = row["mask"]
    every = (1 << len(_TYPES) + len(DATE_FORMATS)) - 1
    left = {name: [bits & every for bits in columns] for name, columns in left.items()}
    for name, columns in _folded(tables, left).items():
        for column, (n, filled, mask) in zip(tables[name].columns, columns):
            kind = _inferred_type(n, filled, mask)
            found[name][column] = (kind, format_of(mask >> len(_TYPES)) if kind == "string" else None)
    return found


def infer_types(df: DataFrame) -> list[str]:
    """The type of each all-text column, from one aggregation over the whole table."""
    found = infer_tables({"": df})[""]
    return [found[name][0] for name in df.columns]


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """A CSV file or directory with a header row.

    Without a schema the types are inferred from all values, after the usual texts for a
    missing value became NULL. Files are split among tasks unless quoted values contain
    newlines, which is found out by a scan when ``multi_line`` is not given. Missing fields at
    the end of a line are NULL; a line with more fields than the header is an error.
    """
    if multi_line is None:
        multi_line = _has_quoted_newlines(spark, path)
    texts = _blank_missing(_whole_lines(spark, path, multi_line))
    types = [f.dataType.simpleString() for f in schema] if schema else infer_types(texts)
    names = schema.names if schema else texts.columns
    return texts.select(
        *[F.col(quoted(c)).try_cast(t).alias(n) for c, t, n in zip(texts.columns, types, names)]
    )


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(header=True, escape='"').csv(path)
