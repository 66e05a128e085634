"""Run a registered query and its SQL twin on the same tables and compare all rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from rowhelm.plans.catalog import ALL_TABLES, QUERIES
from rowhelm.plans.oracles import ORACLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in ALL_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str):
    """(spark rows, sql rows, first differences, type differences)."""
    df = QUERIES[name](spark, sf_dir)
    mine = _rows(df.columns, df.collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = _rows(names, result.fetchall())
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    schema = [(c, t, types.get(c)) for c, t in df.dtypes if kinds.get(t, t) != types.get(c)]
    diffs = [] if mine == theirs else ([r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3])
    return len(mine), len(theirs), diffs, schema
