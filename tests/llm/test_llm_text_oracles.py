import duckdb
import pytest

import __spark_entry__
from rowhelm.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.TEXT_ORACLES))
def test_text_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(queries.TEXT_ORACLES[name])
    names = [d[0] for d in result.description]
    mine = [tuple(r) for r in queries.QUERIES[name](spark, SF).select(*names).collect()]
    assert sorted(mine) == sorted(result.fetchall()) and mine


def test_all_twins_are_registered():
    assert set(queries.ORACLES) | set(queries.TEXT_ORACLES) <= set(__spark_entry__.oracle_sql())
