"""Every registered query against its SQL twin on the same tables."""

import pytest

import oracle_check
from rowhelm.plans.catalog import QUERIES
from rowhelm.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    mine, theirs, differences, types = oracle_check.compare(spark, con, SF_DIR, name)
    assert not types
    assert not differences
    assert mine == theirs > 0


def test_planted_faults_are_found(spark):
    rows = QUERIES["injected_vs_detected"](spark, SF_DIR).collect()
    assert len(rows) == 4 and all(row["detected"] for row in rows)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())
