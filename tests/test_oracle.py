"""Every registered query against its DuckDB oracle (sf0.001, whole tables)."""

import os

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck
from vocaframe.plans.oracle import ORACLE_SQL
from vocaframe.plans.queries import QUERIES

SF = os.environ.get("VOCAFRAME_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF)
    assert r["ok"], r.get("diff")


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["conv_id", "turn", "prompt"]
    assert df.count() > 0
