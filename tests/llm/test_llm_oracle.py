"""Registered queries against their DuckDB SQL, on whole tables."""

import os

import pytest

from oracle_compare import compare, duck
from vocaframe.llm.queries import QUERIES
from vocaframe.llm.sql import ORACLE_SQL

SF = os.environ.get("VOCAFRAME_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    r = compare(spark, duck(SF), name, SF)
    assert r["ok"], r.get("diff")
