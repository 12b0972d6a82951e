"""The typed-out cases give their rows."""

import duckdb
import literal_cases
import pytest
from compared import rows_of


@pytest.mark.parametrize("name", sorted(literal_cases.QUERIES))
def test_case(spark, name):
    got, expected = literal_cases.QUERIES[name](spark, "").toPandas(), duckdb.sql(literal_cases.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)
