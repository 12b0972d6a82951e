"""Every registered query of the library runs over the smallest tables, and gives the rows of its SQL where it has one."""

import os

import pytest
from compared import FOLDER, connected, rows_of

from loamdex.plans import derived, files, matches, pieces, records, retrieval, texts

MODULES = (retrieval, texts, records, matches, files, pieces, derived)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.fixture(scope="module")
def con():
    return connected()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        expected = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows_of(got) == rows_of(expected)


def test_names_are_unique():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES) and SQL.keys() <= QUERIES.keys()
