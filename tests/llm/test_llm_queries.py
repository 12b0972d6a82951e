"""The corpus queries run over the smallest tables, and give the rows of their SQL where they have one."""

import os
import sys
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compared import FOLDER, connected, rows_of  # noqa: E402

from loamdex.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    table, key = ("pages", "page_id") if name == "op13_html_extraction" else ("documents", "doc_id")
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    assert len(got) == rows.count() and set(got[key]) == {r[0] for r in rows.select(key).collect()}
    if name in queries.SQL:
        assert rows_of(got) == rows_of(connected().execute(queries.SQL[name]).df())
