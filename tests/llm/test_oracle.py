"""The queries with SQL give what DuckDB gives."""

from __future__ import annotations

import os

import pytest

from conftest import SMALL
from larkspur.llm import catalogue

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="the test tables are not there")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, name: str) -> None:
    connection = duckdb.connect()
    for t in ("raw_articles", "news_sources"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    found = connection.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    rows = catalogue.QUERIES[name](spark, SMALL)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(tuple(r) for r in rows.select(*names).collect()) == sorted(found.fetchall())
