"""Every query with SQL gives what DuckDB gives, and every other one runs."""

from __future__ import annotations

import math
import os

import pytest

from conftest import SMALL

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from larkspur.plans import catalogue  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings raw_articles market_news sentiment_articles news_sources companies lang_codes container_specs".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="the test tables are not there")


def plain(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 4) + 0.0
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name: str) -> None:
    rows = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(rows.columns)
    got = sorted(repr(plain(list(r))) for r in rows.select(*columns).collect())
    if name in catalogue.ORACLE:
        found = oracle.execute(catalogue.ORACLE[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(repr(plain([r[i] for i in order])) for r in found.fetchall())


def test_entry(spark) -> None:
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
