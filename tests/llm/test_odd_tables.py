"""Every registered query on empty tables, on rows of nulls, and with further columns of clashing names."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from larkspur.llm import catalogue
from larkspur.operators.timestamps import p3_found

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="the test tables are not there")
TABLES = ["raw_articles", "market_news", "sentiment_articles", "news_sources", "documents", "lang_codes", "container_specs"]
QUERIES = {"p3_found": p3_found} | catalogue.QUERIES
FIXED = ["news_sources", "lang_codes", "container_specs"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("odd")
    for name in TABLES:
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        df.limit(0).write.parquet(f"{base}/empty/{name}.parquet")
        if name in FIXED:
            df.write.parquet(f"{base}/nulls/{name}.parquet")
            df.write.parquet(f"{base}/more/{name}.parquet")
            continue
        key = {"raw_articles": "id", "market_news": "news_id", "sentiment_articles": "article_id", "documents": "doc_id"}[name]
        nulls = df.select(*[F.col(c) if c in (key, "batch_no") else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        nulls.limit(30).union(nulls.limit(3)).write.parquet(f"{base}/nulls/{name}.parquet")
        df.withColumns({c: F.lit("x") for c in ("h", "key", "seg", "kind", "val", "ids", "group_id", "field_name", "_raw", "_home", "_form", "shard", "tokens", "named", "words", "links") if c not in df.columns}).write.parquet(f"{base}/more/{name}.parquet")
    return base


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name: str) -> None:
    assert QUERIES[name](spark, f"{folders}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_of_nulls(spark, folders, name: str) -> None:
    rows = QUERIES[name](spark, f"{folders}/nulls").collect()
    if name in ("p6_ids", "p8_redacted"):
        assert len(rows) == 33 and all(not r[1] for r in rows)
    elif name == "p7_packed":
        assert {r.n_tokens for r in rows} == {0}
    elif name == "p7_fill":
        assert {(r.containers, r.tokens, r.overfull, r.fill) for r in rows} == {(0, 0, 0, None)}
    else:
        assert rows == []


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p8_found"])
def test_further_columns(spark, folders, name: str) -> None:
    plain, more = (sorted(map(repr, QUERIES[name](spark, f).collect())) for f in (SMALL, f"{folders}/more"))
    assert plain == more
