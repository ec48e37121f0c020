"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from larkspur.operators.timestamps import p3_found
from larkspur.plans import analysis_queries, extra_queries, graph_queries, market_queries, more_queries, profile_queries, refine_queries, relation_queries, report_queries, search_queries, stream_queries, text_queries

MODULES = [search_queries, text_queries, graph_queries, market_queries, stream_queries, analysis_queries, more_queries, extra_queries, relation_queries, profile_queries, refine_queries, report_queries]
QUERIES = {"p3_found": p3_found}
for _m in MODULES:
    QUERIES |= _m.R.queries
ORACLE: dict[str, str] = {}
for _m in MODULES:
    ORACLE |= _m.R.oracle
