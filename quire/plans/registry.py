"""All registered queries with their SQL oracles, gathered from the query modules."""

from __future__ import annotations

from quire.plans import change_queries, join_queries, library_queries, scalar_queries, search_queries, sequence_queries, tag_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (library_queries, sequence_queries, tag_queries, join_queries, search_queries, scalar_queries, change_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
FLAGSHIP = "flt1_srt1_library_view"
