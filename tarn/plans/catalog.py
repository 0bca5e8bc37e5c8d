"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from tarn.plans import queries_code, queries_engine, queries_graph, queries_more, queries_retrieval, queries_state

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (queries_retrieval, queries_code, queries_graph, queries_state, queries_more, queries_engine):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
FLAGSHIP = "graph_aware_retrieve"
