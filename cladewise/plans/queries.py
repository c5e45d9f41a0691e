"""All registered queries of the reference's operators, with their SQL where there is one."""

from __future__ import annotations

from . import chain_queries, event_queries, format_queries, network_queries, read_queries, relation_queries, report_queries, tree_queries, window_queries

_MODULES = (relation_queries, window_queries, read_queries, tree_queries, network_queries, event_queries, format_queries, report_queries, chain_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
