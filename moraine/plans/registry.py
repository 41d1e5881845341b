"""All queries of the core with their check SQL."""

from __future__ import annotations

from moraine.plans import core_problems, detail_queries, function_queries, snapshot_queries, store_queries, stream_queries, tree_queries

_MODULES = [core_problems, store_queries, snapshot_queries, tree_queries, function_queries, stream_queries, detail_queries]


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
