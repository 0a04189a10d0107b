"""All core queries and the SQL they must equal."""

from __future__ import annotations

from codelake.plans import graph_queries, hierarchy_queries, index_queries, reference_queries, stream_queries, vector_queries

MODULES = [vector_queries, reference_queries, hierarchy_queries, graph_queries, index_queries, stream_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
