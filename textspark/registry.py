"""All queries of the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

from textspark.plans import conversation_queries, index_queries, layer_queries, lexical_queries, linguistic_queries, report_queries, search_queries, semantic_queries, transcript_queries

_MODULES = (lexical_queries, search_queries, index_queries, conversation_queries, linguistic_queries, report_queries, semantic_queries, transcript_queries, layer_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
