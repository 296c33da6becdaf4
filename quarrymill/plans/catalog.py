"""All core queries by name, and their DuckDB SQL."""

from __future__ import annotations

from quarrymill.plans import answer_queries, corpus_queries, eval_queries, gate_queries, nested_queries, prompt_queries, source_queries, stream_queries

_MODULES = (nested_queries, corpus_queries, eval_queries, answer_queries, prompt_queries, gate_queries, source_queries, stream_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
