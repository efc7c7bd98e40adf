"""All queries of this package by name."""

from __future__ import annotations

from . import chat_queries, corpus_queries, eval_queries, state_queries, stream_queries, token_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (corpus_queries, token_queries, chat_queries, eval_queries, state_queries, stream_queries):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
