"""All queries of the classification engine and their DuckDB twins."""

from __future__ import annotations

from tokensieve.plans import eval_queries, message_queries, model_queries, text_queries

ALL = {**text_queries.QUERIES, **model_queries.QUERIES, **eval_queries.QUERIES, **message_queries.QUERIES}


def queries() -> dict:
    return {k: q for k, (q, _) in ALL.items()}


def oracles() -> dict[str, str]:
    return {k: sql for k, (_, sql) in ALL.items() if sql}
