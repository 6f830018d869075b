"""All queries of the engine's own operators."""

from __future__ import annotations

from spanweave.plans import corpus_queries, evaluation_queries, generate_queries, line_queries, more_queries, native_queries, predict_queries, reader_queries, score_queries, span_queries, table_queries, whole_queries  # noqa: F401
from spanweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
