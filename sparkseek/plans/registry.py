"""Queries by name and, where SQL can express them, the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import document_queries, semantic_queries, text_queries

FLAGSHIP = "maxsim_exact"
_MODULES = (semantic_queries, document_queries, text_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
