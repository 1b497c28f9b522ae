"""The core's queries over the test tables, with the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwise.plans import corpus_queries, engine_queries, grid_queries, nested_queries, question_queries, record_queries, report_queries

_PARTS = (engine_queries, grid_queries, record_queries, corpus_queries, question_queries, report_queries, nested_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in _PARTS for k, s in p.ORACLE_SQL.items()}
