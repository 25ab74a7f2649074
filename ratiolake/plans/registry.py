"""Queries over the driver's tables, one per operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arith_queries, catalogue_queries, form_queries, pdf_queries, relational_queries, stats_queries, text_queries

_PARTS = [arith_queries, stats_queries, relational_queries, text_queries, form_queries, pdf_queries, catalogue_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
