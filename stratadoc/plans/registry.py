"""Queries over the given tables, by name, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment_queries, content_queries, contract_queries, evaluation_queries, report_queries, scoring_queries, style_queries, telemetry_queries, text_queries

GROUPS = [content_queries, text_queries, scoring_queries, telemetry_queries, evaluation_queries, style_queries, report_queries, alignment_queries, contract_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for g in GROUPS for k, v in g.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for g in GROUPS for k, v in g.ORACLES.items()}
