"""Registered queries of the checklist operators, and DuckDB SQL that computes the same in its own way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_diff, queries_ingest, queries_text, queries_trace

_PARTS = (queries_diff, queries_trace, queries_ingest, queries_text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.ORACLES.items()}
