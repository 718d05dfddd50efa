"""All queries of the imaging and behaviour operators, by name, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumatrace.plans import movies, recordings, traces

PARTS = (traces, recordings, movies)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.ORACLES.items()}
