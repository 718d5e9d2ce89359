"""All queries outside the optional subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import corpus, metric_queries, relational, statistic_queries, stream_queries, streams, vector_queries  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name."""
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus to packed sequences."""
    return streams.flagship_packed_tokens(spark, sf_dir)
