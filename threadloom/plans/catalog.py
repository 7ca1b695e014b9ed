"""All queries of the core with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans import problems, search_queries, text_queries


def queries() -> dict:
    return problems.QUERIES | text_queries.QUERIES | search_queries.QUERIES


def oracle() -> dict[str, str]:
    return problems.oracle() | text_queries.ORACLE | search_queries.ORACLE


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search_queries.fast_search(spark, d)
