"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import page_queries, relational_queries, result_queries, scalar_queries, search_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return scalar_queries.QUERIES | relational_queries.QUERIES | page_queries.QUERIES | result_queries.QUERIES | search_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return scalar_queries.ORACLE | relational_queries.ORACLE | page_queries.ORACLE | result_queries.ORACLE | search_queries.ORACLE
