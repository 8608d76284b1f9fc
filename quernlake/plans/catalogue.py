"""Every query of the retail and near-duplicate workloads by name, with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernlake.plans import dedup_queries, sales_queries

FLAGSHIP = "sales_revenue_by_month"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return sales_queries.QUERIES | dedup_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return sales_queries.ORACLE | dedup_queries.ORACLE
